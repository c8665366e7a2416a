"""Quality rules at document and host level.

Each text gets word, symbol and repetition counts; documents that fail a base rule are
counted by host. A host's failure rate is shrunk towards the corpus with a beta prior,
fitted to all hosts by moments, and a host whose shrunk rate is over ``host_limit`` loses
the rest of its documents too. The statistics are written once, without the texts; host
verdicts come back to documents by a broadcast join while hosts are few, else by a
shuffled one, in which Spark splits hot hosts.

Defined cases: a null or empty text has no words and fails; a very long text is counted whole; a null host is a host of its
own; a rate that equals the limit (a tie) is kept; repeated rows are judged one by one; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode.llm.common import bytes_of, doc_of, slices, small_batches, words, written

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
HOST_LIMIT = 0.5
#: Hosts up to which the verdicts are broadcast (some 100 bytes each).
BROADCAST_HOSTS = 100_000
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (2.0, 1e6)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_HEAD = np.ones(256, bool)  # bytes that begin a code point
_HEAD[0x80:0xC0] = False
_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False


def _per_text(mask: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[ends[1:]] - total[ends[:-1]]


def repeated_words(codes: np.ndarray, first: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Per text, the words inside windows of ``width`` words (a power of two) that occur
    twice or more in that text. Windows are numbered by doubling, so equal numbers are
    equal windows: no hash is involved."""
    n_docs, n = len(first) - 1, len(codes)
    if n < width:
        return np.zeros(n_docs, np.int64)
    ids, step = codes.astype(np.int64), 1
    while step < width:
        ids = pd.factorize(ids[:-step] * (int(ids.max()) + 1) + ids[step:])[0].astype(np.int64)
        step *= 2
    doc = doc_of(first)
    whole = doc[: len(ids)] == doc[width - 1 :]  # windows inside one text
    at = np.flatnonzero(whole)
    if not len(at):
        return np.zeros(n_docs, np.int64)
    key = pd.factorize(doc[at] * (int(ids.max()) + 1) + ids[at])[0]
    again = at[np.bincount(key)[key] > 1]
    cover = np.cumsum(np.bincount(again, minlength=n))
    cover[width:] -= cover[:-width].copy()  # windows that began in the last ``width`` words
    return np.bincount(doc[cover > 0], minlength=n_docs).astype(np.int64)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return len(lines) - len(set(lines))


class TextCounts(NamedTuple):
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def text_counts(texts: pa.Array) -> TextCounts:
    raw, ends = bytes_of(texts)
    w = words(texts)
    return TextCounts(
        np.diff(w.first).astype(np.int64),
        _per_text(_HEAD[raw] & _SOLID[raw], ends),
        _per_text(_SYMBOL[raw], ends),
        np.array([repeated_lines(x) for x in texts.to_pylist()], np.int64),
        repeated_words(w.codes, w.first),
    )


def fails(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > REPEAT_PERCENT * n_words)


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of each text behind its own columns."""
    small_batches(docs.sparkSession)
    names = [*docs.columns, *(x.split()[0] for x in COUNTS.split(", "))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                c = text_counts(part.column(part.schema.get_field_index(text)))
                made = [pa.array(x) for x in (*c, fails(c.n_words, c.n_repeat_words))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(count, f"{fields}, {COUNTS}")


class Prior(NamedTuple):
    """A beta prior: ``mean`` and ``weight`` (alpha + beta)."""

    mean: float
    weight: float
    hosts: int


def fit_prior(hosts: DataFrame) -> Prior:
    """Moments of the beta-binomial over hosts (columns ``n``, ``failed``); one row comes back."""
    x = hosts.agg(
        F.count("*").alias("h"),
        F.sum("n").alias("n"),
        F.sum("failed").alias("f"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("n")).alias("npp"),
    ).first()
    if not x["h"]:
        return Prior(0.5, PRIOR_WEIGHT[0], 0)
    n = float(x["n"])
    mean = min(max(x["f"] / n, 1e-6), 1 - 1e-6)
    binomial = mean * (1 - mean)
    free = n - x["nn"] / n
    spread = (x["npp"] - n * mean * mean - (x["h"] - 1) * binomial) / free if free > 0 else 0.0
    weight = binomial / spread - 1 if spread > 0 else PRIOR_WEIGHT[1]
    return Prior(mean, min(max(weight, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1]), x["h"])


def host_rates(counts: DataFrame, host: str) -> tuple[DataFrame, Prior]:
    """Per host: documents, failures, and the shrunk failure rate."""
    hosts = counts.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")
    )
    prior = fit_prior(hosts)
    rate = (F.col("failed") + F.lit(prior.mean * prior.weight)) / (F.col("n") + F.lit(prior.weight))
    return hosts.withColumn("host_rate", rate), prior


def with_verdicts(counts: DataFrame, host: str, host_limit: float = HOST_LIMIT) -> DataFrame:
    """``counts`` (already written: it is read twice) with ``host_rate``, ``host_rejected`` and ``kept``."""
    hosts, prior = host_rates(counts, host)
    hosts = hosts.select("host", "host_rate", (F.col("host_rate") > host_limit).alias("host_rejected"))
    if prior.hosts <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    joined = counts.join(hosts, counts[host].eqNullSafe(hosts["host"]), "left").drop(hosts["host"])
    return joined.withColumn("kept", ~(F.col("base_failed") | F.coalesce("host_rejected", F.lit(False))))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: ``doc_id``, ``host``, its counts, ``base_failed``, the host's
    shrunk rate and verdict, and ``kept``."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("_host"), F.col(text).alias("text"))
    counts = written(document_counts(narrow).drop("text"), "quality")
    return with_verdicts(counts, "_host", host_limit).withColumnRenamed("_host", "host")


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns. The counts travel beside the
    rows into one written table, so texts are neither counted twice nor shuffled: the rejected hosts
    are broadcast. If there are over BROADCAST_HOSTS of those, the rows that they lose are found without texts
    and leave by their numbers, so that no host's texts meet."""
    keep = [f"_keep_{i}" for i in range(len(docs.columns))]  # counts may clash with columns of docs
    inner = docs.toDF(*keep).withColumn("_row", F.monotonically_increasing_id())
    t, h = (keep[docs.columns.index(x)] for x in (text, host))
    counted = document_counts(inner, t)
    table = written(counted.select(*keep, "_row", "base_failed"), "quality")
    hosts, _ = host_rates(table, h)
    bad = written(hosts.where(F.col("host_rate") > host_limit).select("host"), "hosts")
    good = table.where(~F.col("base_failed"))
    if bad.count() <= BROADCAST_HOSTS:
        out = good.join(F.broadcast(bad), good[h].eqNullSafe(bad["host"]), "left_anti")
    else:
        rows = good.select("_row", h)
        out = good.join(rows.join(bad, rows[h].eqNullSafe(bad["host"]), "left_semi").select("_row"), "_row", "left_anti")
    return out.select(*keep).toDF(*docs.columns)
