"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few numbers (lengths, shares of character classes, repetition). Cyclic
boosting visits the features in turn and fits a shallow tree of one feature to the
gradients, adding it to that feature's lookup table; then it does the same for the pairs
of features that explain most of the rest. A score is the logistic of a sum of table
entries, looked up by bin for a whole batch at once.

The model learns from a bounded sample: the ``TRAIN_ROWS`` labelled rows with the smallest
hash of their id. Everything else covers all rows.

Defined cases: a null or empty text has all-zero counts and gets a score like any other; a very long
text is measured whole; a null label doesn't train; of repeated labels or documents one row trains for each
id and label; equal scores (ties) need no order; repeated rows are scored one by one; without labels of both kinds
every score is 0.5; a null id is scored and not held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelode.llm.common import bytes_of, doc_of, slices, small_batches, smallest_hashes, words

TRAIN_ROWS = 12_000
BINS = 48
ROUNDS = 160
PAIR_ROUNDS = 60
PAIRS = 6
PAIR_BINS = 8
RATE = 0.1
LEAVES = 3
LEAST_ROWS = 10

FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "punctuation", "symbol", "exclamation", "pipe",
    "blank", "other_script", "lines_per_word", "distinct_words", "doubled_words", "longest_word", "period",
)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CLASSES = {
    "upper": _mask(bytes(range(65, 91))),
    "digit": _mask(b"0123456789"),
    "punctuation": _mask(b",;:'\"()?-"),
    "symbol": _mask(b"#*$%&<>@^~=+_\\/{}[]"),
    "exclamation": _mask(b"!"),
    "pipe": _mask(b"|"),
    "blank": _mask(b" \t\n\v\f\r"),
    "other_script": _mask(bytes(range(0xC0, 0x100))),
    "line": _mask(b"\n"),
    "period": _mask(b"."),
}


def _sums(mask: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ends) - 1)
    some = np.flatnonzero(np.diff(ends))
    if len(some):
        out[some] = np.add.reduceat(mask.view(np.int8), ends[:-1][some], dtype=np.int64)
    return out


def features(texts: pa.Array) -> np.ndarray:
    """(texts, features) of float64, from whole texts."""
    raw, ends = bytes_of(texts)
    w = words(texts)
    count = np.diff(w.first).astype(float)
    size = np.maximum(np.diff(ends), 1).astype(float)
    per_word = np.maximum(count, 1)
    share = {k: _sums(m[raw], ends) / size for k, m in _CLASSES.items()}
    doc = doc_of(w.first)
    codes = w.codes.astype(np.int64)
    distinct, doubled, longest = (np.zeros(len(count)) for _ in range(3))
    if len(codes):
        keys = pd.unique(doc * (len(w.names) + 1) + codes)
        distinct = np.bincount(keys // (len(w.names) + 1), minlength=len(count)) / per_word
        again = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
        doubled = np.bincount(doc[1:][again], minlength=len(count)) / per_word
        lengths = np.diff(np.frombuffer(w.names.buffers()[1], np.int32))[codes]
        some = np.flatnonzero(count)
        longest[some] = np.log1p(np.maximum.reduceat(lengths, w.first[:-1][some]))
    solid = size * (1 - share["blank"])
    return np.column_stack([
        np.log1p(np.diff(ends)), np.log1p(count), np.minimum(solid / per_word, 100), share["upper"], share["digit"], share["punctuation"], share["symbol"],
        share["exclamation"], share["pipe"], share["blank"], share["other_script"], share["line"] * size / per_word, distinct, doubled, longest, share["period"],
    ])


class Model(NamedTuple):
    """Lookup tables: ``cuts[f]`` are the bounds of feature f's bins."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += table[np.searchsorted(cuts, x[:, f], side="right")]
        if self.pairs:
            coarse = {f: np.searchsorted(self.pair_cuts[f], x[:, f], side="right") for f in {f for p in self.pairs for f in p}}
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                out += table[coarse[i], coarse[j]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _quantile_cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int) -> np.ndarray:
    """The values that a tree of up to ``leaves`` leaves over ordered bins gives them."""
    parts, values = [(0, len(g))], np.zeros(len(g))

    def gain(a: int, b: int) -> tuple[float, int]:
        gs, hs, ns = np.cumsum(g[a:b]), np.cumsum(h[a:b]), np.cumsum(n[a:b])
        ok = (ns[:-1] >= LEAST_ROWS) & (ns[-1] - ns[:-1] >= LEAST_ROWS)
        if not ok.any():
            return 0.0, -1
        whole = gs[-1] ** 2 / (hs[-1] + 1)
        split = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - whole
        split = np.where(ok, split, -1)
        return float(split.max()), a + int(split.argmax()) + 1

    while len(parts) < leaves:
        found = [(gain(a, b), (a, b)) for a, b in parts if b - a > 1]
        if not found:
            break
        (best, cut), (a, b) = max(found)
        if best <= 1e-6 or cut < 0:
            break
        parts.remove((a, b))
        parts += [(a, cut), (cut, b)]
    for a, b in parts:
        values[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return values


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best split of a grid of bins into four quadrants: its gain and its values."""
    gs, hs = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best, values = 0.0, np.zeros_like(g)
    at = None
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            a = gs[i, j], gs[i, -1] - gs[i, j], gs[-1, j] - gs[i, j], gs[-1, -1] - gs[i, -1] - gs[-1, j] + gs[i, j]
            b = hs[i, j], hs[i, -1] - hs[i, j], hs[-1, j] - hs[i, j], hs[-1, -1] - hs[i, -1] - hs[-1, j] + hs[i, j]
            gain = sum(p * p / (q + 1) for p, q in zip(a, b, strict=True)) - gs[-1, -1] ** 2 / (hs[-1, -1] + 1)
            if gain > best:
                best, at = gain, (i, j, [p / (q + 1) for p, q in zip(a, b, strict=True)])
    if at:
        i, j, v = at
        values[:i, :j], values[:i, j:], values[i:, :j], values[i:, j:] = v
    return best, values


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of labels ``y`` (0 or 1); without both kinds, one that says 0.5."""
    n_features = x.shape[1]
    nothing = [np.zeros(0)] * n_features
    if len(np.unique(y)) < 2:
        return Model(0.0, nothing, [np.zeros(1)] * n_features, nothing, [], [])
    rate = y.mean()
    base = float(np.log(rate / (1 - rate)))
    cuts = [_quantile_cuts(x[:, f], BINS) for f in range(n_features)]
    binned = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    rows = [np.bincount(b, minlength=len(t)) for b, t in zip(binned, tables, strict=True)]
    logit = np.full(len(y), base)
    for _ in range(ROUNDS):
        for f in range(n_features):
            p = 1 / (1 + np.exp(-logit))
            g, h = (np.bincount(binned[f], v, len(tables[f])) for v in (y - p, p * (1 - p)))
            step = RATE * _tree(g, h, rows[f], LEAVES)
            tables[f] += step
            logit += step[binned[f]]
    pair_cuts = [_quantile_cuts(x[:, f], PAIR_BINS) for f in range(n_features)]
    coarse = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(pair_cuts)]
    size = [len(c) + 1 for c in pair_cuts]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        cell = coarse[i] * size[j] + coarse[j]
        return tuple(np.bincount(cell, v, size[i] * size[j]).reshape(size[i], size[j]) for v in (y - p, p * (1 - p)))

    ranked = sorted(((_quadrants(*grids(i, j))[0], i, j) for i in range(n_features) for j in range(i)), reverse=True)
    pairs = [(i, j) for gain, i, j in ranked[:PAIRS] if gain > 0]
    pair_tables = [np.zeros((size[i], size[j])) for i, j in pairs]
    for _ in range(PAIR_ROUNDS):
        for table, (i, j) in zip(pair_tables, pairs, strict=True):
            step = RATE * _quadrants(*grids(i, j))[1]
            table += step
            logit += step[coarse[i], coarse[j]]
    return Model(base, cuts, tables, pair_cuts, pairs, pair_tables)


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, held_out: bool, rows: int, doc_id: str, text: str) -> DataFrame:
    """(y, text) of a bounded sample of the labelled rows outside the held-out fold: at most ``rows``
    labels, and one text for each id and label however often it is repeated."""
    rest = remainder(F.col("doc_id"), folds)
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(rest == fold if held_out else rest != fold)
    known = smallest_hashes(known, rows, 0, "doc_id", "y")  # at most ``rows`` narrow rows: small enough to broadcast
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(known), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("y", "text")


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text") -> Model:
    small_batches(docs.sparkSession)
    sample = training_rows(docs, labels, "quality", folds, fold, False, rows, doc_id, text)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    found = sample.mapInArrow(measure, "y int, x array<double>").toPandas()
    if not len(found):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.array(found["x"].tolist())
    order = np.lexsort(x.T)  # the sum of gradients depends on the order of rows
    return fit(x[order], found["y"].to_numpy(float)[order])


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``_score``."""
    small_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                s = model.scores(features(part.column(part.schema.get_field_index(text))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], [*part.schema.names, "_score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score, f"{fields}, _score double")


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of each document."""
    model = train(docs, labels, folds, fold, doc_id=doc_id, text=text)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held_out = F.coalesce(remainder(F.col("doc_id"), folds) == fold, F.lit(False))
    return scored(narrow, model).select("doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labelled: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, by a model of ``labelled`` documents."""
    own = [f"_own_{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*own)
    model = train(labelled, labels, text=text)
    return scored(inner, model, own[docs.columns.index(text)]).where(F.col("_score") >= 0.5).select(*own).toDF(*docs.columns)
