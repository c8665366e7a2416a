"""License scan by conditional compression.

Every cue in a text (a word that license notices use) gets a candidate block: the words on
both sides of it, so many that any wording of a size class fits in, wherever lines are wrapped and
however long a paragraph is. The block is compressed as it is and with each wording of the
class as a raw zstandard dictionary, and wordings are ranked by the bytes they save. From the first
to the last, each one that could win (its words are in the block, but for ``MOST_MISSING`` of them) is confirmed by its
exact words: a cheapest edit script (insertions, deletions, replacements) aligns it with the span of the block that
fits it best and holds the cue. A low rank leaves none out: a wording with many words put in between saves hardly a byte. A verdict is ``exact`` (no difference), ``variant`` (the wording's key words are
there, at most ``MOST_MISSING`` of its words are not, and no more words are added than it has), or
``unconfirmed``. All confirmed spans of a text are reported; of two that overlap and say the same, the one
that matches more. A cue outside every confirmed span gives one unconfirmed row for its sentence.

The work is in proportion to the number of cues; a span is found however far its ends are from its cue.

Defined cases: a null or empty text has no cues and no rows; a text may have several rows; equal
blocks (ties) give the wording that stands first in ``TEMPLATES``; repeated rows are scanned one by one; a very
long text is scanned whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode.llm.common import slices, small_batches
from pricelode.llm.license_texts import TEMPLATES

LEVEL = 3
MOST_MISSING = 0.25
#: What a missing or replaced word costs an alignment; an added one costs 1.
MISSING = 2
#: Wordings of up to so many words share blocks of one size.
CLASSES = (12, 48, 1000)
#: An unconfirmed row shows so many words on each side of its cue, at most.
SHOWN = 30

CUE = (
    r"licen[cs]e|copyright|all rights reserved|public domain|permission is|is hereby|redistribution and use|creative commons|\bcc[ -]?(?:by|0)|spdx|\bapache\b|\b[al]?gpl|\bmozilla\b"
    r"|\beclipse public\b|provided ['\"]?as[- ]is|permitted to copy|\b(?-i:MIT|BSD|ISC)\b"
)

_CUE = re.compile(CUE, re.IGNORECASE)
_WORD = re.compile(r"[A-Za-z0-9]+(?:[.\-'][A-Za-z0-9]+)*")
_BREAK = re.compile(r"\n|(?<=[.!?:;])\s+(?=[A-Z(\"])")


class Wording(NamedTuple):
    license: str
    keys: frozenset[str]
    words: tuple[str, ...]
    compressor: zstandard.ZstdCompressor


class Finding(NamedTuple):
    license: str
    saved: int
    missing: int
    added: int
    differences: str
    verdict: str
    runner_up: str


class Match(NamedTuple):
    """An alignment: the words block[begin:end], and how they differ."""

    begin: int
    end: int
    missing: int
    added: int
    shown: list[str]
    keys: tuple[int, ...]  # places of the wording's key words in the block
    verdict: str

    def worth(self, wording: Wording) -> float:
        return len(wording.words) - self.missing - (self.missing + self.added) / 2


def words_of(text: str) -> tuple[str, ...]:
    return tuple(w.lower() for w in _WORD.findall(text))


@lru_cache(maxsize=1)
def wordings() -> tuple[list[Wording], zstandard.ZstdCompressor]:
    """All wordings with their compressors, and one without a dictionary."""
    made = []
    for name, (keys, texts) in TEMPLATES.items():
        for text in texts:
            words = words_of(text)
            raw = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            made.append(Wording(name, frozenset(keys) & frozenset(words), words, zstandard.ZstdCompressor(level=LEVEL, dict_data=raw)))
    return made, zstandard.ZstdCompressor(level=LEVEL)


@lru_cache(maxsize=1)
def classes() -> list[tuple[int, list[int]]]:
    """(words on each side of a cue, numbers of the wordings) of each size class. The span that fits
    best costs no more than leaving out the whole wording, so it has at most three times its words."""
    known, low, out = wordings()[0], 0, []
    for high in CLASSES:
        some = [k for k, w in enumerate(known) if low < len(w.words) <= high]
        if some:
            out.append((3 * max(len(known[k].words) for k in some) + 2, some))
        low = high
    return out


def align(block: tuple[str, ...], wording: tuple[str, ...], at: int | None = None, keys: frozenset[str] = frozenset()) -> Match:
    """The span of ``block`` that takes the least to turn into ``wording``: a missing or replaced word
    costs MISSING, and one that the block has besides 1. Words outside the span are free. With
    ``at``, the span holds that word."""
    code = {w: k for k, w in enumerate(dict.fromkeys(wording))}
    b = np.array([code.get(w, -1) for w in block], np.int32)
    t = [code[w] for w in wording]
    n, m, place = len(b), len(t), np.arange(len(b) + 1)
    cost = np.empty((m + 1, n + 1), np.int32)
    cost[0] = 0 if at is None else np.maximum(place - at, 0)
    for i in range(1, m + 1):
        step = cost[i - 1] + MISSING
        step[1:] = np.minimum(step[1:], cost[i - 1, :-1] + MISSING * (b != t[i - 1]))
        cost[i] = np.minimum.accumulate(step - place) + place  # and words that the block has besides
    low = 0 if at is None else at + 1
    end = low + int(cost[m, low:].argmin())
    while end < n and cost[m, end + 1] == cost[m, end] == cost[m - 1, end] + MISSING * (b[end] != t[m - 1]):
        end += 1  # a replaced last word belongs to the span
    i, j, steps = m, end, []
    while i:
        if j and cost[i, j] == cost[i - 1, j - 1] + MISSING * (b[j - 1] != t[i - 1]):
            i, j = i - 1, j - 1
            steps.append((i, j))
        elif cost[i, j] == cost[i - 1, j] + MISSING:
            i -= 1
            steps.append((i, None))
        else:
            j -= 1
            steps.append((None, j))
    if at is not None:
        while j > at:
            j -= 1
            steps.append((None, j))
    missing, added, shown, found = 0, 0, [], {}
    lost: list[str] = []
    more: list[str] = []

    def close() -> None:
        if lost or more:
            shown.append(f"-[{' '.join(lost)}]+[{' '.join(more)}]")
            lost.clear(), more.clear()

    for x, y in reversed(steps):
        if x is not None and y is not None and t[x] == b[y]:
            close()
            found.setdefault(wording[x], y)
        else:
            if x is not None:
                lost.append(wording[x])
                missing += 1
            if y is not None:
                more.append(block[y])
                added += 1
    close()
    held = keys <= found.keys() and missing <= MOST_MISSING * m and added <= m
    verdict = "exact" if not missing and not added else "variant" if held else "unconfirmed"
    return Match(j, end, missing, added, shown, tuple(sorted(found[k] for k in keys if k in found)), verdict)


def differences(block: tuple[str, ...], template: tuple[str, ...]) -> tuple[int, int, list[str]]:
    """Words of the template that the block lacks, words that it has inside the template's
    span besides, and both as text."""
    m = align(block, template)
    return m.missing, m.added, m.shown


@lru_cache(maxsize=4096)
def ranked(block: str, size_class: int) -> list[tuple[int, int]]:
    """(bytes saved, wording) of the wordings of a class, most first; ties by their order."""
    known, plain = wordings()
    raw = block.encode()
    alone = len(plain.compress(raw))
    return sorted(((alone - len(known[k].compressor.compress(raw)), k) for k in classes()[size_class][1]), key=lambda x: (-x[0], x[1]))


class Hit(NamedTuple):
    """A confirmed wording, in words of the text."""

    wording: int
    begin: int
    end: int
    keys: tuple[int, ...]
    worth: float
    finding: Finding

    def repeats(self, other: Hit) -> bool:
        """Does it overlap ``other`` and say nothing besides?"""
        if self.begin >= other.end or other.begin >= self.end:
            return False
        same = wordings()[0][self.wording].license == wordings()[0][other.wording].license
        return same or all(other.begin <= k < other.end for k in self.keys)


def _confirmed(words: list[str], cue: int) -> Iterator[Hit]:
    """The wordings that the block around a cue holds."""
    known = wordings()[0]
    for number, (radius, _) in enumerate(classes()):
        low = max(0, cue - radius)
        block = tuple(words[low : cue + radius + 1])
        present = set(block)
        order = ranked(" ".join(block), number)
        for saved, k in order:
            w = known[k]
            if not w.keys <= present or sum(x not in present for x in w.words) > MOST_MISSING * len(w.words):
                continue  # lacks too many words, wherever they stand
            m = align(block, w.words, cue - low, w.keys)
            if m.verdict != "unconfirmed":
                other = next((known[o].license for _, o in order if known[o].license != w.license), "")
                yield Hit(k, m.begin + low, m.end + low, tuple(p + low for p in m.keys), m.worth(w), Finding(w.license, saved, m.missing, m.added, "; ".join(m.shown), m.verdict, other))


def _guess(block: str) -> Finding:
    """What an unconfirmed block is most like."""
    known = wordings()[0]
    words = words_of(block)
    order = [x for c in range(len(classes())) for x in ranked(" ".join(words), c) if len(known[x[1]].words) <= max(CLASSES[0], 2 * len(words))]
    order.sort(key=lambda x: (-x[0], x[1]))
    saved, k = order[0]
    m = align(words, known[k].words)
    other = next((known[o].license for _, o in order if known[o].license != known[k].license), "")
    return Finding(known[k].license, saved, m.missing, m.added, "; ".join(m.shown), "unconfirmed", other)


def scan(text: str) -> list[tuple[int, str, Finding]]:
    """(offset, block, finding) of all confirmed spans and of the cues outside them, in order."""
    cues = [m.start() for m in _CUE.finditer(text)]
    if not cues:
        return []
    words, begins, ends = [], [], []
    for m in _WORD.finditer(text):
        words.append(m[0].lower())
        begins.append(m.start())
        ends.append(m.end())
    at = sorted({min(bisect_right(ends, c), len(words) - 1) for c in cues})
    hits = {(h.wording, h.begin, h.end): h for c in at for h in _confirmed(words, c)}
    order = sorted(hits.values(), key=lambda h: (-h.worth, h.finding.missing + h.finding.added, -len(wordings()[0][h.wording].words), h.wording, h.begin))
    chosen: list[Hit] = []
    by_word: dict[int, list[Hit]] = {}  # the chosen spans that hold a word
    for h in order:
        near = {id(o): o for p in range(h.begin, h.end) for o in by_word.get(p, [])}
        if not any(h.repeats(o) for o in near.values()):
            chosen.append(h)
            for p in range(h.begin, h.end):
                by_word.setdefault(p, []).append(h)
    out = []
    for h in chosen:
        stop = ends[h.end - 1]
        while stop < len(text) and text[stop] in ".\")":  # the wording's own last sign
            stop += 1
        out.append((begins[h.begin], text[begins[h.begin] : stop], h.finding))
    breaks = [0, *(m.end() for m in _BREAK.finditer(text)), len(text) + 1]
    last = -1
    for c in at:
        if c in by_word or begins[c] < last:
            continue
        k = bisect_right(breaks, begins[c])
        low = max(breaks[k - 1], begins[max(0, c - SHOWN)])
        high = min(breaks[k] - 1, ends[min(len(words) - 1, c + SHOWN)] + 1)
        block = text[low:high].strip()
        out.append((low + len(text[low:high]) - len(text[low:high].lstrip()), block, _guess(block)))
        last = high
    return sorted(out, key=lambda x: x[0])


def identify(block: str) -> Finding:
    """The license that a block names best."""
    order = ("exact", "variant", "unconfirmed")
    found = scan(block)
    return min(found, key=lambda x: (order.index(x[2].verdict), x[0]))[2] if found else _guess(block)


SCHEMA = "offset int, block string, license string, saved int, missing int, added int, differences string, verdict string, runner_up string"


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per license block: doc_id, offset (characters), the block's text, the license,
    bytes saved, and the differences of wording."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for part in slices(batch, "text"):
                some = part.filter(pc.match_substring_regex(part.column(1), CUE, ignore_case=True))
                rows = [(k, at, block, *f) for k, t in enumerate(some.column(1).to_pylist()) for at, block, f in scan(t)]
                if rows:
                    doc, *rest = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(doc)), *(pa.array(c, t) for c, t in zip(rest, types, strict=True))], names)

    return narrow.mapInArrow(find, f"doc_id {kind}, {SCHEMA}")
