"""Spelling variants: words one edit apart, found in a forward and a reversed sorted dictionary.

Words are counted in slices of texts first, so a word that is everywhere is one row of each slice. Two words whose
longer one has M code points and that differ by one inserted, deleted or replaced code point share their first M // 2 code points or
their last M - M // 2: one edit leaves a half intact. So each word is put in the forward dictionary by its first
half and in the reversed one by its last half (read backwards), once with M its own length and once
with M one more. Both are sorted, ranges of them are dealt to tasks, and a task scans blocks of words with
the same half and M.

A block of over ``MOST`` words is subdivided: the part that its words don't share (``a`` code points in front and ``b`` behind are shared)
has an intact half too, so its words go to blocks of a longer front or a longer end. This goes on for as long as a block is large; a block whose words share all but one
place holds near words only, no more than there are letters. Inside a task smaller blocks are halved the same way down to ``FEW`` words,
which are compared one by one. Of all blocks that hold a pair, that one counts it that the length of
their common front leads to, so each pair is verified and counted once.

Each word's near words are added up where they are found; forms then lead to roots by doubling steps (n doubles at least with each
form, so steps are few).

Defined cases: null and empty texts have no words; a null id counts as empty in the sum that strikes letters; a very long text is read whole, and words of any
length take part; of near words with the same n the first in code-point order is the form; repeated rows count each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode.llm.common import bytes_of, doc_of, slices, small_batches, spread_join, written

#: A run whose sum is divisible by this loses a letter.
STRIKE = 97
LEAST_CHARS = 5
LEAST_COUNT = 3
#: A form has so many times its word's count at least.
RATIO = 2
#: Words of a block that a task holds; larger blocks are subdivided by Spark.
MOST = 1000
#: Words of a block that are compared one by one.
FEW = 12

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LEAD = 0xC3  # the first byte of U+00C0 to U+00FF, and of nothing else
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def letter_runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All maximal runs of letters as one binary array, A-Z lower-cased, and where each text's runs begin."""
    raw, ends = bytes_of(texts)
    solid = _LETTER[raw] | (raw == _LEAD)
    solid[1:] |= raw[:-1] == _LEAD
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = ends[:-1][ends[:-1] < len(raw)]
    begins[inner] = solid[inner]
    starts = np.flatnonzero(begins)
    packed = _LOWER[raw[solid]]
    at = np.append(np.cumsum(solid, dtype=np.int32)[starts] - 1, len(packed)).astype(np.int32)
    flat = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(packed)])
    return flat, np.searchsorted(starts, ends)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()
#: Longer words (in bytes) have their sums computed one by one.
LONG_WORD = 64


def pair_sums(heads: list[bytes], names: list[bytes], doc: np.ndarray, code: np.ndarray) -> np.ndarray:
    """crc32 of heads[doc[i]] + names[code[i]]. A sum is linear: the head's, carried over as many zero bytes as the
    name has, and the name's own."""
    size = np.array([len(x) for x in names], np.int64)
    width = min(int(size.max(initial=0)), LONG_WORD)
    carried = np.empty((len(heads), width + 1), np.uint32)
    carried[:, 0] = [zlib.crc32(h) for h in heads]
    for k in range(width):
        carried[:, k + 1] = _CRC[carried[:, k] & 0xFF] ^ (carried[:, k] >> 8)
    own = np.array([zlib.crc32(x) for x in names], np.uint32)
    out = carried[doc, np.minimum(size[code], width)] ^ own[code]
    for i in np.flatnonzero(size[code] > LONG_WORD).tolist():
        out[i] = zlib.crc32(heads[doc[i]] + names[code[i]])
    return out


def slice_counts(ids: list[str], texts: pa.Array) -> Counter[str]:
    """How often each word stands in some texts, after letters are struck out."""
    flat, first = letter_runs(texts)
    coded = flat.dictionary_encode()
    names = coded.dictionary.to_pylist()
    if not names:
        return Counter()
    pairs, times = np.unique(doc_of(first) * len(names) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    doc, code = np.divmod(pairs, len(names))
    sums = pair_sums([f"{i}:".encode() for i in ids], names, doc, code)
    struck = sums % STRIKE == 0
    whole = np.bincount(code[~struck], times[~struck], len(names)).astype(np.int64).tolist()
    out = Counter()
    for name, n in zip(names, whole, strict=True):
        if n and len(name) >= LEAST_CHARS and len(word := name.decode()) >= LEAST_CHARS:
            out[word] = n
    for i in np.flatnonzero(struck).tolist():
        word = names[code[i]].decode()
        at = int(sums[i]) % len(word)
        if len(word) > LEAST_CHARS:
            out[word[:at] + word[at + 1 :]] += int(times[i])
    return out


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words of LEAST_CHARS code points and LEAST_COUNT occurrences or more."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = slice_counts(part.column(0).to_pylist(), part.column(1))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    return narrow.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


BLOCK = ["size", "a", "b", "front", "back"]


def halved(rows: DataFrame) -> DataFrame:
    """Each row (id, word, n, size, a, b) in the two blocks that share half of what its block doesn't share: front, or
    back (backwards)."""
    middle = F.col("size") - F.col("a") - F.col("b")
    half = (middle / 2).cast("int")
    longer_front = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"))
    longer_back = F.struct(F.col("a").alias("a"), (F.col("b") + middle - half).alias("b"))
    out = rows.withColumn("block", F.explode(F.array(longer_front, longer_back))).select("id", "word", "n", "size", "block.a", "block.b")
    return out.withColumn("front", F.expr("substring(word, 1, a)")).withColumn("back", F.reverse(F.expr("right(word, b)")))


def blocks(words: DataFrame, most: int = MOST) -> DataFrame:
    """Every word (id, word, n) in its blocks, none of over ``most`` words as long as it can be halved."""
    length = F.length("word")
    rows = halved(words.select("id", "word", "n", F.explode(F.array(length, length + 1)).alias("size"), F.lit(0).alias("a"), F.lit(0).alias("b")))
    out: DataFrame | None = None
    while True:
        large = rows.groupBy(*BLOCK).count().where((F.col("count") > most) & (F.col("size") - F.col("a") - F.col("b") > 1)).select(*BLOCK)
        large = written(large, "large-blocks")  # its size is known: Spark broadcasts it where it is small
        none = large.isEmpty()
        small = rows if none else rows.join(large, BLOCK, "left_anti").select(*rows.columns)
        out = small if out is None else out.unionByName(small)
        if none:
            return out
        rows = written(halved(rows.join(large, BLOCK, "left_semi").select("id", "word", "n", "size", "a", "b")), "halved-blocks")


def _one_edit(x: str, y: str, size: int, a: int, b: int) -> bool:
    """Do two different words that share ``a`` code points in front and ``b`` behind differ by one edit that is counted in this block?"""
    if len(x) < len(y):
        x, y = y, x
    if len(x) != size:
        return False
    p, stop = a, size - 1 - b
    while p <= stop and p < len(y) and x[p] == y[p]:
        p += 1
    return p <= stop and x[p + 1 :] == (y[p + 1 :] if len(y) == size else y[p:])


def near_pairs(words: list[str], rows: list[int], size: int, a: int, b: int) -> Iterator[tuple[int, int]]:
    """The pairs of a block that are one edit apart, and counted in it or in one of its halves."""
    middle = size - a - b
    if len(rows) <= FEW or middle == 1:
        for k, i in enumerate(rows):
            for j in rows[k + 1 :]:
                if _one_edit(words[i], words[j], size, a, b):
                    yield i, j
        return
    more_front, more_back = a + middle // 2, b + middle - middle // 2
    fronts, backs = defaultdict(list), defaultdict(list)
    for i in rows:
        fronts[words[i][:more_front]].append(i)
        backs[words[i][len(words[i]) - more_back :]].append(i)
    for own in fronts.values():
        if len(own) > 1:
            yield from near_pairs(words, own, size, more_front, b)
    for own in backs.values():
        if len(own) > 1:
            yield from near_pairs(words, own, size, a, more_back)


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(id, n_near, form_n, form) of the words that have near words: how many, and of these the most frequent."""
    dictionaries = blocks(words, most).select(*BLOCK, "id", "word", "n").repartitionByRange(*BLOCK).sortWithinPartitions(*BLOCK, "word")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(runs: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(runs)
            keys = list(zip(*(table.column(c).to_pylist() for c in BLOCK), strict=True))
            ids, names, ns = (table.column(c).to_pylist() for c in ("id", "word", "n"))
            near, best = Counter(), {}
            start = 0
            for stop in [*(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]:
                if stop - start > 1:
                    for pair in near_pairs(names, list(range(start, stop)), *keys[start][:3]):
                        for i, j in (pair, pair[::-1]):
                            near[i] += 1
                            best[i] = min(best.get(i, (0, "")), (-ns[j], names[j]))
                start = stop
            rows = [(ids[i], k, -best[i][0], best[i][1]) for i, k in near.items()]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, ["id", "n_near", "form_n", "form"])

        held: list[pa.RecordBatch] = []  # the last block, which may go on in the next batch
        last: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = pa.StructArray.from_arrays([batch.column(c) for c in range(len(BLOCK))], BLOCK)
            first, end = tuple(keys[0].as_py().values()), tuple(keys[-1].as_py().values())
            if held and first != last:
                yield found(held)
                held = []
            cut = batch.num_rows
            if first != end:  # where the last block begins
                same = pc.equal(batch.column(0), end[0])
                for c in range(1, len(BLOCK)):
                    same = pc.and_(same, pc.equal(batch.column(c), end[c]))
                cut = pc.index(same, True).as_py()
                yield found([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut) if first != end else batch)
            last = end
        if held:
            yield found(held)

    parts = dictionaries.mapInArrow(scan, "id long, n_near long, form_n long, form string")
    added = parts.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("minus"), "form")).alias("best"))
    return added.select("id", "n_near", (-F.col("best.minus")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms (written: word, form) of each word lead to in the end. Every round doubles the steps."""
    reached = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = spread_join(reached, reached.select(F.col("word").alias("root"), F.col("root").alias("further")), "root")
        stepped = written(further.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        reached = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return reached


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """One row for each word: word, n, n_near, form, form_n and root."""
    words = written(word_counts(docs, doc_id, text).withColumn("id", F.monotonically_increasing_id()), "words")
    found = words.join(near_words(words, most), "id", "left")
    is_form = F.col("form_n") >= RATIO * F.col("n")
    judged = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    judged = written(judged, "judged")
    lead = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(lead, "word", "left").withColumn("root", F.coalesce("root", "word"))
