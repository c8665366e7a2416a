"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon.

The words of all texts are counted; the most frequent, ``LEXICON`` at most, are encoded by exact merges
on the executors and compiled into a minimal acyclic automaton: states that accept the same suffixes are
one, and a word's number (how many words sort before it, summed along its path) leads to
its ids. The automaton is one file of plain arrays in the shared folder, memory-mapped by
every worker. A batch's distinct words walk it together, one byte a step; the others are
merged exactly: always the leftmost pair of the lowest rank.

A text is cut at ASCII blanks and between ASCII letters and signs, where no pre-token of the
tokenizer's pattern reaches across; a text that holds a special token's string is cut at
blanks only. Decoding joins token strings by blanks, as a tokenizer without a decoder does.

Supported files: BPE with an end-of-word suffix, the normalizers NFC, blank collapsing and
lower-casing, and a split by pattern before the byte alphabet. Others are refused.

Defined cases: a null or empty text has no tokens and decodes to nothing; a very long text is cut
and encoded whole, in time n log n at its worst; other columns are ignored; repeated rows are encoded one by
one; of words equally frequent all or none are in the lexicon; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode.llm.common import bytes_of, shared_dir, slices, small_batches, written
from pricelode.llm.files import local_path, open_file, write_file
from pricelode.llm.token_store import CUT_BYTES, Memory

#: Words of the lexicon, at most; the rest is merged when met.
LEXICON = 100_000
#: A lexicon word has at most so many bytes.
LONGEST = 40
REMEMBERED = 200_000
#: From so many symbols on, merges use a heap.
LONG_WORD = 48

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SIGN = np.zeros(256, bool)
_SIGN[list(b".,!?*#$%&;:|")] = True


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself
    if it is printable, else the next code point from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """The tokenizer of a file, word by word."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or not self.suffix or steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or spec["decoder"]:
            raise ValueError("not a tokenizer of the supported kind")
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")

    def merge(self, symbols: list[str]) -> list[str]:
        if len(symbols) >= LONG_WORD:
            return self._merge_long(symbols)
        get, never = self.ranks.get, len(self.ranks)
        found = [get(p, never) for p in zip(symbols, symbols[1:], strict=False)]
        while found and (best := min(found)) != never:
            i = found.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del found[i]  # only the pairs beside it are new
            if i:
                found[i - 1] = get((symbols[i - 1], symbols[i]), never)
            if i < len(found):
                found[i] = get((symbols[i], symbols[i + 1]), never)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same in n log n: a heap of pairs over a linked list."""
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(self.ranks[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in self.ranks]
        heapq.heapify(heap)
        text: list[str | None] = list(symbols)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if text[i] != a or j < 0 or text[j] != b:
                continue
            text[i], text[j] = a + b, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (pair := (text[k], text[after[k]])) in self.ranks:
                    heapq.heappush(heap, (self.ranks[pair], k, *pair))
        return [t for t in text if t is not None]

    def encode_word(self, word: str) -> list[int]:
        """The ids of a piece that holds no special token."""
        text = word.lower() if word.isascii() else "".join(map(str.lower, unicodedata.normalize("NFC", word)))
        ids: list[int] = []
        for piece in self.pattern.findall(text):
            symbols = [self.alphabet[b] for b in piece.encode()]
            symbols[-1] += self.suffix
            ids += [self.vocab[s] for s in self.merge(symbols)]
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of any text."""
        ids: list[int] = []
        at = 0
        for m in self.special_pattern.finditer(text):
            ids += self.encode_word(text[at : m.start()])
            ids.append(self.special[m.group()])
            at = m.end()
        return ids + self.encode_word(text[at:])

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids)


@lru_cache(maxsize=2)
def tokenizer_of(path: str) -> WordBpe:
    return WordBpe(path)


def lower_words(words: pa.Array, special: list[str]) -> pa.Array:
    """ASCII words in lower case, as the tokenizer has them; others, and those that would then hold
    a special token's string, as they are."""
    at = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4) if len(words) else np.zeros(1, np.int32)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    other = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(raw >= 0x80, out=other[1:])
    keep = other[at[1:]] > other[at[:-1]]
    low = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(at), pa.py_buffer(_LOWER[raw])])
    for s in special:
        keep |= pc.match_substring(low, s).to_numpy(zero_copy_only=False)
    if not keep.any():
        return low
    mixed = np.where(np.repeat(keep, np.diff(at)), raw, _LOWER[raw])
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(at), pa.py_buffer(mixed)])


def cut_words(texts: pa.Array, special: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as one binary array, and where each text's begin."""
    raw, ends = bytes_of(texts)
    solid = ~_BLANK[raw]
    begins = solid.copy()
    letter, sign = _LETTER[raw], _SIGN[raw]
    inside = (letter[1:] & sign[:-1]) | (sign[1:] & letter[:-1])
    for s in special:
        for i in np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False)):
            inside[ends[i] : max(ends[i + 1] - 1, ends[i])] = False
    begins[1:] &= ~solid[:-1] | inside
    heads = ends[:-1][ends[:-1] < len(raw)]
    begins[heads] = solid[heads]
    starts = np.flatnonzero(begins)
    place = np.cumsum(solid, dtype=np.int32)
    at = np.append(place[starts] - 1, np.int32(np.count_nonzero(solid))).astype(np.int32)
    flat = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(raw[solid])])
    return flat, np.searchsorted(starts, ends)


def word_counts(docs: DataFrame, text: str, special: list[str]) -> DataFrame:
    """(word, n) over all texts, ASCII words in lower case."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CUT_BYTES):
                coded = cut_words(part.column(0), special)[0].dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([lower_words(coded.dictionary, special), pa.array(n.astype(np.int64))], ["word", "n"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(count, "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def compile_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of distinct words, built from their sorted list: the
    states of a finished branch are replaced by equal ones that are known."""
    words = sorted(set(words))
    edges: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (state, byte) along the last word

    def finish(depth: int) -> None:
        while len(path) > depth:
            state, byte = path.pop()
            child = edges[state][byte]
            same = known.setdefault((final[child], *edges[child].items()), child)
            edges[state][byte] = same

    last = b""
    for w in words:
        shared = next((k for k, (a, b) in enumerate(zip(last, w, strict=False)) if a != b), min(len(last), len(w)))
        finish(shared)
        state = edges[path[-1][0]][path[-1][1]] if path else 0
        for byte in w[shared:]:
            edges.append({})
            final.append(False)
            edges[state][byte] = len(edges) - 1
            path.append((state, byte))
            state = len(edges) - 1
        final[state] = True
        last = w
    finish(0)
    order: dict[int, int] = {0: 0}
    queue = [0]
    for state in queue:
        for child in edges[state].values():
            if child not in order:
                order[child] = len(order)
                queue.append(child)
    bytes_used = sorted({b for s in queue for b in edges[s]})
    column = np.full(256, len(bytes_used), np.int32)
    column[bytes_used] = np.arange(len(bytes_used))
    below: dict[int, int] = {}
    stack = [0]
    while stack:
        state = stack[-1]
        todo = [c for c in edges[state].values() if c not in below]
        if todo:
            stack += todo
        else:
            below[state] = int(final[state]) + sum(below[c] for c in edges[state].values())
            stack.pop()
    step = np.full((len(order), len(bytes_used) + 1), -1, np.int32)
    skip = np.zeros_like(step)
    for state, k in order.items():
        seen = int(final[state])
        for byte in sorted(edges[state]):
            child = edges[state][byte]
            step[k, column[byte]], skip[k, column[byte]] = order[child], seen
            seen += below[child]
    return {"column": column, "step": step, "skip": skip, "final": np.array([final[s] for s in queue])}


class Lexicon:
    """The automaton and the words' ids, from one memory-mapped file."""

    ARRAYS = ("column", "step", "skip", "final", "first", "ids")

    @staticmethod
    def pack(words: list[bytes], encoder: WordBpe) -> bytes:
        return Lexicon.pack_encoded({w: encoder.encode(w.decode()) for w in words})

    @staticmethod
    def pack_encoded(known: dict[bytes, list[int]]) -> bytes:
        """The file of words with their ids."""
        words = sorted(known)
        arrays = compile_automaton(words)
        ids = [known[w] for w in words]
        arrays["first"] = np.r_[0, np.cumsum([len(x) for x in ids], dtype=np.int64)]
        arrays["ids"] = np.array([i for x in ids for i in x], np.int32)
        out, head = io.BytesIO(), []
        for name in Lexicon.ARRAYS:
            a = np.ascontiguousarray(arrays[name])
            out.write(b"\0" * (-out.tell() % 64))
            head.append((name, a.dtype.str, a.shape, out.tell()))
            out.write(a.tobytes())
        front = json.dumps(head).encode()
        front += b" " * (-(len(front) + 8) % 64)
        return len(front).to_bytes(8, "little") + front + out.getvalue()

    def __init__(self, path: str) -> None:
        place = local_path(path)
        # a store that can't be mapped is read into this worker's memory
        whole = np.memmap(place, np.uint8, "r") if place else np.frombuffer(open_file(path), np.uint8)
        size = int(whole[:8].view("<u8")[0])
        for name, kind, shape, at in json.loads(whole[8 : 8 + size].tobytes()):
            n = int(np.prod(shape)) * np.dtype(kind).itemsize
            setattr(self, name, whole[8 + size + at : 8 + size + at + n].view(kind).reshape(shape))

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Each word's number in the lexicon, -1 if it isn't there."""
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        at = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4)
        size = np.diff(at)
        number = np.full(len(words), -1, np.int64)
        live = np.flatnonzero((size > 0) & (size <= LONGEST))
        state = np.zeros(len(live), np.int32)
        total = np.zeros(len(live), np.int64)
        for k in range(LONGEST + 1):
            done = size[live] == k
            if done.any():
                ok = done & self.final[state]
                number[live[ok]] = total[ok]
                live, state, total = live[~done], state[~done], total[~done]
            if not len(live):
                break
            col = self.column[raw[at[live] + k]]
            total += self.skip[state, col]
            state = self.step[state, col]
            some = state >= 0
            live, state, total = live[some], state[some], total[some]
        return number

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.first[number] : self.first[number + 1]].tolist()


def build_lexicon(docs: DataFrame, tokenizer_path: str, text: str = "text", size: int = LEXICON) -> str:
    """Compiles the most frequent words of all texts, as many whole steps of frequency as
    ``size`` holds; returns the file's path."""
    encoder = tokenizer_of(tokenizer_path)
    counts = word_counts(docs, text, list(encoder.special)).where((F.length("word") <= LONGEST) & (F.col("n") > 1))
    # Steps of a sixteenth of an octave: the whole histogram is some hundred rows.
    counts = written(counts.withColumn("step", F.floor(F.log2("n") * 16).cast("int")), "words")
    least, found = None, 0
    for row in sorted(counts.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        found += row["count"]
        if found > size:
            break
        least = row["step"]
    known: dict[bytes, list[int]] = {}
    if least is not None:
        spark = docs.sparkSession

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = tokenizer_of(tokenizer_path)
            for batch in batches:
                ids = [own.encode(w.decode()) for w in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

        top = counts.where(F.col("step") >= least).select("word").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        found = top.mapInArrow(encode, "word binary, ids array<int>").toArrow()  # at most ``size`` short words
        known = dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))
    path = f"{shared_dir(docs.sparkSession, 'lexicon')}/words.mat"
    write_file(path, Lexicon.pack_encoded(known))
    return path


class Encoder:
    """Words to (tokens, ids as text, decoded text): the lexicon first, merges for the rest. ASCII
    words are looked up in lower case, which the tokenizer gives them anyway."""

    def __init__(self, tokenizer_path: str, lexicon_path: str) -> None:
        self.bpe, self.lexicon = tokenizer_of(tokenizer_path), Lexicon(lexicon_path)
        self.known, self.rest = {}, Memory(REMEMBERED)
        self.special = list(self.bpe.special)

    def _shown(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), self.bpe.decode(ids)

    def words(self, names: pa.Array) -> list[tuple[int, str, str]]:
        out = []
        names = lower_words(names, self.special)
        for word, number in zip(names.to_pylist(), self.lexicon.numbers(names).tolist(), strict=True):
            if number >= 0:
                found = self.known.get(number)
                if found is None:
                    found = self.known[number] = self._shown(self.lexicon.ids_of(number))
            else:
                found = self.rest.get(word)
                if found is None:
                    found = self._shown(self.bpe.encode(word.decode()))
                    self.rest.put(word, found)
            out.append(found)
        return out


@lru_cache(maxsize=1)
def encoder_of(tokenizer_path: str, lexicon_path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(tokenizer_path, lexicon_path)


def bpe_digests(docs: DataFrame, tokenizer_path: str, lexicon_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (decimal, joined by a blank) and of the decoded text."""
    return _encoded(docs, tokenizer_path, lexicon_path, doc_id, text, digest=True)


def bpe_encode(docs: DataFrame, tokenizer_path: str, lexicon_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ``ids`` (decimal, joined by a blank) and ``decoded``."""
    return _encoded(docs, tokenizer_path, lexicon_path, doc_id, text, digest=False)


def _encoded(docs: DataFrame, tokenizer_path: str, lexicon_path: str | None, doc_id: str, text: str, digest: bool) -> DataFrame:
    lexicon_path = lexicon_path or build_lexicon(docs, tokenizer_path, text)
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path, lexicon_path)
        show = (lambda x: hashlib.sha256(x.encode()).hexdigest()) if digest else (lambda x: x)
        for batch in batches:
            for part in slices(batch, "text", CUT_BYTES):
                flat, first = cut_words(part.column(1), encoder.special)
                coded = flat.dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False)
                made = encoder.words(coded.dictionary)
                size = np.fromiter((m[0] for m in made), np.int64, len(made))
                ids, decoded = (np.fromiter((m[k] for m in made), object, len(made)) for k in (1, 2))
                if len(size) and not size.all():  # words of odd blanks only have no tokens
                    keep = size[code] > 0
                    first = np.r_[0, np.cumsum(keep)][first]
                    code = code[keep]
                n = np.r_[0, np.cumsum(size[code])][first]
                a, b = ids[code].tolist(), decoded[code].tolist()
                cuts = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                texts = [[show(" ".join(x[i:j])) for i, j in cuts] for x in (a, b)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(n)), *(pa.array(x, pa.string()) for x in texts)], names)

    return narrow.mapInArrow(encode, f"doc_id {kind}, {names[1]} long, {names[2]} string, {names[3]} string")
