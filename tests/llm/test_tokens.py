import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from pricelode.llm import bpe, token_store  # noqa: E402

BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = [
    "a", "b ", " ", "  ", "\n", "\t", " ", "é", "é", "É", "1", "23", "'s", "'", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x85", "　Y", "Σ", "İ", "ß", "***", "!", "...",
    "'Re", "你好", "𝔘", "\x00", "≠", " hello", "World", "don't", "Ã ", " ",
]


def odd_texts(seed, n=1500):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)] + ["!" * 300 + "ab" * 200]


def test_chunked_encoding_equals_the_library():
    texts = odd_texts(1)
    ids, first = token_store.ChunkEncoder(BYTES).encode(pa.array(texts))
    library = Tokenizer.from_file(BYTES)
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_shards_read_back(cases, no_docs, documents):
    library = Tokenizer.from_file(BYTES)
    for docs in (cases, documents):
        manifest = token_store.write_shards(docs, BYTES, shard_tokens=5000)
        rows = sorted(token_store.read_shards(manifest).collect(), key=lambda r: r.start)
        want = [np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()]
        assert sorted((r.n_tokens, r.ids_crc32) for r in rows) == sorted((len(w), zlib.crc32(w.tobytes())) for w in want)
        ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
        assert ids == sorted(ids)
        assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
        assert manifest.count() > 1
    assert token_store.token_store(no_docs, BYTES).count() == 0


@pytest.mark.parametrize("high", [1, 2, 300, 50_257, 200_000])
def test_wavelet_matrix(high):
    rng = np.random.default_rng(high)
    ids = (high * rng.random(3000) ** 3).astype(np.uint32)
    shard = token_store.WaveletShard(token_store.pack_shard([7, None], np.array([100, 3000]), ids))
    assert shard.doc_ids == ["7", None] and shard.all_ids().tolist() == ids.tolist()
    for i in (0, 1, 511, 512, 513, 2047, 2999):
        t = int(ids[i])
        assert shard.access(i) == t and shard.rank(t, i) == int((ids[:i] == t).sum()) and shard.count(t) == int((ids == t).sum())
        assert shard.select(t, shard.rank(t, i)) == i
    assert shard.occurrences(int(ids[5])) == np.flatnonzero(ids == ids[5]).tolist()
    assert shard.count(1 << 20) == 0
    with pytest.raises(IndexError):
        shard.select(int(ids[0]), 3000)


def test_merges_equal_the_library():
    own, library = bpe.WordBpe(WORDS), Tokenizer.from_file(WORDS)
    for t in odd_texts(2):
        found = library.encode(t, add_special_tokens=False)
        assert own.encode(t) == found.ids and own.decode(found.ids) == library.decode(found.ids, skip_special_tokens=False)


def test_automaton_shares_suffixes_and_numbers_words(tmp_path):
    words = sorted({a + b + c for a in ("re", "un", "") for b in ("do", "tie", "lock") for c in ("", "ing", "ed", "able")})
    raw = [w.encode() for w in words]
    arrays = bpe.compile_automaton(raw)
    assert len(arrays["step"]) < 40  # a trie has over 100 states
    (tmp_path / "x").write_bytes(bpe.Lexicon.pack(raw, bpe.WordBpe(WORDS)))
    lexicon = bpe.Lexicon(str(tmp_path / "x"))
    assert lexicon.numbers(pa.array(raw, pa.binary())).tolist() == list(range(len(raw)))
    assert lexicon.numbers(pa.array([b"", b"red", b"reds", b"zzz", b"\xff", b"do" * 40], pa.binary())).tolist() == [-1] * 6
    assert lexicon.ids_of(0) == bpe.WordBpe(WORDS).encode(words[0])
    assert bpe.compile_automaton([])["step"].shape[0] == 1


def test_lexicon_takes_whole_steps_of_frequency(spark):
    text = " ".join(["often"] * 40 + ["seldom", "rarely"] * 3 + ["once"])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    known = lambda size: bpe.Lexicon(bpe.build_lexicon(docs, WORDS, size=size)).numbers(pa.array([b"often", b"rarely", b"seldom", b"once"], pa.binary())).tolist()
    assert known(10) == [0, 1, 2, -1] and known(2) == [0, -1, -1, -1] and known(0) == [-1] * 4


def test_digests_equal_the_library(cases, no_docs, documents):
    library = Tokenizer.from_file(WORDS)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for docs in (cases, documents):
        want = []
        for r in docs.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            want.append((str(r.doc_id), len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
        assert sorted((str(r[0]), *r[1:]) for r in bpe.bpe_digests(docs, WORDS).collect()) == sorted(want)
    assert bpe.bpe_digests(no_docs, WORDS).count() == 0
    assert bpe.bpe_encode(cases.where("doc_id = 5"), WORDS).first().decoded == "one</w> two</w> three</w>"


def test_repeated_special_tokens_equal_the_library(spark):
    """Words with a special token's string that are frequent enough for the lexicon."""
    library = Tokenizer.from_file(WORDS)
    texts = ["a <|endoftext|> b", "<|endoftext|> x<|startoftext|>y", "x<|startoftext|>y x<|startoftext|>y", "B<|ENDOFTEXT|> B<|ENDOFTEXT|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_tokens, r.ids, r.decoded) for r in bpe.bpe_encode(docs, WORDS).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert found[i] == (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)), t


def test_capitals_are_served_by_the_automaton(spark):
    """The share of all words that the automaton serves, capitals included; it holds no word that occurs once."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = bpe.build_lexicon(documents, WORDS)
    encoder = bpe.Encoder(WORDS, path)
    texts = pa.array([r.text or "" for r in documents.select("text").collect()])
    coded = bpe.cut_words(texts, encoder.special)[0].dictionary_encode()
    known = encoder.lexicon.numbers(bpe.lower_words(coded.dictionary, encoder.special)) >= 0
    counts = np.bincount(coded.indices.to_numpy(), minlength=len(known))
    assert counts[known].sum() >= 0.9 * counts.sum()
    low = {w.lower() for w, k in zip(coded.dictionary.to_pylist(), known, strict=True) if k and w.isascii()}
    assert all(k for w, k in zip(coded.dictionary.to_pylist(), known, strict=True) if w.isascii() and w.lower() in low)


def test_lowering_leaves_special_tokens_and_other_scripts():
    words = pa.array([b"The", b"<|ENDOFTEXT|>", "ÄB".encode(), b"", b"X<|endoftext|>", b"A1"], pa.binary())
    found = bpe.lower_words(words, ["<|endoftext|>"])
    assert found.to_pylist() == [b"the", b"<|ENDOFTEXT|>", "ÄB".encode(), b"", b"X<|endoftext|>", b"a1"]
    assert bpe.lower_words(words.slice(5), []).to_pylist() == [b"a1"] and bpe.lower_words(words.slice(6), []).to_pylist() == []


def test_a_text_over_all_slices(spark):
    """9 MB, beside short ones: both encoders against the library."""
    long = "Some words, and other words! " * 320_000
    docs = spark.createDataFrame([(1, "short"), (2, long), (3, None)], "doc_id long, text string").coalesce(1)
    want = np.array([*Tokenizer.from_file(BYTES).encode(long, add_special_tokens=False).ids, 2], "<u4")
    rows = {r.doc_id: r for r in token_store.token_store(docs, BYTES).collect()}
    assert (rows[2].n_tokens, rows[2].ids_crc32) == (len(want), zlib.crc32(want.tobytes())) and rows[3].n_tokens == 1
    ids = Tokenizer.from_file(WORDS).encode(long, add_special_tokens=False).ids
    found = {r.doc_id: r for r in bpe.bpe_digests(docs, WORDS).collect()}
    assert (found[2].n_tokens, found[2].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_ids_of_any_text_and_repeated_ids(spark):
    rows = [("a\nb", "one"), ("\x00", "two"), (None, "three"), ("", "four")] + [("hot", f"text {i % 7}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one part
    manifest = token_store.write_shards(docs, BYTES)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = sorted(token_store.read_shards(manifest, "string").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, "", "\x00", "a\nb"] + ["hot"] * 2000
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1].tolist()]
    assert manifest.where("n_docs > 100").count() > 1  # the hot id is in several parts
