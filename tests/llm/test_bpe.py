"""Byte-level BPE against the library, on whole tables and on odd texts."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from trailmark.llm import bpe, queries
from trailmark.llm.common import table

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.vocabulary_of(PATH, public_tokenizers.PATTERN))


def ids(packed):
    return memoryview(packed).cast("i").tolist()


def test_query_same_as_library(spark, library):
    want = {}
    for r in table(spark, SMALL, "documents").collect():
        own = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op11_byte_bpe(spark, SMALL).collect()}
    assert got == want


def test_random_texts(coder, library):
    rng = random.Random(5)
    parts = ["a", "b", "e", "r", "s", "t", "n", " ", "  ", "\n", "'s", "'ll", "1", "2", "ß", "é", "中", "ا", "\U0001f600", "\U000191a7", "\u0558", "\x1c", "\x85", "-", ".", "the", "ing", "\u00a0", "<|endoftext|>"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 30)))
        assert ids(coder.encode(text)) == library.encode_ordinary(text), text


def test_every_character_and_long_pieces(coder, library):
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    rng = random.Random(6)
    for text in (every, "a" * 20_000, "ab" * 10_000, " " * 20_000 + "x", "".join(rng.choices("etaoin", k=50_000)), "😀" * 5_000):
        assert ids(coder.encode(text)) == library.encode_ordinary(text)


def test_memory_of_pieces_is_bounded(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "_KEPT_PIECES", 8)
    monkeypatch.setattr(bpe, "_KEPT_PAIRS", 8)
    for k in range(200):
        text = f"word{k} longerword{k * 7919} und so weiter{k}"
        assert ids(coder.encode(text)) == library.encode_ordinary(text)
    assert len(coder.seen) + len(coder.old) < 40 and len(coder.fits) <= 8


def test_tokens_that_no_merge_reaches():
    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 256, b"abcz": 257, b"zz": 258}
    made = bpe.tables(ranks)
    assert not made["reached"][257] and made["reached"][258]
    own = bpe.Coder(made | {"pattern": bpe.spelled_out(r"\S+|\s+")})
    theirs = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abcz", "abczabcz", "zzzzz", "xabcz abcz"):
        assert ids(own.encode(text)) == theirs.encode_ordinary(text), text


def test_ranks_must_ascend_along_merges():
    with pytest.raises(ValueError, match="higher rank"):
        bpe.tables({bytes([i]): i for i in range(256)} | {b"abc": 256, b"bc": 257})


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, "One two.", 9), (1, "One two.", 9), (None, None, None), (3, "", 1), (4, "word " * 40_000, 2)], "doc_id long, text string, ids int")
    made = bpe.decode(bpe.encode(rows, "doc_id", "text", PATH, public_tokenizers.PATTERN), PATH)
    got = sorted(((r["id"] or 0, len(r["ids"]), bytes(r["decoded"]).decode()) for r in made.collect()))
    assert [g[0] for g in got] == [0, 1, 1, 3, 4] and got[0][1:] == got[3][1:] == (0, "") and got[1] == got[2] and got[4][2] == "word " * 40_000
    assert bpe.encode(rows.limit(0), "doc_id", "text", PATH, public_tokenizers.PATTERN).count() == 0
    broken = spark.range(1).select(F.lit(1).alias("doc_id"), F.expr("cast(x'61ff62' as string)").alias("text"))
    back = bpe.decode(bpe.encode(broken, "doc_id", "text", PATH, public_tokenizers.PATTERN), PATH).first()
    assert bytes(back["decoded"]).decode() == "a\ufffdb"
    none = spark.createDataFrame([(1, None), (2, [64, None])], "id long, ids array<int>")
    assert {r["id"]: bytes(r["decoded"]) for r in bpe.decode(none, PATH).collect()} == {1: b"", 2: [t for t, k in bpe.read_ranks(PATH).items() if k == 64][0]}
    with pytest.raises(Exception, match="no token has the id"):
        bpe.decode(spark.createDataFrame([(1, [50_300])], "id long, ids array<int>"), PATH).collect()


def test_unsupported_pattern_and_vocabulary(tmp_path):
    with pytest.raises(ValueError, match="isn't supported"):
        bpe.spelled_out(r"\w+")
    (tmp_path / "few").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="no token for byte"):
        bpe.read_ranks(str(tmp_path / "few"))
