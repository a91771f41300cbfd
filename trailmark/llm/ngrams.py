"""Interpolated modified Kneser-Ney scoring with a bigram model.

Counting is a Spark job: tasks count the words and word pairs of their texts, pre-combined, and
a shuffle by bucket adds them up.  The model is a folder of sorted hash arrays below the shared
folder, one file per bucket, which every worker memory-maps: ``hash`` (sorted 64-bit word hashes, whose rank is the
word's number) with ``count``, ``pair`` (sorted keys: two word numbers) with ``times``, and per word ``left`` (distinct words before it)
and ``n1, n2, n3`` (distinct words after it seen once, twice, more often).  A file is written under another name
and moved, so a task that runs again leaves the same file.

    p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) p(w)
    p(w)     = max(left(w) - D'(left(w)), 0) / pairs + g' / (V + 1)

with the usual three discounts per level from the counts of counts; where a count of counts is
zero, the discount is that of no smoothing data: 0.5, 1, 1.5.  Texts start after a start mark and close with
an end token, which is a word like any other.  An unknown word has ``left`` 0; after an unknown word ``p(w | v)`` is ``p(w)``.

The order is 2.  In the test documents 79 % of all trigrams are distinct (5,008,441 of 6,335,541 tokens in 12,000 documents), so a
third order would add about twice the disk that the second takes, and break the limit on it; see the README.

Hot contexts (over a quarter of a bucket's fair share of tokens) have their pairs dealt by both words.
Their list is bounded by the number of buckets.

Defined cases: a null text is empty, its only token the end; rows outside the training fold or with a
null id are scored and not learned from; with nothing to learn from, every word is unknown; repeated rows
count and are scored one by one; an empty table gives no rows; other columns are ignored.
Word numbers have 32 bits: a vocabulary of over 4 billion words is refused, not cut.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import new_path, posix_path

END, START = xxhash.xxh64_intdigest(b" end"), xxhash.xxh64_intdigest(b" start")  # no word has a space
CHUNK = 1 << 20
FLUSH = 6 << 20
BUCKET_BYTES = 16 << 20
DTYPES = {"hash": np.uint64, "count": np.uint32, "pair": np.uint64, "times": np.uint8, "left": np.uint32, "n1": np.uint32, "n2": np.uint32, "n3": np.uint32}


def tokens_of(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks ``text number, token hash, hash of the token before``, of about ``CHUNK`` tokens; a long text spans several."""
    rows, words, befores, size = [], [], [], 0
    for k, text in enumerate(texts):
        found = (text or b"").lower().split()
        own = np.empty(len(found) + 1, np.uint64)
        own[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
        own[-1] = END
        before = np.concatenate((np.array([START], np.uint64), own[:-1]))
        for i in range(0, len(own), CHUNK):
            part = own[i : i + CHUNK]
            rows.append(np.full(len(part), k, np.int64))
            words.append(part)
            befores.append(before[i : i + CHUNK])
            size += len(part)
            if size >= CHUNK:
                yield np.concatenate(rows), np.concatenate(words), np.concatenate(befores)
                rows, words, befores, size = [], [], [], 0
    if size:
        yield np.concatenate(rows), np.concatenate(words), np.concatenate(befores)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    return keys[first], np.add.reduceat(values, first)


def save(folder: str, name: str, bucket: int, array: np.ndarray) -> None:
    """Write one array; counts above the type's range go to a side file of places and values."""
    kind = DTYPES[name]
    top = np.iinfo(kind).max
    path = f"{folder}/{name}-{bucket}.npy"
    over = np.flatnonzero(array > top) if name == "times" or kind == np.uint32 else np.zeros(0, np.int64)
    for to, what in ((path, np.minimum(array, top).astype(kind)), (f"{folder}/{name}-{bucket}.over.npy", np.stack([over, array[over]]).astype(np.int64) if len(over) else None)):
        if what is not None:
            own = f"{to}.{os.getpid()}-{os.urandom(4).hex()}"
            with open(own, "wb") as f:
                np.save(f, what)
            os.replace(own, to)


@dataclass
class Tables:
    """The memory-mapped arrays.  ``offsets``: number of the first word of each bucket, and at the end V + 1 (the start mark is word V)."""

    folder: str
    buckets: int
    offsets: np.ndarray
    hot: np.ndarray

    def __post_init__(self):
        self.maps: dict[tuple[str, int], np.ndarray] = {}

    @property
    def start(self) -> int:
        return int(self.offsets[-1]) - 1

    @property
    def unknown(self) -> int:
        return int(self.offsets[-1])

    def at(self, name: str, bucket: int, places: np.ndarray) -> np.ndarray:
        """Values at places of a bucket's array, as int64."""
        out = self.array(name, bucket)[places].astype(np.int64)
        side = f"{self.folder}/{name}-{bucket}.over.npy"
        if (name, -bucket - 1) not in self.maps:
            self.maps[name, -bucket - 1] = np.load(side) if os.path.exists(side) else np.zeros((2, 0), np.int64)
        over = self.maps[name, -bucket - 1]
        if over.shape[1]:
            k = np.minimum(np.searchsorted(over[0], places), over.shape[1] - 1)
            out = np.where(over[0][k] == places, over[1][k], out)
        return out

    def array(self, name: str, bucket: int) -> np.ndarray:
        if (name, bucket) not in self.maps:
            path = f"{self.folder}/{name}-{bucket}.npy"
            self.maps[name, bucket] = np.load(path, mmap_mode="r") if os.path.exists(path) and os.path.getsize(path) > 128 else np.zeros(0, DTYPES[name])
        return self.maps[name, bucket]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of sorted distinct hashes; unknown words get ``unknown``."""
        out = np.full(len(hashes), self.unknown, np.int64)
        for b, (i, j) in enumerate(self._cut(hashes >> np.uint64(64 - self.buckets.bit_length() + 1) if self.buckets > 1 else np.zeros(len(hashes), np.uint64), np.arange(self.buckets + 1))):
            have = self.array("hash", b)
            if j > i and len(have):
                k = np.minimum(np.searchsorted(have, hashes[i:j]), len(have) - 1)
                out[i:j] = np.where(have[k] == hashes[i:j], self.offsets[b] + k, self.unknown)
        return out

    @staticmethod
    def _cut(sorted_keys: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        at = np.searchsorted(sorted_keys, bounds.astype(sorted_keys.dtype))
        return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))

    def facts(self, name: str, numbers: np.ndarray) -> np.ndarray:
        """Per-word values of sorted word numbers; 0 for unknown words."""
        out = np.zeros(len(numbers), np.int64)
        for b, (i, j) in enumerate(self._cut(numbers, self.offsets)):
            if j > i:
                places = numbers[i:j] - self.offsets[b]
                have = len(self.array(name, b))
                inside = places < have
                out[i:j][inside] = self.at(name, b, places[inside])
        return out

    def bucket_of(self, keys: np.ndarray) -> np.ndarray:
        """The bucket of a pair: by the first word's number, for hot first words by both."""
        first = keys >> np.uint64(32)
        out = first * np.uint64(self.buckets) // np.uint64(self.unknown)
        if len(self.hot):
            hot = np.isin(first, self.hot)
            mixed = keys[hot] * np.uint64(0x9E3779B97F4A7C15)
            out[hot] = (mixed >> np.uint64(33)) % np.uint64(self.buckets)
        return out.astype(np.int64)

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct pairs; 0 for those not seen."""
        out = np.zeros(len(keys), np.int64)
        bucket = self.bucket_of(keys)
        order = np.argsort(bucket, kind="stable")
        for b, (i, j) in enumerate(self._cut(bucket[order], np.arange(self.buckets + 1))):
            have = self.array("pair", b)
            if j > i and len(have):
                where = order[i:j]
                k = np.minimum(np.searchsorted(have, keys[where]), len(have) - 1)
                hit = have[k] == keys[where]
                out[where[hit]] = self.at("times", b, k[hit])
        return out


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes: the length, then each array with its own type."""
    return np.int64(len(arrays[0])).tobytes() + b"".join(a.tobytes() for a in arrays)


def _unblob(data: bytes, *kinds) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _rows(buckets: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


BLOB = "bucket int, blob binary"
#: Counts of counts come as a row of their own, in a bucket that no word has, and are summed by Spark.
TALLY = -1
TALLIES = "t1 long, t2 long, t3 long, t4 long, more long, pairs long, p1 long, p2 long, p3 long, p4 long"


def _word_counts(buckets: int):
    shift = np.uint64(64 - buckets.bit_length() + 1)

    def emit(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        of = (keys >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(keys), np.int64)
        for b, (i, j) in enumerate(Tables._cut(of, np.arange(buckets + 1))):
            if j > i:
                yield _rows([b], [_blob(keys[i:j], counts[i:j].astype(np.uint32))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, words, _ in tokens_of(batch.column(0).to_pylist()):
                keys, counts = np.unique(words, return_counts=True)
                held.append((keys, counts))
                size += len(keys)
                if size > FLUSH:
                    yield from emit(*summed(*map(np.concatenate, zip(*held, strict=True))))
                    held, size = [], 0
        if held:
            yield from emit(*summed(*map(np.concatenate, zip(*held, strict=True))))

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The blobs of one bucket at a time, from rows sorted by bucket."""
    last, held = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != last and held:
                yield last, held
                held = []
            last = bucket
            held.append(blob)
    if held:
        yield last, held


def _save_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _by_bucket(batches):
            parts = [_unblob(x, np.uint64, np.uint32) for x in blobs]
            keys, counts = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64))
            save(folder, "hash", bucket, keys)
            save(folder, "count", bucket, counts)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(keys)]), pa.array([int(counts.sum())])], names=["bucket", "words", "tokens"])

    return run


def _hot_words(shared, least: int):
    """Numbers of the words with ``least`` tokens or more, bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(*shared.value)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                hot = np.flatnonzero(tables.array("count", b) >= least) + tables.offsets[b]
                yield pa.RecordBatch.from_arrays([pa.array(hot.astype(np.int64))], names=["number"])

    return run


def _pair_counts(shared):
    def emit(tables: Tables, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket = tables.bucket_of(keys)
        order = np.argsort(bucket, kind="stable")
        for b, (i, j) in enumerate(Tables._cut(bucket[order], np.arange(tables.buckets + 1))):
            if j > i:
                own = keys[order[i:j]]
                first, runs = np.unique((own >> np.uint64(32)).astype(np.uint32), return_counts=True)
                head = _blob(first, runs.astype(np.uint32))
                body = _blob((own & np.uint64(0xFFFFFFFF)).astype(np.uint32), counts[order[i:j]].astype(np.uint32))
                yield _rows([b], [np.int64(len(head)).tobytes() + head + body])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held, size = Tables(*shared.value), [], 0
        for batch in batches:
            for _, words, befores in tokens_of(batch.column(0).to_pylist()):
                numbers, left = _numbered(tables, words, befores)
                keys, counts = np.unique((left.astype(np.uint64) << np.uint64(32)) | numbers.astype(np.uint64), return_counts=True)
                held.append((keys, counts))
                size += len(keys)
                if size > FLUSH:
                    yield from emit(tables, *summed(*map(np.concatenate, zip(*held, strict=True))))
                    held, size = [], 0
        if held:
            yield from emit(tables, *summed(*map(np.concatenate, zip(*held, strict=True))))

    return run


def _numbered(tables: Tables, words: np.ndarray, befores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of the tokens and of the tokens before them."""
    distinct, place = np.unique(words, return_inverse=True)
    numbers = tables.numbers(distinct)[place]
    left = np.concatenate((numbers[:1], numbers[:-1]))  # right wherever the token before is the row before
    odd = np.concatenate(([True], befores[1:] != words[:-1]))
    if odd.any():
        extra, back = np.unique(befores[odd], return_inverse=True)
        left[odd] = np.where(extra == np.uint64(START), tables.start, tables.numbers(extra))[back]
    return numbers, left


def _save_pairs(shared):
    """Write each bucket's pairs; pass on what its words need: (1, first word, n1, n2, n3) and (2, second word, lefts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(*shared.value)
        for bucket, blobs in _by_bucket(batches):
            keys, counts = [], []
            for x in blobs:
                n = int(np.frombuffer(x, np.int64, 1)[0])
                first, runs = _unblob(x[8 : 8 + n], np.uint32, np.uint32)
                second, times = _unblob(x[8 + n :], np.uint32, np.uint32)
                keys.append((np.repeat(first, runs).astype(np.uint64) << np.uint64(32)) | second)
                counts.append(times)
            keys, counts = summed(np.concatenate(keys), np.concatenate(counts).astype(np.int64))
            save(tables.folder, "pair", bucket, keys)
            save(tables.folder, "times", bucket, counts)
            yield _rows([TALLY], [np.array([(counts == k).sum() for k in (1, 2, 3, 4)], np.int64).tobytes()])
            first, start = np.unique(keys >> np.uint64(32), return_index=True)
            by = [np.add.reduceat(c, start).astype(np.uint32) if len(start) else np.zeros(0, np.uint32) for c in (counts == 1, counts == 2, counts > 2)]
            second, lefts = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
            for kind, numbers, values in ((1, first.astype(np.int64), by), (2, second.astype(np.int64), [lefts.astype(np.uint32)])):
                for b, (i, j) in enumerate(Tables._cut(numbers, tables.offsets)):
                    if j > i:
                        blob = _blob((numbers[i:j] - tables.offsets[b]).astype(np.uint32), *[v[i:j] for v in values])
                        yield _rows([b], [bytes([kind]) + blob])

    return run


def _save_facts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(*shared.value)
        for bucket, blobs in _by_bucket(batches):
            if bucket == TALLY:
                pairs = sum(np.frombuffer(x, np.int64) for x in blobs)
                yield from tally([0] * 6, pairs.tolist())
                continue
            size = int(tables.offsets[bucket + 1] - tables.offsets[bucket])
            facts = {name: np.zeros(size, np.int64) for name in ("n1", "n2", "n3", "left")}
            for x in blobs:
                names = ("n1", "n2", "n3") if x[0] == 1 else ("left",)
                place, *values = _unblob(x[1:], np.uint32, *[np.uint32] * len(names))
                for name, value in zip(names, values, strict=True):
                    facts[name][place] += value  # a blob has a place once
            for name, array in facts.items():
                save(tables.folder, name, bucket, array)
            left = facts["left"]
            yield from tally([*(int((left == k).sum()) for k in (1, 2, 3, 4)), int((left > 2).sum()), int(left.sum())], [0] * 4)

    def tally(words: list[int], pairs: list[int]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in words + pairs], names=[c.split()[0] for c in TALLIES.split(", ")])

    return run


def discounts(t1: int, t2: int, t3: int, t4: int) -> tuple[float, float, float]:
    """The three discounts from the counts of counts."""
    if not (t1 and t2 and t3 and t4):
        return 0.5, 1.0, 1.5
    y = t1 / (t1 + 2 * t2)
    return 1 - 2 * y * t2 / t1, 2 - 3 * y * t3 / t2, 3 - 4 * y * t4 / t3


def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.select([counts == 0, counts == 1, counts == 2], [0.0, d[0], d[1]], d[2]), 0.0)


@dataclass
class Model:
    """The tables' parameters and the scalars of the model; plain values for a broadcast."""

    tables: tuple
    tokens: int
    words: int
    texts: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_gap: float  # g'
    pairs: int

    def parts(self) -> tuple:
        return tuple(vars(self).values())


def fit(texts: DataFrame, text_col: str) -> Model:
    """Count all of ``texts`` into a model below the shared folder."""
    spark = texts.sparkSession
    own = texts.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    sums = own.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("texts")).first()
    buckets = 1 << max(2, int(np.ceil(np.log2(max(1, (sums["bytes"] or 0) / BUCKET_BYTES)))))
    folder = posix_path(new_path(spark, "ngrams"))
    os.makedirs(folder)

    def dealt(df: DataFrame) -> DataFrame:
        """A task a bucket, with the rows of no word's bucket in one of them."""
        return df.repartitionById(buckets, F.pmod("bucket", F.lit(buckets))).sortWithinPartitions("bucket")

    words = dealt(own.mapInArrow(_word_counts(buckets), BLOB))
    found = {r["bucket"]: r for r in words.mapInArrow(_save_words(folder), "bucket int, words long, tokens long").collect()}
    sizes = [found[b]["words"] if b in found else 0 for b in range(buckets)]
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    n_words, tokens = int(offsets[-1]), sum(r["tokens"] for r in found.values())
    if n_words >= 2**32 - 2:
        raise ValueError(f"{n_words} distinct words; word numbers have 32 bits")
    offsets[-1] += 1  # the start mark
    context = spark.sparkContext
    plain = context.broadcast((folder, buckets, offsets, np.zeros(0, np.uint64)))
    least = max(1, -(-tokens // (4 * buckets)))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    hot = [r["number"] for r in every.mapInArrow(_hot_words(plain, least), "number long").collect()]  # 4 * buckets at most
    if sums["texts"] >= least:
        hot.append(n_words)
    shared = context.broadcast((folder, buckets, offsets, np.array(sorted(hot), np.uint64)))
    pairs = dealt(own.mapInArrow(_pair_counts(shared), BLOB))
    facts = dealt(pairs.mapInArrow(_save_pairs(shared), BLOB))
    made = facts.mapInArrow(_save_facts(shared), TALLIES)
    # an aggregate of one row; it runs the job that writes the arrays
    left = made.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in made.columns]).first()
    by_word = discounts(left["t1"], left["t2"], left["t3"], left["t4"])
    gap = (by_word[0] * left["t1"] + by_word[1] * left["t2"] + by_word[2] * left["more"]) / left["pairs"] if left["pairs"] else 1.0
    return Model(shared.value, tokens, n_words, sums["texts"], discounts(left["p1"], left["p2"], left["p3"], left["p4"]), by_word, gap, left["pairs"])


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        t = Tables(*m.tables)
        for batch in batches:
            n = batch.num_rows
            out = {k: np.zeros(n) for k in ("n_tokens", "n_known", "base_score", "score")}
            for rows, words, befores in tokens_of(batch.column(batch.num_columns - 1).to_pylist()):
                numbers, left = _numbered(t, words, befores)
                distinct, place = np.unique(numbers, return_inverse=True)
                counts = t.facts("count", distinct)
                base = np.log10((counts + 0.1) / (m.tokens + 0.1 * (m.words + 1)))
                p1 = (_discounted(t.facts("left", distinct), m.word_discounts) / m.pairs if m.pairs else 0.0) + m.word_gap / (m.words + 1)
                contexts, back = np.unique(left, return_inverse=True)
                total = np.where(contexts == t.start, m.texts, t.facts("count", contexts))
                gap = sum(d * t.facts(name, contexts) for name, d in zip(("n1", "n2", "n3"), m.pair_discounts, strict=True))
                gap = np.where(total > 0, gap / np.maximum(total, 1), 1.0)
                pairs, at = np.unique((left.astype(np.uint64) << np.uint64(32)) | numbers.astype(np.uint64), return_inverse=True)
                seen = _discounted(t.pair_counts(pairs), m.pair_discounts)[at]
                p = seen / np.maximum(total, 1)[back] + gap[back] * np.broadcast_to(p1, len(distinct))[place]
                for key, values in (("n_tokens", None), ("n_known", (counts > 0)[place].astype(float)), ("base_score", base[place]), ("score", np.log10(p))):
                    out[key] += np.bincount(rows, values, n)
            arrays = [pa.array(out[k].astype(np.int64)) for k in ("n_tokens", "n_known")] + [pa.array(out[k]) for k in ("base_score", "score")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """``id, n_tokens, n_known, base_score, score`` of every text; scores are sums of log10 probabilities."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())
    return own.mapInArrow(_scores(shared), f"id {kind}, n_tokens long, n_known long, base_score double, score double")


def perplexity(score_col: Column, n_tokens: Column) -> Column:
    """Per token, from the log10 probability of the text."""
    return F.pow(F.lit(10.0), -score_col / n_tokens)
