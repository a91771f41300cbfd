"""Language identification with string kernels.

Kernel: blended-spectrum presence, the number of distinct character n-grams (of
``MIN_N`` to ``MAX_N`` characters) that two texts share, over the root of the product of
their own numbers.  Nyström: a few landmark texts per language, features
``K(x, landmarks) K(landmarks)^(-1/2)``.  Classifier: one-versus-rest kernel ridge regression
on those features.  Scoring: a block of texts is a presence matrix over the landmarks'
n-grams; its product with the landmarks' matrix is the kernel, and the product of that with
the weights is the scores.

Fitting uses every labelled text, whole, as often as its row is there.  Only the landmarks, the basis of the features, are chosen: ``landmarks``
per language at most (``all_landmarks`` over all languages), spread by a hash of id and text, a row that repeats being one.  Tasks sum the
products of their part of the texts, and a few tasks sum these, so that the driver holds a square of the landmarks' number and no kernel row.
Every text is scored, whole.

Likeness: the share of a text's distinct n-grams of letters and blanks that a landmark has.  It doesn't depend on the number
of labels, as the scores do, whose sum is 1.  ``floor`` of a model is set by all labelled texts: ``SLACK`` times the exact
first percentile of theirs, each landmark being measured against the others.

Defined cases: a null text or one without a letter is ``und`` with score 0; unlabelled
rows and rows with a null id are scored and never learned from; repeated rows are scored one
by one; with nothing to learn from every text is ``und``; an empty table gives no rows.  The
input's columns stay, and the added ones (``lang_pred, score, likeness``) replace any of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import free_name, written
from trailmark.operators.stats import exact_quantiles

MIN_N, MAX_N = 1, 3  # three characters of 21 bits fill one code
UND = "und"
_CHUNK = 1 << 20
_BLOCK = 64
SLACK = 0.8
_PRIOR = 4  # known n-grams that every text is granted, for the sake of very short ones


def grams(text: str) -> np.ndarray:
    """The distinct n-grams of a lower-cased text as sorted codes; very long texts go in chunks."""
    units = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
    out = np.zeros(0, np.uint64)
    for i in range(0, len(units), _CHUNK):
        part = units[i : i + _CHUNK + MAX_N - 1]
        codes = []
        for n in range(MIN_N, MAX_N + 1):
            code = part[: max(0, len(part) - n + 1)].copy()
            for k in range(1, n):
                code = (code << np.uint64(21)) | part[k : len(part) - n + 1 + k]
            codes.append(code)
        found = np.unique(np.concatenate(codes))
        out = np.union1d(out, found) if len(out) else found
    return out


@cache
def _letters() -> np.ndarray:
    """Whether a unit of an n-gram is a letter or a blank (or none, which is 0)."""
    return np.array([True, *[chr(i).isalpha() or i == 0x20 for i in range(0x110000)]])


def lettered_grams(codes: np.ndarray) -> np.ndarray:
    """Which n-grams are of letters and blanks alone."""
    mask = np.uint64((1 << 21) - 1)
    units = ((codes >> np.uint64(21 * k)) & mask for k in range(MAX_N))
    return np.logical_and.reduce([_letters()[u.astype(np.int64)] for u in units])


def likeness_of(known: np.ndarray, codes: np.ndarray) -> float:
    lettered = lettered_grams(codes)
    return float((np.count_nonzero(known & lettered) + _PRIOR) / (np.count_nonzero(lettered) + _PRIOR))


@dataclass
class Model:
    """``vocab``: sorted codes of the landmarks' n-grams; ``presence``: landmarks by n-grams, each row over
    the root of its landmark's own number; ``weights``: landmarks by classes; ``offset``: per class; ``floor``: the least
    likeness of a text in a learned language."""

    classes: list[str]
    vocab: np.ndarray
    presence: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    floor: float = 0.0

    def kernel(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised kernel of texts by landmarks, one matrix product a block, and the texts' likeness."""
        out, like = np.zeros((len(texts), len(self.presence)), np.float64), np.zeros(len(texts))
        for i in range(0, len(texts), _BLOCK):
            part = texts[i : i + _BLOCK]
            block, own = np.zeros((len(part), len(self.vocab)), np.float32), np.ones(len(part))
            for j, text in enumerate(part):
                codes = grams(text)
                at = np.searchsorted(self.vocab, codes)
                at[at == len(self.vocab)] = 0
                known = self.vocab[at] == codes
                block[j, at[known]] = 1
                like[i + j] = likeness_of(known, codes)
                own[j] = max(1, len(codes))
            out[i : i + len(part)] = (block @ self.presence.T) / np.sqrt(own)[:, None]
        return out, like

    def parts(self) -> tuple:
        """Plain values for a broadcast, which executors read without this package."""
        return self.classes, self.vocab, self.presence, self.weights, self.offset, self.floor

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One-versus-rest outputs of texts by classes, and the texts' likeness."""
        k, like = self.kernel(texts)
        return k @ self.weights + self.offset, like


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([label]), pa.array([grams(text).tobytes()], pa.binary())], names=["label", "codes"])


def labelled(docs: DataFrame, id_col: str, text_col: str, label_col: str, fold: Column) -> DataFrame:
    """``label, key, text`` of all rows that are learned from; ``key`` is a hash of id and text."""
    usable = docs.where(fold & F.col(label_col).isNotNull() & F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)) & F.col(id_col).isNotNull())
    return usable.select(F.col(label_col).alias("label"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))


def training_sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, fold: Column, per_class: int) -> DataFrame:
    """At most ``per_class`` rows ``label, text, place`` a label, spread by a hash of id and text; ``place`` counts from 1.

    Rows that are alike in all three are one.  Hashes are counted per label first, and a window only sees those
    below the share that holds about four times the sample.
    """
    rows = labelled(docs, id_col, text_col, label_col, fold)
    keys = written(rows.select("label", "key"), "keys")
    sizes = keys.groupBy("label").agg(F.approx_count_distinct("key").alias("n"))  # a row a label
    parts = 1 << 40
    near = keys.join(F.broadcast(sizes), "label").where(F.pmod("key", F.lit(parts)) <= F.lit(4.0 * per_class * parts) / F.greatest("n", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.pmod("key", F.lit(parts)), "key"))
    chosen = near.select("label", "key").distinct().withColumn("place", place).where(F.col("place") <= per_class)
    # per_class rows a label, so the chosen keys are few and may be broadcast
    return written(rows.join(F.broadcast(chosen), ["label", "key"]).dropDuplicates(["label", "key"]).select("label", "key", "text", "place"), "sample")


SUMS = ("kk", "ky", "k1", "y1")
MOMENTS = "n long, kk binary, ky binary, k1 binary, y1 binary, likes array<double>"


def _moments(shared, classes: list[str], landmarks: set[int]):
    """Per task one row with ``n`` and sums of kernel rows ``k`` and their outer products, with themselves and with the labels; and per batch one
    with the ``likes`` of texts that are no landmarks."""

    def row(n: int | None, sums: list, likes: np.ndarray | None) -> pa.RecordBatch:
        packed = [pa.array([None if x is None else np.ascontiguousarray(x).tobytes()], pa.binary()) for x in sums]
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *packed, pa.array([likes], pa.list_(pa.float64()))], names=["n", *SUMS, "likes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, width = Model(*shared.value), len(classes), len(shared.value[2])
        n, kk, ky, k1, y1 = 0, np.zeros((width, width)), np.zeros((width, size)), np.zeros(width), np.zeros(size)
        for batch in batches:
            if not batch.num_rows:
                continue
            k, like = held.kernel(batch.column(2).to_pylist())
            y = (np.array(batch.column(0).to_pylist(), object)[:, None] == np.array(classes, object)[None, :]).astype(float)
            n, kk, ky, k1, y1 = n + len(k), kk + k.T @ k, ky + k.T @ y, k1 + k.sum(axis=0), y1 + y.sum(axis=0)
            yield row(None, [None] * len(SUMS), like[[key not in landmarks for key in batch.column(1).to_pylist()]])
        if n:
            yield row(n, [kk, ky, k1, y1], None)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the rows of a task that ``_moments`` made."""
    n, sums = 0, [np.zeros(0)] * len(SUMS)
    for batch in batches:
        for i in range(batch.num_rows):
            found = [np.frombuffer(batch.column(1 + c)[i].as_py()) for c in range(len(SUMS))]
            n, sums = n + batch.column(0)[i].as_py(), [x + y if len(x) else y for x, y in zip(sums, found, strict=True)]
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), *[pa.array([x.tobytes()], pa.binary()) for x in sums]], names=["n", *SUMS])


def fit(docs: DataFrame, id_col: str, text_col: str, label_col: str, fold: Column, landmarks: int = 32, ridge: float = 1e-3, max_classes: int = 200, all_landmarks: int = 512, tasks: int = 16) -> Model | None:
    """Fit on all labelled rows where ``fold`` holds; None if there are none."""
    spark = docs.sparkSession
    sample = training_sample(docs, id_col, text_col, label_col, fold, landmarks)
    classes = sorted(r["label"] for r in sample.select("label").distinct().limit(max_classes + 1).collect())
    if not classes:
        return None
    if len(classes) > max_classes:
        raise ValueError(f"more than {max_classes} labels; the landmarks are bounded for so many")
    landmarks = max(1, min(landmarks, all_landmarks // len(classes)))
    chosen = sample.where(F.col("place") <= landmarks)
    rows = chosen.select("label", "text").mapInArrow(_gram_rows, "label string, codes binary").collect()
    sets = [np.frombuffer(r["codes"], np.uint64) for r in sorted(rows, key=lambda r: (r["label"], bytes(r["codes"])))]
    vocab = np.unique(np.concatenate(sets))
    presence = np.zeros((len(sets), len(vocab)), np.float32)
    for j, codes in enumerate(sets):
        presence[j, np.searchsorted(vocab, codes)] = 1 / np.sqrt(max(1, len(codes)))
    bare = Model(classes, vocab, presence, np.zeros((len(sets), len(classes))), np.zeros(len(classes)))
    shared = spark.sparkContext.broadcast(bare.parts())
    marks = {r["key"] for r in chosen.select("key").collect()}  # as many as landmarks
    parts = written(labelled(docs, id_col, text_col, label_col, fold).select("label", "key", "text").mapInArrow(_moments(shared, classes, marks), MOMENTS), "moments")
    found = parts.where("n is not null").select("n", *SUMS).repartition(tasks).mapInArrow(_added, "n long, kk binary, ky binary, k1 binary, y1 binary").collect()  # a row a task
    n = sum(r["n"] for r in found)
    kk, ky, k1, y1 = (sum(np.frombuffer(r[c]) for r in found) for c in SUMS)
    others = (presence > 0).sum(axis=0)
    likes = [likeness_of(others[np.searchsorted(vocab, codes)] > 1, codes) for codes in sets]
    measured = parts.where("likes is not null").select(F.explode("likes").alias("like"))
    both = measured.unionByName(spark.createDataFrame([(x,) for x in likes], "like double"))
    floor = SLACK * exact_quantiles(both, "like", [0.01])[0]
    values, vectors = np.linalg.eigh(presence.astype(np.float64) @ presence.T.astype(np.float64))
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # K(landmarks)^(-1/2), up to a rotation
    mean, middle = k1 / n @ root, y1 / n
    xx = root.T @ kk.reshape(len(sets), -1) @ root - n * np.outer(mean, mean)
    xy = root.T @ ky.reshape(len(sets), -1) - n * np.outer(mean, middle)
    beta = np.linalg.solve(xx + ridge * n * np.eye(len(mean)), xy)
    return Model(classes, vocab, presence, root @ beta, middle - mean @ beta, floor)


def predict(docs: DataFrame, text_col: str, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``: the largest one-versus-rest output, kept in 0 to 1, and ``likeness``."""
    kept = docs.drop("lang_pred", "score", "likeness")
    if model is None:
        return kept.withColumns({"lang_pred": F.lit(UND), "score": F.lit(0.0), "likeness": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    @F.pandas_udf("lang_pred string, score double, likeness double")
    def of(texts: pd.Series) -> pd.DataFrame:
        m = Model(*shared.value)
        s, like = m.scores(texts.tolist())
        return pd.DataFrame({"lang_pred": np.array(m.classes, object)[s.argmax(axis=1)], "score": np.clip(s.max(axis=1), 0, 1), "likeness": like})

    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    said = free_name(kept, "said")
    # so marked, it runs once a row wherever its columns are used, and no filter moves below it
    scored = kept.withColumn(said, of.asNondeterministic()(F.when(lettered, F.col(text_col)).otherwise(F.lit(""))))
    und = {"lang_pred": F.lit(UND), "score": F.lit(0.0), "likeness": F.lit(0.0)}
    return scored.withColumns({c: F.when(lettered, F.col(said)[c]).otherwise(v) for c, v in und.items()}).drop(said)


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string")) % folds
