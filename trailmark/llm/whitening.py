"""Whitening of embeddings by a one-sided Jacobi singular value decomposition.

Components become integers, whose sums are exact.  Each task compresses its centred rows, a block at a time, to the
triangular factor of their QR decomposition; factors are joined ``FAN`` at a time over as many rounds of tasks as it takes
(TSQR), so that neither a task nor the driver holds more than ``FAN`` factors whatever the number of rows.  Plane rotations then make the
columns of the last factor orthogonal: their norms are the singular values, and the product of the rotations holds the principal
directions.  No covariance is formed on the way, so small standard deviations keep their digits.

The factor has the square of the vectors' length, which ``MAX_DIMS`` bounds.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; components that a vector lacks against the
longest count as 0 (as does an empty vector's every one); integers beyond the range of a long become its ends, and a deviation beyond it is
null; a component without variance (a singular value lost in the rounding of the greatest) has a null ``whitened``, and where none has
any, ``identity_error`` is null; equal singular values keep the order that the rotations left; rows that repeat are rows of their own
and ids may be null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import finite, written

FAN = 16  # factors that a task joins
MAX_DIMS = 4_096
_BLOCK_VALUES = 1 << 21  # components of a block of rows
_SAFE = 1 << 62


def integers(v: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component."""
    return F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Lists of longs as rows, filled up with zeros."""
    flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def _blocks(column: pa.Array, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    step = max(1, _BLOCK_VALUES // max(1, dims))
    for s in range(0, len(column), step):
        yield s, _matrix(column.slice(s, step), dims)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: as longs, or as Python's integers where longs could overflow."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if n * most + max(map(abs, sums), default=0) < _SAFE:
        return n * x - np.array(sums, np.int64)[None, :]
    return n * x.astype(object) - np.array(sums, object)[None, :]


def _sums(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _blocks(batch.column(0), dims):
                safe = max(int(x.max(initial=0)), -int(x.min(initial=0))) * len(x) < _SAFE
                total = (x if safe else x.astype(object)).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([[str(int(s)) for s in total]], pa.list_(pa.string()))], names=["s"])

    return run


def _factors(dims: int, n: int, sums: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = np.zeros((0, dims))
        for batch in batches:
            for _, x in _blocks(batch.column(0), dims):
                factor = np.linalg.qr(np.vstack((factor, centred(x, n, sums).astype(float) / n)), mode="r")
        if len(factor):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([factor.tobytes()], pa.binary())], names=["part", "factor"])

    return run


def _joined(dims: int):
    def run(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        stacked = np.vstack([np.frombuffer(f).reshape(-1, dims) for f in parts.sort_values("part")["factor"]])
        return pd.DataFrame({"part": [int(key[0])], "factor": [np.linalg.qr(stacked, mode="r").tobytes()]})

    return run


def tall_factor(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The triangular factor of all centred rows ``x``."""
    dims = len(sums)
    level = written(rows.select("x").mapInArrow(_factors(dims, n, sums), "part long, factor binary"), "factors")
    last = level.agg(F.max("part")).first()[0] or 0
    while last:
        level = level.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInPandas(_joined(dims), "part long, factor binary")
        last //= FAN
    return np.frombuffer(level.select("factor").first()[0]).reshape(-1, dims)


def _rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs in which every two of ``d`` columns meet once."""
    order = list(range(d + d % 2))
    out = []
    for _ in range(len(order) - 1):
        half = len(order) // 2
        met = [(min(p, q), max(p, q)) for p, q in zip(order[:half], reversed(order[half:]), strict=True) if max(p, q) < d]
        out.append((np.array([p for p, _ in met], int), np.array([q for _, q in met], int)))
        order = [order[0], order[-1], *order[1:-1]]
    return out


def jacobi(factor: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and the right singular vectors as columns: rotations of two columns, many disjoint pairs at once,
    until every two are orthogonal to rounding."""
    scale = np.abs(factor).max(initial=0) or 1.0
    by_norm = np.argsort(-np.linalg.norm(factor / scale, axis=0), kind="stable")
    w = (factor / scale)[:, by_norm]
    v = np.eye(w.shape[1])[:, by_norm]
    tolerance = np.finfo(float).eps * math.sqrt(max(w.shape))
    rounds = _rounds(w.shape[1])
    for _ in range(most_sweeps):
        turned = False
        for p, q in rounds:
            a, b, c = ((w[:, i] * w[:, j]).sum(axis=0) for i, j in ((p, p), (q, q), (p, q)))
            on = np.abs(c) > tolerance * np.sqrt(a) * np.sqrt(b)
            if not on.any():
                continue
            turned = True
            p, q, a, b, c = p[on], q[on], a[on], b[on], c[on]
            ratio = (b - a) / (2 * c)
            tangent = np.where(ratio < 0, -1.0, 1.0) / (np.abs(ratio) + np.hypot(1.0, ratio))
            cos = 1 / np.hypot(1.0, tangent)
            sin = cos * tangent
            for m in (w, v):
                m[:, p], m[:, q] = cos * m[:, p] - sin * m[:, q], sin * m[:, p] + cos * m[:, q]
        if not turned:
            break
    else:
        raise RuntimeError(f"columns aren't orthogonal after {most_sweeps} sweeps")
    norms = np.linalg.norm(w, axis=0)
    order = np.argsort(-norms, kind="stable")
    return norms[order] * scale, v[:, order]


@dataclass(frozen=True)
class Fit:
    """``n`` rows with ``sums`` a dimension; ``axes``: a component a row; ``deviations``: standard deviations of all components; ``kept``: how
    many components have variance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    deviations: np.ndarray
    kept: int

    def explained(self) -> list[float]:
        e = self.deviations**2
        return (e[: len(self.axes)] / e.sum()).tolist() if e.sum() > 0 else [0.0] * len(self.axes)


def prepared(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, x`` of the rows that take part."""
    return vectors.where(finite(F.col(vector_col))).select(F.col(id_col).alias("id"), integers(F.col(vector_col), scale).alias("x"))


def fit(rows: DataFrame, components: int = 8, offset: int = 0) -> Fit | None:
    """The principal components of ``rows`` (``x``, to which ``offset`` is added everywhere); None of no rows or no dimension."""
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n or not dims:
        return None
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of {dims} components are longer than {MAX_DIMS}")
    parts = rows.select("x").mapInArrow(_sums(dims), "s array<string>")
    found = parts.select(F.posexplode("s").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    plain = [int(r["s"]) for r in found.orderBy("at").collect()]  # one number a dimension
    values, directions = jacobi(tall_factor(rows, n, plain))
    axes = directions[:, : min(components, dims)].T
    axes = axes / np.linalg.norm(axes, axis=1, keepdims=True)
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]  # the greatest entry is positive
    values = np.concatenate((values, np.zeros(dims - len(values))))
    kept = int((values[: len(axes)] > values[0] * dims * np.finfo(float).eps).sum())
    return Fit(n, [s + n * offset for s in plain], axes, values / math.sqrt(n), kept)


def whiten(rows: DataFrame, model: Fit, offset: int = 0) -> DataFrame:
    """``id, deviation, w``: the sum of squares of ``n * x - sums``, and the whitened components, null without variance."""
    n, sums, axes, deviations, kept = model.n, [s - model.n * offset for s in model.sums], model.axes[: model.kept], model.deviations[: model.kept], model.kept
    empty = len(model.axes) - kept
    kind = rows.schema["id"].dataType.simpleString()

    def squares(d: np.ndarray) -> list[int | None]:
        most = max(int(d.max(initial=0)), -int(d.min(initial=0)))
        total = (d * d if most * most * d.shape[1] < _SAFE else d.astype(object) ** 2).sum(axis=1).tolist()
        return [t if t < 1 << 63 else None for t in total]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, x in _blocks(batch.column(1), len(sums)):
                d = centred(x, n, sums)
                w = (d.astype(float) / n) @ axes.T / deviations
                lists = [[*own, *[None] * empty] for own in w.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, len(x)), pa.array(squares(d), pa.int64()), pa.array(lists, pa.list_(pa.float64()))], names=["id", "deviation", "w"])

    return rows.select("id", "x").mapInArrow(run, f"id {kind}, deviation long, w array<double>")


def identity_error(white: DataFrame, kept: int) -> float | None:
    """The largest absolute entry of the covariance of ``w`` less the identity."""
    if not kept:
        return None
    at = [F.get("w", F.lit(i)) for i in range(kept)]
    means = white.agg(*[F.avg(c) for c in at]).first()
    pairs = [(i, j) for i in range(kept) for j in range(i + 1)]
    found = white.agg(*[F.avg((at[i] - means[i]) * (at[j] - means[j])) for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))


def whitened_components(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 1024, offset: int = 100_000, components: int = 8) -> DataFrame:
    """A row for each row that takes part and each component: ``id, component`` (from 1), ``n, deviation, whitened, explained, identity_error``."""
    rows = prepared(vectors, id_col, vector_col, scale)
    model = fit(rows, components, offset)
    kind = rows.schema["id"].dataType.simpleString()
    if model is None:
        return vectors.sparkSession.createDataFrame([], f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    white = written(whiten(rows, model, offset), "whitened")
    error = identity_error(white, model.kept)
    shares = F.array(*[F.lit(e) for e in model.explained()])
    each = white.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select("id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
