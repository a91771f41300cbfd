"""Exact nearest-neighbour joins, in cells around pivots or in blocks.

Some rows of each sequence are pivots; every row belongs to the cell of the nearest one.  A query first meets the rows of the cells
next to it, which bounds the distance of its ``k``-th neighbour, and then those of each further cell that can hold a nearer row
by the triangle inequality and, for Euclidean distances, by the plane between the two pivots.  No cell that could is left out, so
results are those of comparing everything, and on rows with clusters few pairs are compared.

Within cells, and in sequences of few rows, blocks are compared: queries and base rows are cut into blocks by hash; each task compares one pair
of blocks, a strip of queries at a time, so that its memory is two blocks and one strip whatever the tables' size.  Tasks return the best ``k`` of each query, the pairs
above a floor, or sums over the pairs; a window over ``k`` rows a block settles the first.

On rows without clusters the bounds leave most cells open.  The visits are therefore counted before they are listed; where they would move more
rows than blocks do, blocks are compared instead.  A listed visit is two numbers, and its vector is joined to it afterwards.

Where blocks would move more than ``STORED_BYTES`` and the shared folder is mounted, the rows are dealt into files once (``stored``).  A task then holds a block of
queries and reads the base rows block by block, so that disk follows the rows and not their square, each query's best so far sort out the rest, and one
task says all about its queries.  Absolute distances are bounded by those of sums over neighbouring numbers first.

Whether a table has sequences long enough for cells is counted once when a search is set up; blocks are lazy, and the steps before the last of
a search in cells are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trailmark.operators.stored import Block, Stored, met, mount
from trailmark.operators.tables import discard, written

STRIP = 1 << 21  # pairs that are compared at once; twice as many where they are compared in single precision first
ROUGH_MOST = 1e12  # entries up to which single precision is used
PROBES = 1024  # queries that tell whether most cells stay open
CELL_ROWS = 4096  # rows of a sequence from which cells are used
MOST_PIVOTS = 4096  # of a sequence; a block's worth at most
NEXT_CELLS = 3  # that a query meets first
BLOCK_ROWS, BLOCK_BYTES = 32768, 16 << 20  # of a block of vectors, at most
VISIT_ROWS = 512  # of a block of queries whose visits are listed
PART_BYTES, MOST_PARTS = 24 << 20, 4096  # what a partition of moved rows is to hold, and the most partitions that this makes
STORED_BYTES = 64 << 20  # that blocks would move, from which they are files
STORED_STRIP = 1 << 20  # pairs that are compared at once there, so that they stay in a core's cache
SUMS = 8  # of neighbouring numbers, whose absolute distance is no more than that of the vectors
METRICS = ("cosine", "l2", "l1")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-8)


def _scores(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """The cosine, or minus the Euclidean (``l2``) or the absolute (``l1``) distance; of rows that are unit vectors already for the cosine."""
    if metric == "cosine":
        return q @ b.T
    if metric == "l1":
        out = np.zeros((len(q), len(b)))
        for x, y in zip(q.T, b.T, strict=True):
            out -= np.abs(x[:, None] - y[None, :])
        return out
    squares = (q * q).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * q @ b.T
    return -np.sqrt(np.maximum(squares, 0))


def _ranks(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """What orders as ``_scores`` does, up to rounding: for ``l2`` minus the squares, in one product."""
    if metric != "l2":
        return _scores(q, b, metric)
    qq, bb = (q * q).sum(axis=1)[:, None], (b * b).sum(axis=1)[:, None]
    return np.hstack((2 * q, -qq, np.ones_like(qq))) @ np.hstack((b, np.ones_like(bb), -bb)).T


def _singles(p: np.ndarray, r: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Single-precision vectors whose products are ``_ranks`` up to ``Strip.slack``, where the metric is a product and the numbers allow it."""
    if metric not in ("cosine", "l2") or not all(x.max(initial=0) < ROUGH_MOST and x.min(initial=0) > -ROUGH_MOST for x in (p, r)):
        return None
    if metric == "l2":
        pp, rr = (p * p).sum(axis=1)[:, None], (r * r).sum(axis=1)[:, None]
        p, r = np.hstack((2 * p, -pp, np.ones_like(pp))), np.hstack((r, np.ones_like(rr), -rr))
    return p.astype(np.float32), r.astype(np.float32)


def _absolute(p: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Minus the absolute distances, number by number."""
    out, one = np.zeros((len(p), len(r)), p.dtype), np.empty((len(p), len(r)), p.dtype)
    for x, y in zip(p.T, np.ascontiguousarray(r.T), strict=True):
        np.subtract(x[:, None], y[None, :], out=one)
        np.subtract(out, np.abs(one, out=one), out=out)
    return out


def _sums(x: np.ndarray, center: np.ndarray, groups: int) -> np.ndarray:
    """Sums of ``groups`` stretches of neighbouring numbers; their absolute distance is no more than that of the rows, whatever the ``center``."""
    if x.shape[1] % groups == 0:
        return (x - center).reshape(len(x), groups, -1) @ np.ones(x.shape[1] // groups)
    at = np.unique(np.arange(groups) * x.shape[1] // groups)
    return np.add.reduceat(x - center, at, axis=1)


class Strip:
    """Some queries ``p`` against a block of base rows ``r``: ``score``, rounded to 9 places, and ``raw``, which orders alike up to rounding; both
    are minus infinity where the two mustn't meet or a vector has no number.  Base rows stand by ``j``.

    With ``singles``, ``raw`` is their product, which orders alike up to ``slack``, and only ``scores_at`` gives scores; for ``l1`` it is a bound
    that no score exceeds, up to ``slack``."""

    def __init__(self, i: np.ndarray, j: np.ndarray, p: np.ndarray, r: np.ndarray, metric: str, apart: tuple[int, bool, bool], left: dict[str, np.ndarray], right: dict[str, np.ndarray], singles: tuple[np.ndarray, np.ndarray] | None = None):
        self.i, self.j, self.p, self.r, self.metric, self.left, self.right, self._score, self.rough = i, j, p, r, metric, left, right, None, singles is not None
        self.singles = singles
        if singles and metric == "l1":
            self.raw = _absolute(*singles)
        elif singles:
            self.raw = singles[0] @ singles[1].T
        elif metric == "mixed":  # a fixed mixture of the two numbers that stands for a random order
            self.raw = -((i[:, None] * 7919 + j[None, :] * 104729) % 1000003).astype(float)
        else:
            self.raw = _ranks(p, r, metric)
            if not (np.isfinite(p).all() and np.isfinite(r).all()):
                self.raw[~np.isfinite(self.raw)] = -np.inf
        limit, past_only, exclusive = apart
        low = np.searchsorted(j, i - limit, "left" if exclusive else "right")
        high = np.full(len(i), len(j)) if past_only else np.searchsorted(j, i + limit, "right" if exclusive else "left")
        for at in np.flatnonzero(low < high):
            self.raw[at, low[at] : high[at]] = -np.inf

    def drop(self, where: np.ndarray) -> None:
        self.raw[where], self._score = -np.inf, None

    @property
    def score(self) -> np.ndarray:
        if self._score is None:
            exact = np.where(np.isfinite(self.raw), _scores(self.p, self.r, "l2"), -np.inf) if self.metric == "l2" else self.raw
            self._score = np.round(exact, 9)
        return self._score

    def scores_at(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """``score`` of some pairs."""
        if self.metric != "l2" and not self.rough:
            return np.round(self.raw[rows, cols], 9)
        out, step = np.empty(len(rows)), max(1, STRIP // max(1, self.p.shape[1]))
        for at in (slice(s, s + step) for s in range(0, len(rows), step)):
            p, r = self.p[rows[at]], self.r[cols[at]]
            if self.metric == "l1":
                out[at] = -(np.abs(p - r) @ np.ones(p.shape[1]))
                continue
            both = (p * r).sum(axis=1)
            out[at] = both if self.metric != "l2" else -np.sqrt(np.maximum((p * p).sum(axis=1) + (r * r).sum(axis=1) - 2 * both, 0))
        return np.round(out, 9)

    def reached(self, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the pairs whose ``score`` can be no less than what ``raw`` is at ``bound``."""
        least, kind = np.finfo(self.raw.dtype).min, self.raw.dtype
        floor = np.maximum(bound - self.slack(bound), least).astype(kind)
        if self.rough:
            floor = np.nextafter(floor, kind.type(-np.inf), where=floor > least, out=floor.copy())
        return np.divmod(np.flatnonzero(self.raw >= floor[:, None]), max(1, self.raw.shape[1]))

    def refine(self) -> None:
        """From single to double precision."""
        never = np.isneginf(self.raw)
        self.raw, self.rough = _ranks(self.p, self.r, self.metric), False
        self.raw[never] = -np.inf

    def slack(self, bound: np.ndarray) -> np.ndarray:
        """How far below ``bound`` a ``raw`` can lie whose ``score`` isn't less."""
        if self.rough and self.metric == "l1":
            return 2e-9 + 2.0**-20 * (np.abs(self.singles[0]).sum(axis=1) + np.abs(self.singles[1]).sum(axis=1).max(initial=0))
        if self.rough:  # eight times what single precision does to two sums of so many products
            most = np.sqrt((self.p * self.p).sum(axis=1)) + np.sqrt((self.r * self.r).sum(axis=1).max(initial=0))
            far = np.sqrt(np.maximum(-np.where(np.isfinite(bound), bound, 0), 0)) if self.metric == "l2" else 0
            return 4e-9 * (1 + far) + (self.p.shape[1] + 8) * 2.0**-21 * most**2
        if self.metric != "l2":
            return np.full(len(bound), 2e-9)
        size = (self.p * self.p).sum(axis=1) + (self.r * self.r).sum(axis=1).max()
        return 4e-9 * (1 + np.sqrt(np.maximum(-np.where(np.isfinite(bound), bound, 0), 0))) + 1e-12 * np.nan_to_num(size, nan=0, posinf=0)

    def distance(self) -> np.ndarray:
        """Euclidean distance of the positions ``x, y, z``."""
        return np.sqrt(sum((self.left[c][:, None] - self.right[c][None, :]) ** 2 for c in "xyz"))

    def distance_at(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """``distance`` of some pairs."""
        return np.sqrt(sum((self.left[c][rows] - self.right[c][cols]) ** 2 for c in "xyz"))

    def within(self, radius: float, closed: bool) -> np.ndarray:
        """Which pairs lie within ``radius``: by products in single precision, and by ``distance`` where these can't tell."""
        own, other = (np.stack([x[c] for c in "xyz"], axis=1).astype(float) for x in (self.left, self.right))
        own, other = own - other[0], other - other[0]
        most = np.sqrt((own * own).sum(axis=1).max()) + np.sqrt((other * other).sum(axis=1).max())
        if not most < ROUGH_MOST:
            return self.distance() <= radius if closed else self.distance() < radius
        a, b = _singles(own, other, "l2")
        rough, least = a @ b.T, 13 * 2.0**-21 * (most + radius) ** 2
        near, may = rough >= np.float32(least - radius * radius), rough >= np.float32(-least - radius * radius)
        if np.count_nonzero(near) < np.count_nonzero(may):
            rows, cols = np.divmod(np.flatnonzero(may & ~near), near.shape[1])
            d = self.distance_at(rows, cols)
            near[rows, cols] = d <= radius if closed else d < radius
        return near


def strips(i: np.ndarray, j: np.ndarray, p: np.ndarray, r: np.ndarray, metric: str, apart: tuple[int, bool, bool], mine: dict[str, np.ndarray], theirs: dict[str, np.ndarray], singles: tuple[np.ndarray, np.ndarray] | None, most: int) -> Iterator[tuple[slice, Strip]]:
    """Queries against a block of base rows, both by number, ``most`` pairs at a time."""
    limit, past_only, exclusive = apart
    step = max(1, most // max(1, len(j)))
    for s in range(0, len(i), step):
        at, n = slice(s, s + step), len(j)
        if past_only:  # base rows that none of these queries may meet are at the end
            n = np.searchsorted(j, i[min(s + step, len(i)) - 1] - limit, "left" if exclusive else "right")
        if n:
            yield at, Strip(i[at], j[:n], p[at], r[:n], metric, apart, {c: x[at] for c, x in mine.items()}, {c: x[:n] for c, x in theirs.items()}, singles and (singles[0][at], singles[1][:n]))


def _parts(spark: SparkSession, moved: int) -> int | None:
    """Partitions for so many bytes, where the session's own number of them would hold more than a task should sort at once; else None."""
    wanted = min(MOST_PARTS, -(-moved // PART_BYTES))
    return wanted if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def _blocks(rows: int) -> Column:
    """The number of blocks of a sequence by its rows and the length of their vectors."""
    most = F.greatest(F.lit(1), F.least(F.lit(rows), F.floor(F.lit(BLOCK_BYTES) / (8 * F.greatest(F.max(F.size("v")), F.lit(1))))))
    return F.ceil(F.count(F.lit(1)) / most).cast("int")


def blocked(
    queries: DataFrame, base: DataFrame, work: Callable[[Strip], pd.DataFrame], schema: str, metric: str = "cosine", gap: int | None = None, past_only: bool = False, exclusive: bool = False, extra: tuple[str, ...] = (), query_block: int = 2048, base_block: int = 16384, counted: DataFrame | None = None, rough: bool = False, parts: int | None = None
) -> DataFrame:
    """``seq_id`` and what ``work`` makes of each strip; both tables have ``seq_id, idx, v`` and the ``extra`` columns.

    Only rows of one sequence meet.  ``gap`` drops rows fewer than ``gap`` apart (``exclusive``: up to ``gap`` apart; 0 drops none);
    without it only the row itself is dropped.  ``past_only`` keeps earlier rows, and later ones aren't in the strips of queries that
    they all follow.  ``rough``: ``work`` needs no scores but by ``scores_at``,
    and for the cosine no vectors but unit ones.  ``counted``, if given, has at least as many rows
    a sequence as the queries and is counted in their place.  ``parts``: into how many partitions the blocks are dealt, if not the session's number.
    """
    sizes = (queries if counted is None else counted).groupBy("seq_id").agg(_blocks(query_block).alias("nq"))
    bases = base.groupBy("seq_id").agg(_blocks(base_block).alias("nb"))
    both = sizes.join(bases, "seq_id")  # a row a sequence
    q = queries.select("seq_id", "idx", "v", *extra).join(both, "seq_id").withColumn("qb", F.pmod(F.xxhash64("idx"), F.col("nq")).cast("int"))
    b = base.select("seq_id", "idx", "v", *extra).join(both, "seq_id").withColumn("bb", F.pmod(F.xxhash64("idx"), F.col("nb")).cast("int"))
    # both sides get names of their own, since the tables may be one and the same
    q = q.select(F.col("seq_id").alias("qs"), F.col("qb").alias("q1"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("q2"), F.col("idx").alias("qi"), F.col("v").alias("qv"), *[F.col(c).alias(f"q_{c}") for c in extra])
    b = b.select(F.col("seq_id").alias("bs"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("b1"), F.col("bb").alias("b2"), F.col("idx").alias("bi"), F.col("v").alias("bv"), *[F.col(c).alias(f"b_{c}") for c in extra])
    if parts:
        q, b = q.repartition(parts, "qs", "q1", "q2"), b.repartition(parts, "bs", "b1", "b2")
    shape = f"seq_id {queries.schema['seq_id'].dataType.simpleString()}, {schema}"
    arrow = to_arrow_schema(StructType.fromDDL(shape))
    apart = (1 if gap is None else gap, past_only, exclusive)

    def column(t: pa.Table, name: str) -> np.ndarray:
        return t.column(name).to_numpy()

    def vectors(t: pa.Table, name: str) -> np.ndarray:
        flat = t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
        return flat.reshape(len(t), -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return arrow.empty_table()
        order, turn = np.argsort(column(right, "bi"), kind="stable"), np.argsort(column(left, "qi"), kind="stable")
        i, j, p, r = column(left, "qi")[turn], column(right, "bi")[order], vectors(left, "qv")[turn], vectors(right, "bv")[order]
        mine, theirs = {"v": p, **{c: column(left, f"q_{c}")[turn] for c in extra}}, {"v": r, **{c: column(right, f"b_{c}")[order] for c in extra}}
        if metric == "cosine" and rough:  # both are copies already, which saves two more
            for x in (p, r):
                x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-8)[:, None]
        elif metric == "cosine":
            p, r = _unit(p), _unit(r)
        singles = _singles(p, r, metric) if rough else None
        made = [work(s) for _, s in strips(i, j, p, r, metric, apart, mine, theirs, singles, 2 * STRIP if singles else STRIP)]
        if not made:
            return arrow.empty_table()
        made = pd.concat(made)
        made.insert(0, "seq_id", left.column("qs")[0].as_py())
        pa.default_memory_pool().release_unused()  # of the group before; a worker outlives its task
        return pa.Table.from_pandas(made, arrow, preserve_index=False)

    return q.groupBy("qs", "q1", "q2").cogroup(b.groupBy("bs", "b1", "b2")).applyInArrow(run, shape)


PAIR, PAIR_BYTES = "q long, c long, score double", 64  # and what one takes while it is sorted


def _pairs(s: Strip, rows: np.ndarray, cols: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"q": s.i[rows], "c": s.j[cols], "score": s.scores_at(rows, cols)})


def _drop_near(s: Strip, at_least: float | None, strict: bool) -> None:
    if at_least is not None:
        s.drop(s.within(at_least, strict))


def _length(score: np.ndarray, metric: str) -> np.ndarray:
    """The distance that bounds are taken of: the chord of unit vectors for the cosine."""
    return np.sqrt(np.maximum(2 - 2 * score, 0)) if metric == "cosine" else -score


def _slack(metric: str) -> float:
    """Above what rounding scores to nine places does to a distance."""
    return 1e-4 if metric == "cosine" else 1e-8


def _far(d: np.ndarray, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, own: np.ndarray, metric: str) -> np.ndarray:
    """Lower bounds of the distance from queries to the rows of cells: ``d`` to their pivots, the rows ``low`` to ``high`` from these.

    ``own`` is the place of each query's nearest pivot.
    """
    bound = np.maximum(d - high[None, :], low[None, :] - d)
    if metric != "l1":
        apart = np.sqrt(np.maximum(_scores(pivots, pivots, "l2") ** 2, 1e-300))[own]
        bound = np.maximum(bound, (d * d - (d[np.arange(len(d)), own] ** 2)[:, None]) / (2 * apart) - _slack(metric) * np.maximum(1, d / apart))
    return bound


class Cells:
    """Base rows in cells around pivots, and which cells queries must visit.

    ``placed``: ``seq_id, idx, v, cell, r`` and the extra columns; ``pivots`` with the ``low`` and ``high`` distance of their rows.
    """

    def __init__(self, base: DataFrame, metric: str, extra: tuple[str, ...] = (), cell_rows: int = CELL_ROWS):
        self.metric, self.extra, self.kind = metric, extra, base.schema["seq_id"].dataType.simpleString()
        base = written(base.select("seq_id", "idx", F.col("v").cast("array<double>").alias("v"), *[F.col(c).cast("double").alias(c) for c in extra]), "base")
        sizes = base.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))  # a row a sequence
        wanted = F.when(F.col("n") < cell_rows, F.lit(1)).otherwise(F.least(F.lit(MOST_PIVOTS), F.ceil(F.sqrt("n"))))
        chosen = (F.pmod(F.xxhash64("idx"), F.col("n")) < wanted) & (F.col("n") >= cell_rows) | (F.col("idx") == F.col("first"))
        bare = written(base.join(sizes, "seq_id").where(chosen).select("seq_id", "idx", "v", *extra), "pivots")

        def assign(s: Strip) -> pd.DataFrame:
            at = s.score.argmax(axis=1)
            return pd.DataFrame({"idx": s.i, "cell": s.j[at], "r": _length(s.score[np.arange(len(at)), at], metric), "v": pd.Series(list(s.left["v"]), dtype=object), **{c: s.left[c] for c in extra}})

        columns = "".join(f", {c} double" for c in extra)
        held = base.agg(F.coalesce(F.sum(8 * F.size("v") + 64), F.lit(0)).alias("bytes")).first()["bytes"]
        self.placed = written(blocked(base, bare, assign, f"idx long, cell long, r double, v array<double>{columns}", metric, 0, extra=extra, parts=_parts(base.sparkSession, held)), "placed")
        discard(base)
        spans = self.placed.groupBy("seq_id", F.col("cell").alias("idx")).agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count(F.lit(1)).alias("n"))
        self.pivots = written(bare.join(spans, ["seq_id", "idx"]).withColumn("bound", F.lit(0.0)), "cells")

    def _open(self, queries: DataFrame, bound: Column | None, near: int, made: Callable[[Strip, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
        """What ``made`` says of each strip's cells that are open: the ``near`` nearest, or, with ``bound``, others with a lower bound up to it."""
        metric, bounded = self.metric, bound is not None
        zero = F.lit(0.0)
        held = queries.select("seq_id", "idx", F.col("v").cast("array<double>").alias("v"), zero.alias("low"), zero.alias("high"), (zero if bound is None else bound).alias("bound"), F.lit(0).cast("long").alias("n"))

        def go(s: Strip) -> pd.DataFrame:
            first = np.argsort(-s.score, axis=1, kind="stable")
            seen = np.zeros(s.score.shape, bool)
            np.put_along_axis(seen, first[:, : near or NEXT_CELLS], True, axis=1)
            if bounded:
                far = _far(_length(s.score, metric), s.r, s.right["low"], s.right["high"], first[:, 0], metric)
                open_ = ~(far > s.left["bound"][:, None] + _slack(metric))
                seen = open_ if near else open_ & ~seen
            return made(s, seen)

        return blocked(held, self.pivots, go, schema, metric, 0, extra=("low", "high", "bound", "n"), query_block=VISIT_ROWS)

    def visits(self, queries: DataFrame, bound: Column | None = None, near: int = 0) -> DataFrame:
        """``seq_id, idx, v, cell`` and the extra columns: the ``near`` nearest cells of each query, or, with ``bound``, all others with a lower bound up to it."""

        def pairs(s: Strip, seen: np.ndarray) -> pd.DataFrame:
            rows, cols = np.nonzero(seen)
            return pd.DataFrame({"idx": s.i[rows], "cell": s.j[cols]})

        found = self._open(queries, bound, near, pairs, "idx long, cell long")
        own = queries.select("seq_id", "idx", F.col("v").cast("array<double>").alias("v"), *[F.col(c).cast("double").alias(c) for c in self.extra])
        return written(found.join(own.dropDuplicates(["seq_id", "idx"]), ["seq_id", "idx"]), "visits")

    def worth(self, queries: DataFrame, bound: Column, near: int = 0, query_block: int = BLOCK_ROWS, base_block: int = BLOCK_ROWS, whole: DataFrame | None = None, share: float = 1.0) -> bool:
        """Whether visiting the cells that ``bound`` leaves open moves no more than twice the rows that comparing blocks would.

        Where the queries are but a ``share`` of ``whole``, this says what to expect of the whole.
        """

        def count(s: Strip, seen: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"visits": [int(seen.sum())]})

        visits = self._open(queries, bound, near, count, "visits long").agg(F.coalesce(F.sum("visits"), F.lit(0)).alias("visits"))
        found = visits.crossJoin(self.moved(queries if whole is None else whole, query_block, base_block)).first()
        return found["visits"] <= 2 * share * found["moved"]

    def moved(self, asked: DataFrame, query_block: int, base_block: int) -> DataFrame:
        """What comparing blocks moves, in one row: ``moved`` rows, their ``bytes``, and ``met``: pairs of a query and a block of base rows."""
        queries = asked.groupBy("seq_id").agg(F.count(F.lit(1)).alias("a"), _blocks(query_block).alias("nq"))
        rows = self.placed.groupBy("seq_id").agg(F.count(F.lit(1)).alias("b"), _blocks(base_block).alias("nb"), F.max(F.size("v")).alias("size"))
        each = F.col("a") * F.col("nb") + F.col("b") * F.col("nq")
        sums = {"moved": each, "bytes": each * (8 * F.col("size") + 64), "met": F.col("a") * F.col("nb")}
        return queries.join(rows, "seq_id").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(name) for name, x in sums.items()])

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.concat_ws("|", F.col("seq_id").cast("string"), F.col("cell").cast("string")).alias("seq_id"), F.col("seq_id").alias("sid"), "idx", "v", *self.extra)

    def meet(self, visits: DataFrame, work: Callable[[Strip], pd.DataFrame], schema: str, gap: int | None, past_only: bool, exclusive: bool = False, **blocks) -> DataFrame:
        """``seq_id`` and what ``work`` makes of visiting queries against the cells' rows."""

        def with_sequence(s: Strip) -> pd.DataFrame:
            made = work(s)
            return made.assign(sid=s.left["sid"][0])

        found = blocked(self._keyed(visits), self._keyed(self.placed), with_sequence, f"{schema}, sid {self.kind}", self.metric, gap, past_only, exclusive, ("sid", *self.extra), **blocks)
        return found.drop("seq_id").withColumnRenamed("sid", "seq_id")

    def compared(self, visits: DataFrame) -> DataFrame:
        """How many pairs ``meet`` compares: one row ``pairs``."""
        key = ["seq_id", "cell"]
        asked, rows = visits.groupBy(*key).agg(F.count(F.lit(1)).alias("a")), self.placed.groupBy(*key).agg(F.count(F.lit(1)).alias("b"))
        return asked.join(rows, key).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("pairs"))


def long_sequences(base: DataFrame, metric: str, cell_rows: int) -> bool:
    """Whether cells are worth it: a sequence has ``cell_rows`` rows or more, and the metric bounds distances."""
    return metric in METRICS and bool(base.groupBy("seq_id").count().where(F.col("count") >= cell_rows).head(1))


def _kth(raw: np.ndarray, k: int) -> np.ndarray:
    """A lower bound of each row's ``k``-th largest number: that of the largest of ``k`` or more groups of columns."""
    groups = max(256, 4 * k)
    if raw.shape[1] < 4 * groups:
        return -np.partition(-raw, k - 1, axis=1)[:, k - 1]
    whole = raw.shape[1] // groups * groups
    most = raw[:, :whole].reshape(len(raw), -1, groups).max(axis=1)
    return -np.partition(-most, k - 1, axis=1)[:, k - 1]


def _best(k: int, at_least: float | None, strict: bool) -> Callable[[Strip], pd.DataFrame]:
    def best(s: Strip) -> pd.DataFrame:
        _drop_near(s, at_least, strict)
        few = min(k, len(s.j))
        rows, cols = s.reached(_kth(s.raw, few))
        if s.rough and len(rows) > 4 * few * len(s.i) + 4096:  # many ties, or distances far smaller than the vectors
            s.refine()
            rows, cols = s.reached(_kth(s.raw, few))
        score = s.scores_at(rows, cols)
        order = np.lexsort((s.j[cols], -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        first = np.searchsorted(rows, rows)  # where the query's run begins
        kept = np.arange(len(rows)) - first < k
        return pd.DataFrame({"q": s.i[rows[kept]], "c": s.j[cols[kept]], "score": score[kept]})

    return best


def file_strips(q: Block, b: Block, metric: str, apart: tuple[int, bool, bool], rough: bool = True, most: int = STORED_STRIP) -> Iterator[tuple[slice, Strip]]:
    """``strips`` of two stored blocks; both sides' columns have ``v``."""
    p, r = (_unit(q.v), _unit(b.v)) if metric == "cosine" else (q.v, b.v)
    singles, fine = _singles(p, r, metric) if rough else None, ({}, {})
    if rough and metric == "l1" and np.isfinite(p).all() and np.isfinite(r).all():
        center = r.mean(axis=0)
        singles = tuple(_sums(x, center, SUMS).astype(np.float32) for x in (p, r))
        fine = tuple({"sums": _sums(x, center, 2 * SUMS)} for x in (p, r))
    return strips(q.i, b.i, p, r, metric, apart, {"v": q.v, **q.columns, **fine[0]}, {"v": b.v, **b.columns, **fine[1]}, singles, most)


def _bound(score: np.ndarray, metric: str) -> np.ndarray:
    """The ``raw`` of a score."""
    return -score * score if metric == "l2" else score


def _first_of(rows: np.ndarray, k: int) -> np.ndarray:
    """Which of rows in order are among the first ``k`` of theirs."""
    return np.arange(len(rows)) - np.searchsorted(rows, rows) < k


def _reached(s: Strip, floor: np.ndarray, k: int, at_least: float | None, strict: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of pairs of a strip, among them each row's best ``k`` that score ``floor`` or more."""
    open_ = np.isneginf(floor)
    if open_.any():
        _drop_near(s, at_least, strict)
        few = min(k, len(s.j))
        seeds = np.argpartition(-s.raw[open_], few - 1, axis=1)[:, :few]
        rows = np.repeat(np.flatnonzero(open_), few)
        score = np.where(np.isneginf(s.raw[rows, seeds.ravel()]), -np.inf, s.scores_at(rows, seeds.ravel()))
        floor = floor.copy()
        floor[open_] = score.reshape(-1, few).min(axis=1)
    rows, cols = s.reached(_bound(floor, s.metric))
    if s.rough and s.metric != "l1" and len(rows) > 4 * k * len(s.i) + 4096:  # many ties, or distances far smaller than the vectors
        s.refine()
        rows, cols = s.reached(_bound(floor, s.metric))
    if s.rough and s.metric == "l1" and len(rows) > 64:  # finer sums of those that the bound leaves
        a, b, most = s.left["sums"], s.right["sums"], -floor + 2e-9 + 1e-12 * (np.abs(s.left["sums"]).sum(axis=1) + np.abs(s.right["sums"]).sum(axis=1).max())
        left = np.empty(len(rows), bool)
        for at in (slice(e, e + (1 << 14)) for e in range(0, len(rows), 1 << 14)):
            left[at] = np.abs(a[rows[at]] - b[cols[at]]) @ np.ones(a.shape[1]) <= most[rows[at]]
        rows, cols = rows[left], cols[left]
    if at_least is not None and not open_.any():
        d = s.distance_at(rows, cols)
        far = ~(d <= at_least if strict else d < at_least)
        rows, cols = rows[far], cols[far]
    score = s.scores_at(rows, cols)
    good = score >= floor[rows]
    rows, cols, score = rows[good], cols[good], score[good]
    order = np.lexsort((s.j[cols], -score, rows))
    order = order[_first_of(rows[order], k)]
    return rows[order], cols[order], score[order]


def best_of(q: Block, others: Callable[[], Iterator[Block]], k: int, metric: str, apart: tuple[int, bool, bool], at_least: float | None = None, strict: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the block, number and score of the best ``k`` of each of its queries, in order; the best so far sort out what comes after."""
    row, c, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    floor = np.full(len(q), -np.inf)
    for b in others():
        new = [(row, c, score)]
        for at, s in file_strips(q, b, metric, apart):
            rows, cols, found = _reached(s, floor[at], k, at_least, strict)
            new.append((rows + at.start, s.j[cols], found))
        row, c, score = (np.concatenate(x) for x in zip(*new, strict=True))
        order = np.lexsort((c, -score, row))
        order = order[_first_of(row[order], k)]
        row, c, score = row[order], c[order], score[order]
        last = np.searchsorted(row, np.arange(len(q)), "right")
        whole = last - np.searchsorted(row, np.arange(len(q))) == k
        floor[whole] = score[last[whole] - 1]
    return row, c, score


def _stored_nearest(queries: Stored, base: Stored, k: int, metric: str, apart: tuple[int, bool, bool], at_least: float | None, strict: bool, sieve: Callable | None, first: int | None) -> DataFrame:
    def work(q: Block, others: Callable[[], Iterator[Block]]) -> Iterator[pd.DataFrame]:
        row, c, score = best_of(q, others, k, metric, apart, at_least, strict)
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        if sieve is not None:
            kept = sieve(q.i[row], c, score)
            row, c, score, rank = row[kept], c[kept], score[kept], rank[kept]
        if first is not None:
            kept = _first_of(row, first)
            row, c, score, rank = row[kept], c[kept], score[kept], rank[kept]
        yield pd.DataFrame({"q": q.i[row], "c": c, "score": score, "rank": rank.astype(np.int32)})

    return met(queries, base, work, f"{PAIR}, rank int")


def _sieved(found: DataFrame, sieve: Callable | None, first: int | None) -> DataFrame:
    if sieve is not None:
        found = found.where(sieve(F.col("q"), F.col("c"), F.col("score")))
    if first is not None:
        found = found.withColumn("_n", F.row_number().over(Window.partitionBy("seq_id", "q").orderBy("rank"))).where(F.col("_n") <= first).drop("_n")
    return found


def _ranked(found: DataFrame, k: int, parts: int | None = None) -> DataFrame:
    if parts:
        found = found.repartition(parts, "seq_id", "q")
    rank = F.row_number().over(Window.partitionBy("seq_id", "q").orderBy(F.desc("score"), "c"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def cell_reach(cells: Cells, queries: DataFrame, k: int, work: Callable[[Strip], pd.DataFrame], gap: int | None, past_only: bool, exclusive: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The visits to the cells next to each query, the best ``k`` that they find, and the queries with the distance ``reach`` of the last of these."""
    near = cells.visits(queries, near=NEXT_CELLS)
    first = written(_ranked(cells.meet(near, work, PAIR, gap, past_only, exclusive, rough=True), k), "first")
    last = first.where(F.col("rank") == k).select("seq_id", F.col("q").alias("idx"), F.col("score").alias("last"))
    reach = F.sqrt(F.greatest(2 - 2 * F.col("last"), F.lit(0.0))) if cells.metric == "cosine" else -F.col("last")
    bounded = queries.join(last, ["seq_id", "idx"], "left").withColumn("reach", F.when(F.col("last").isNull(), float("inf")).otherwise(reach))
    return near, first, bounded.drop("last")


def cell_visits(cells: Cells, queries: DataFrame, k: int, work: Callable[[Strip], pd.DataFrame], gap: int | None, past_only: bool, exclusive: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The visits to the cells next to each query, the best ``k`` that they find, and the visits to further cells."""
    near, first, bounded = cell_reach(cells, queries, k, work, gap, past_only, exclusive)
    return near, first, cells.visits(bounded, F.col("reach"))


def nearest(queries: DataFrame, base: DataFrame, k: int, metric: str = "cosine", gap: int | None = None, past_only: bool = False, exclusive: bool = False, at_least: float | None = None, strict: bool = False, query_block: int = BLOCK_ROWS, base_block: int = BLOCK_ROWS, counted: bool = False, cell_rows: int = CELL_ROWS, sieve: Callable | None = None, first: int | None = None) -> DataFrame:
    """The best ``k`` base rows of each query: ``seq_id, q, c, score, rank`` (from 1; ties by the smaller ``c``).

    ``at_least`` keeps base rows whose positions ``x, y, z`` are so far away or farther (``strict``: farther).
    ``counted`` says that the queries are some of the base rows, which are counted in their place.  Sequences of ``cell_rows`` base rows
    or more are searched in cells if their bounds close most of these, and in blocks otherwise; some queries tell that at little cost
    where most stay open, before all queries visit a cell.  Either way every query meets every row that can be among its best, and what is
    found is written.

    ``sieve`` of ``q, c, score`` (arrays or columns) says which of the best to return, and ``first`` how many of those at most a query.
    """
    best, where = _best(k, at_least, strict), () if at_least is None else ("x", "y", "z")
    query_block = min(query_block, max(1, (1 << 20) // k))  # a task returns so many rows
    if long_sequences(base, metric, cell_rows):
        cells = Cells(base, metric, where, cell_rows)
        asked = cells.placed if queries is base else written(queries.select("seq_id", "idx", "v", *where), "asked")
        asked = asked.select("seq_id", "idx", "v", *where)
        total, reach = asked.count(), F.col("reach")
        probes, hopeful = asked.where(F.pmod(F.xxhash64("seq_id", "idx"), F.lit(max(total, 1))) < PROBES), True
        if total > 4 * PROBES and (some := probes.count()):
            bounded = cell_reach(cells, probes, k, best, gap, past_only, exclusive)[2]
            hopeful = cells.worth(bounded, reach, 0, query_block, base_block, asked, some / total)
        if hopeful:
            _, near, bounded = cell_reach(cells, asked, k, best, gap, past_only, exclusive)
            if cells.worth(bounded, reach, 0, query_block, base_block):
                more = cells.meet(cells.visits(bounded, reach), best, PAIR, gap, past_only, exclusive, query_block=query_block, base_block=base_block, rough=True)
                return written(_sieved(_ranked(near.drop("rank").unionByName(more), k), sieve, first).select("seq_id", "q", "c", "score", "rank"), "nearest")
        moves, spark = cells.moved(cells.placed if counted else asked, query_block, base_block).first(), base.sparkSession
        if moves["bytes"] > STORED_BYTES and mount(spark):
            rows = Stored(cells.placed, where)
            own = rows if queries is base else Stored(asked, where)
            discard(cells.placed)
            found = written(_stored_nearest(own, rows, k, metric, (1 if gap is None else gap, past_only, exclusive), at_least, strict, sieve, first), "nearest")
            for x in {rows, own}:
                x.discard()
            return found
        found = blocked(asked, cells.placed, best, PAIR, metric, gap, past_only, exclusive, where, query_block, base_block, cells.placed if counted else None, True, parts=_parts(spark, moves["bytes"]))
        return written(_sieved(_ranked(found, k, _parts(spark, moves["met"] * k * PAIR_BYTES)), sieve, first), "nearest")
    return _sieved(_ranked(blocked(queries, base, best, PAIR, metric, gap, past_only, exclusive, where, query_block, base_block, base if counted else None, True), k), sieve, first)


def _wanted(base: DataFrame) -> bool:
    """Whether comparing all rows of each sequence in blocks would move so much that these should be files."""
    if not mount(base.sparkSession):
        return False
    rows = base.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("size"))
    return rows.agg(F.coalesce(F.sum(F.col("n") * (F.ceil(F.col("n") / 2048) + F.ceil(F.col("n") / 16384)) * (8 * F.col("size") + 64)), F.lit(0))).first()[0] > STORED_BYTES


def _each_strip(queries: Stored, base: Stored, work: Callable[[Strip], pd.DataFrame], schema: str, metric: str, apart: tuple[int, bool, bool]) -> DataFrame:
    """What ``work`` makes of each strip of stored blocks, in single precision first."""

    def every(q: Block, others: Callable[[], Iterator[Block]]) -> Iterator[pd.DataFrame]:
        for b in others():
            for _, s in file_strips(q, b, metric, apart):
                yield work(s)

    return met(queries, base, every, schema)


def _within(queries: DataFrame, base: DataFrame, floor: float, work: Callable[[Strip], pd.DataFrame], schema: str, metric: str, gap: int | None, past_only: bool, extra: tuple[str, ...], cell_rows: int) -> DataFrame:
    """``work`` over at least all pairs with a score of ``floor`` or more."""
    if not long_sequences(base, metric, cell_rows):
        return blocked(queries, base, work, schema, metric, gap, past_only, extra=extra)
    cells = Cells(base, metric, extra, cell_rows)
    reach = float(_length(np.array(floor), metric))
    asked = (cells.placed if queries is base else written(queries.select("seq_id", "idx", "v", *extra), "asked")).select("seq_id", "idx", "v", *extra)
    if not cells.worth(asked, F.lit(reach), 1):
        moves = cells.moved(asked, 2048, 16384).first()["bytes"]
        if moves > STORED_BYTES and metric != "l1" and mount(base.sparkSession):
            rows = Stored(cells.placed, extra)
            own = rows if queries is base else Stored(asked, extra)
            discard(cells.placed)
            return _each_strip(own, rows, work, schema, metric, (1 if gap is None else gap, past_only, False))
        return blocked(asked, cells.placed, work, schema, metric, gap, past_only, extra=extra, parts=_parts(base.sparkSession, moves))
    return cells.meet(cells.visits(asked, F.lit(reach), near=1), work, schema, gap, past_only)


def above(queries: DataFrame, base: DataFrame, floor: float, metric: str = "cosine", gap: int | None = None, past_only: bool = False, cell_rows: int = CELL_ROWS, made: Callable = _pairs, schema: str = PAIR, extra: tuple[str, ...] = ()) -> DataFrame:
    """All pairs with a score of ``floor`` or more: ``seq_id, q, c, score``, or what ``made`` says of a strip and rows and columns of such pairs."""

    def found(s: Strip) -> pd.DataFrame:
        if not s.rough:
            return made(s, *np.nonzero(s.score >= floor))
        bound = np.full(len(s.i), _bound(np.float64(floor), metric))
        rows, cols = s.reached(bound)
        kept = s.raw[rows, cols] > (bound + s.slack(bound))[rows]
        unsure = np.flatnonzero(~kept)  # those that single precision can't tell are scored
        kept[unsure] = s.scores_at(rows[unsure], cols[unsure]) >= floor
        return made(s, rows[kept], cols[kept])

    return _within(queries, base, floor, found, schema, metric, gap, past_only, extra, cell_rows)


def level_counts(nodes: DataFrame, levels: list[float], radius: float, gap: int | None = None, past_only: bool = False, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Per level how many pairs score as much or more, and how many of those lie within ``radius``: ``threshold, n, good``.

    Nodes have positions; pairs are counted and never listed, and those below the lowest level are met only where their cells are.
    """

    def count(s: Strip) -> pd.DataFrame:
        near = s.within(radius, False)
        if not s.rough:
            seen = [s.score >= level for level in levels]
            return pd.DataFrame({"threshold": levels, "n": [int(x.sum()) for x in seen], "good": [int((x & near).sum()) for x in seen]})
        n, good, close, slack = [], [], s.raw[near], float(s.slack(np.zeros(len(s.i))).max())
        for level in levels:  # those that single precision can't tell are scored
            rows, cols = np.divmod(np.flatnonzero((s.raw >= level - slack) & (s.raw < level + slack)), s.raw.shape[1])
            more = s.scores_at(rows, cols) >= level
            n.append(int(np.count_nonzero(s.raw >= level + slack) + more.sum()))
            good.append(int(np.count_nonzero(close >= level + slack) + (more & near[rows, cols]).sum()))
        return pd.DataFrame({"threshold": levels, "n": n, "good": good})

    made = _within(nodes, nodes, min(levels), count, "threshold double, n long, good long", "cosine", gap, past_only, ("x", "y", "z"), cell_rows)
    return made.groupBy("threshold").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))


def _sums_apart(qi: np.ndarray, qv: np.ndarray, bi: np.ndarray, bv: np.ndarray, limit: int, total: np.ndarray) -> None:
    """Adds to ``total`` each query's absolute distances to the rows at least ``limit`` before it; both in order of their numbers.

    Where all rows are before all queries, a number's distances follow from running sums of the sorted numbers; other stretches are halved.
    """
    todo = [(0, len(qi), 0, len(bi))]
    while todo:
        q0, q1, b0, b1 = todo.pop()
        if q0 == q1 or b0 == b1 or bi[b0] > qi[q1 - 1] - limit:
            continue
        if bi[b1 - 1] <= qi[q0] - limit and (b1 - b0) * (q1 - q0) > 256:
            for j in range(qv.shape[1]):
                held, x = np.sort(bv[b0:b1, j]), qv[q0:q1, j]
                sums, at = np.concatenate(([0.0], np.cumsum(held))), np.searchsorted(held, x)
                total[q0:q1] += x * (2 * at - (b1 - b0)) + sums[-1] - 2 * sums[at]
        elif (b1 - b0) * (q1 - q0) <= 4096:
            met_ = bi[None, b0:b1] <= qi[q0:q1, None] - limit
            total[q0:q1] += np.where(met_, -_absolute(qv[q0:q1], bv[b0:b1]), 0).sum(axis=1)
        else:
            q, b = [(q0, (q0 + q1) // 2), ((q0 + q1) // 2, q1)] if q1 - q0 > 1 else [(q0, q1)], [(b0, (b0 + b1) // 2), ((b0 + b1) // 2, b1)] if b1 - b0 > 1 else [(b0, b1)]
            todo += [(*x, *y) for x in q for y in b]


def _off_sums(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    """How much more than that of its ``_sums`` a row's absolute distance to another can be, each side's part."""
    at = np.unique(np.arange(SUMS) * x.shape[1] // SUMS)
    held, size = x - center, np.diff(np.append(at, x.shape[1]))
    return np.abs(held - np.repeat(np.add.reduceat(held, at, axis=1) / size, size, axis=1)).sum(axis=1)


def _summary(q: Block, others: Callable[[], Iterator[Block]], limit: int, past_only: bool) -> Iterator[pd.DataFrame]:
    """``distance_summary`` of a block for absolute distances: sums by sorted numbers, and the ends by bounds that few pairs reach."""
    n, total, least, most = np.zeros(len(q), np.int64), np.zeros(len(q)), np.full(len(q), -np.inf), np.full(len(q), -np.inf)  # ``least`` as a score
    for b in others():
        n += np.searchsorted(b.i, q.i - limit, "right")
        _sums_apart(q.i, q.v, b.i, b.v, limit, total)
        if not past_only:
            n += len(b) - np.searchsorted(b.i, q.i + limit, "left")
            later = np.zeros(len(q))
            _sums_apart(-q.i[::-1], q.v[::-1], -b.i[::-1], b.v[::-1], limit, later)
            total += later[::-1]
        center = b.v.mean(axis=0)
        own, other = _off_sums(q.v, center), _off_sums(b.v, center)
        for at, s in file_strips(q, b, "l1", (limit, past_only, False)):
            rows, _, score = _reached(s, least[at], 1, None, False)
            np.maximum.at(least, rows + at.start, score)
            never, most_here = np.isneginf(s.raw), most[at]
            upper = -s.raw + other[None, : s.raw.shape[1]].astype(s.raw.dtype)
            upper[never] = -np.inf
            if (new := np.isneginf(most_here)).any():
                where = np.flatnonzero(new)
                col = upper[where].argmax(axis=1)
                where, col = where[~never[where, col]], col[~never[where, col]]
                most_here[where] = -s.scores_at(where, col)
            slack = s.slack(np.zeros(len(s.i))) + 2.0**-20 * (own[at] + other.max())
            rows, cols = np.divmod(np.flatnonzero(upper >= np.maximum(most_here - own[at] - slack, np.finfo(upper.dtype).min)[:, None].astype(upper.dtype)), upper.shape[1])
            np.maximum.at(most_here, rows, -s.scores_at(rows, cols))
            most[at] = most_here
    kept = n > 0
    yield pd.DataFrame({"q": q.i[kept], "n": n[kept], "least": -least[kept], "most": most[kept], "mean": total[kept] / n[kept]})


def distance_summary(nodes: DataFrame, metric: str, gap: int | None = None, past_only: bool = False) -> DataFrame:
    """A-14: per query the number, least, largest and mean distance to all rows that it may meet: ``seq_id, q, n, least, most, mean``."""
    if metric == "l1" and _wanted(nodes):
        held = Stored(nodes, ordered=True)
        return met(held, held, lambda q, others: _summary(q, others, 1 if gap is None else gap, past_only), "q long, n long, least double, most double, mean double")

    def facts(s: Strip) -> pd.DataFrame:
        d, met = -s.score, np.isfinite(s.score)
        inside = np.where(met, d, 0.0)
        return pd.DataFrame({"q": s.i, "n": met.sum(axis=1), "least": np.where(met, d, np.inf).min(axis=1), "most": np.where(met, d, -np.inf).max(axis=1), "total": inside.sum(axis=1)})

    made = blocked(nodes, nodes, facts, "q long, n long, least double, most double, total double", metric, gap, past_only).where("n > 0")
    return made.groupBy("seq_id", "q").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), (F.sum("total") / F.sum("n")).alias("mean"))


RANK_ROWS = 1024  # queries whose rows near a rank are held at once


def _at_rank(q: Block, others: Callable[[], Iterator[Block]], place: Callable, metric: str, apart: tuple[int, bool, bool], at_least: float | None, strict: bool, whole: bool = False) -> Iterator[pd.DataFrame]:
    """``by_rank`` of a block: the first base rows tell a range of ``raw`` that holds the place (``whole``: all do), what lies in it is held, and what
    single precision can't tell from the place is scored."""
    n, above_, low, high = (np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), -np.inf), np.full(len(q), np.inf))
    count, width, least = np.zeros(len(q), np.int64), 64, np.finfo(np.float32).min
    raw, at_block, at_col, slack = np.full((len(q), width), -np.inf), np.zeros((len(q), width), np.int32), np.zeros((len(q), width), np.int32), np.zeros(len(q))
    for number, b in enumerate(others()):
        for at, s in file_strips(q, b, metric, apart):
            _drop_near(s, at_least, strict)
            m = _row_counts(s.raw > least)
            n[at] += m
            farthest = np.sqrt((s.p * s.p).sum(axis=1)) + np.sqrt((s.r * s.r).sum(axis=1).max())
            slack[at] = np.maximum(slack[at], s.slack(-farthest * farthest))
            if number == 0 and not whole:
                held = -np.sort(-s.raw, axis=1)
                spot, more = place(m.astype(float)).astype(np.int64), (4 * np.sqrt(m + 1)).astype(np.int64)
                end = np.maximum(m - 1, 0)
                edge = lambda x: held[np.arange(len(m)), np.clip(x, 0, end)]
                high[at], low[at] = np.where(spot - more > 0, edge(spot - more), np.inf), np.where(spot + more < end, edge(spot + more), -np.inf)
            over, under = (x[at][:, None].astype(s.raw.dtype) for x in (high, np.maximum(low, least)))
            past = s.raw > over
            above_[at] += _row_counts(past)
            held = np.flatnonzero((s.raw >= under) ^ past)
            rows, cols = np.divmod(held, s.raw.shape[1])
            spot = count[at][rows] + np.arange(len(rows)) - np.searchsorted(rows, rows)
            if len(spot) and spot.max() >= width:
                more = max(width, int(spot.max()) + 1 - width)
                raw, at_block, at_col = np.pad(raw, ((0, 0), (0, more)), constant_values=-np.inf), np.pad(at_block, ((0, 0), (0, more))), np.pad(at_col, ((0, 0), (0, more)))
                width += more
            rows = rows + at.start
            raw[rows, spot], at_block[rows, spot], at_col[rows, spot] = s.raw.ravel()[held], number, cols
            count += np.bincount(rows, minlength=len(q))
    wanted = place(n.astype(float)).astype(np.int64) - above_
    good = (n > 0) & (wanted >= 0) & (wanted < count)
    line = -np.sort(-raw, axis=1)[np.arange(len(q)), np.clip(wanted, 0, width - 1)]
    good &= (whole | ((line + 2 * slack < high) & (line - 2 * slack > low)))
    lost = (n > 0) & ~good
    band = good[:, None] & (np.abs(raw - np.where(good, line, 0)[:, None]) <= 2 * slack[:, None]) & (np.arange(width) < count[:, None])
    before = above_ + ((raw > (np.where(good, line, 0) + 2 * slack)[:, None]) & (np.arange(width) < count[:, None])).sum(axis=1)
    rows, spots = np.nonzero(band)
    c, score = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    for number, b in enumerate(others()):
        mine = np.flatnonzero(at_block[rows, spots] == number)
        if len(mine):
            col = at_col[rows[mine], spots[mine]]
            c[mine] = b.i[col]
            p, r = (_unit(q.v), _unit(b.v)) if metric == "cosine" else (q.v, b.v)
            score[mine] = _scored(p, r, rows[mine], col, metric)
    order = np.lexsort((c, -score, rows))
    rows, c, score = rows[order], c[order], score[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) == (wanted + above_ - before)[rows]
    yield pd.DataFrame({"q": q.i[rows[kept]], "c": c[kept], "score": score[kept]})
    for s in range(0, int(lost.sum()), 32):  # the first rows misled
        some = np.flatnonzero(lost)[s : s + 32]
        yield from _at_rank(q.only(some), others, place, metric, apart, at_least, strict, True)


def _row_counts(mask: np.ndarray) -> np.ndarray:
    return np.array([np.count_nonzero(row) for row in mask], np.int64)


def _scored(p: np.ndarray, r: np.ndarray, rows: np.ndarray, cols: np.ndarray, metric: str) -> np.ndarray:
    """Scores of some pairs, as ``Strip.scores_at`` has them."""
    s = Strip.__new__(Strip)
    s.p, s.r, s.metric, s.rough = p, r, metric, True
    return s.scores_at(rows, cols)


def by_rank(queries: DataFrame, base: DataFrame, place: Callable, metric: str = "l2", gap: int | None = None, at_least: float | None = None, strict: bool = False, bins: int = 256) -> DataFrame:
    """``seq_id, q, c, score``: of each query's ``n`` rows by distance (ties by the smaller ``c``), the one at ``place(n)`` from 0.

    ``place`` is arithmetic that columns and arrays know.  Three passes over the blocks: the range of distances, counts in ``bins`` bins of it, and the rows of the one bin that holds
    the place; only those are listed.  Blocks in files take one pass in a task.
    """
    where = ("x", "y", "z") if at_least is not None else ()
    if metric != "l1" and _wanted(base):
        rows, own = Stored(base, where), Stored(queries, where, block_rows=RANK_ROWS)
        apart = (1 if gap is None else gap, False, False)
        found = written(met(own, rows, lambda q, others: _at_rank(q, others, place, metric, apart, at_least, strict), PAIR), "ranked")
        rows.discard()
        own.discard()
        return found

    def facts(s: Strip) -> pd.DataFrame:
        _drop_near(s, at_least, strict)
        d, met = -s.score, np.isfinite(s.score)
        return pd.DataFrame({"q": s.i, "n": met.sum(axis=1), "least": d.min(axis=1), "most": np.where(met, d, -np.inf).max(axis=1)})

    spans = blocked(queries, base, facts, "q long, n long, least double, most double", metric, gap, extra=where, counted=base).where("n > 0")
    spans = spans.groupBy("seq_id", "q").agg(F.sum("n").alias("n"), F.min("least").alias("lo"), F.max("most").alias("hi"))
    spans = spans.select("seq_id", F.col("q").alias("idx"), place(F.col("n")).cast("long").alias("wanted"), "lo", F.greatest((F.col("hi") - F.col("lo")) / bins, F.lit(1e-12)).alias("width"))
    plain = base.withColumns({"lo": F.lit(0.0), "width": F.lit(1.0), **{c: F.lit(0).cast("long") for c in ("wanted", "bin", "skip")}})

    def binned(s: Strip) -> np.ndarray:
        _drop_near(s, at_least, strict)
        share = (-s.score - s.left["lo"][:, None]) / s.left["width"][:, None]
        return np.where(np.isfinite(s.score), np.clip(np.floor(np.minimum(share, bins)), 0, bins - 1), -1).astype(np.int64)

    def counts(s: Strip) -> pd.DataFrame:
        b = binned(s)
        rows, _ = np.nonzero(b >= 0)
        n = np.bincount(rows * bins + b[b >= 0], minlength=len(s.i) * bins).reshape(-1, bins)
        row, bin_ = np.nonzero(n)
        return pd.DataFrame({"q": s.i[row], "bin": bin_, "n": n[row, bin_], **{c: s.left[c][row] for c in ("wanted", "lo", "width")}})

    # what a later pass needs travels with the rows, so that no pass runs twice
    held = blocked(queries.join(spans, ["seq_id", "idx"]), plain, counts, "q long, bin long, n long, wanted long, lo double, width double", metric, gap, extra=("lo", "width", "wanted", *where), counted=base)
    held = held.groupBy("seq_id", "q", "bin").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("wanted", "lo", "width")])
    before = F.coalesce(F.sum("n").over(Window.partitionBy("seq_id", "q").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    skip = F.col("wanted") - F.col("before")
    chosen = held.withColumn("before", before).where((skip >= 0) & (skip < F.col("n"))).select("seq_id", F.col("q").alias("idx"), "bin", "lo", "width", skip.alias("skip"))

    def members(s: Strip) -> pd.DataFrame:
        rows, cols = np.nonzero(binned(s) == s.left["bin"][:, None])
        return _pairs(s, rows, cols).assign(skip=s.left["skip"][rows])

    listed = blocked(queries.join(chosen, ["seq_id", "idx"]), plain, members, f"{PAIR}, skip long", metric, gap, extra=("lo", "width", "bin", "skip", *where), counted=base)
    rank = F.row_number().over(Window.partitionBy("seq_id", "q").orderBy(F.desc("score"), "c")) - 1
    return listed.withColumn("rank", rank).where(F.col("rank") == F.col("skip")).select("seq_id", "q", "c", "score")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, norms floored at 1e-8."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-8)) * F.greatest(norm(b), F.lit(1e-8)))
