"""Keyframes, revisits and other order-dependent operators on poses ``seq_id, idx, ts, x, y, z, yaw``."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.stored import Block, Stored, met, mount
from trailmark.operators.tables import written


def wrapped_degrees(a: Column, b: Column) -> Column:
    """F-06: signed difference ``b - a`` of two headings, in degrees."""
    return F.degrees(F.atan2(F.sin(b - a), F.cos(b - a)))


def select_keyframes(poses: DataFrame, distance: float, degrees: float, seconds: float, every: bool = False, inclusive: bool = False) -> DataFrame:
    """W-01, W-02: greedy selection against the last selected pose; ``every`` asks for all criteria instead of any.

    A criterion is strict unless ``inclusive``; an infinite limit switches it off for ``any``.  The first pose of a
    sequence is always selected.  Each sequence is read in order as a stream of batches that carries the last
    selected pose, so no sequence is held in memory.  Adds ``selected``.
    """
    names = poses.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in poses.schema) + ", selected boolean"
    at = {c: names.index(c) for c in ("seq_id", "ts", "x", "y", "z", "yaw")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = ts = x = y = z = yaw = cos = sin = None
        square, least = math.copysign(distance * distance, distance), math.cos(math.radians(min(max(degrees, 0.0), 180.0)))
        for batch in batches:
            columns = [batch.column(at[c]) for c in ("seq_id", "ts", "x", "y", "z")]
            turn = batch.column(at["yaw"]).to_numpy(zero_copy_only=False)
            turns = (turn.tolist(), np.cos(turn).tolist(), np.sin(turn).tolist())
            out = []
            for s, t, a, b, c, w, co, si in zip(*(c.to_pylist() for c in columns), *turns, strict=True):
                if s != seq or ts is None:
                    chosen = True
                else:
                    # squares and cosines order as lengths and angles do; near a limit the angle itself decides
                    moved, aligned = (a - x) ** 2 + (b - y) ** 2 + (c - z) ** 2, co * cos + si * sin
                    if abs(moved - square) < 1e-9 * (1 + square) or abs(aligned - least) < 1e-9:
                        d, r = moved**0.5, math.degrees(math.acos(min(1.0, max(-1.0, math.cos(w - yaw)))))
                        far, turned = (d >= distance, r >= degrees) if inclusive else (d > distance, r > degrees)
                    else:
                        far, turned = moved > square, aligned < least
                    late = abs(t - ts) >= seconds if inclusive else abs(t - ts) > seconds
                    chosen = (far and turned and late) if every else (far or turned or late)
                out.append(chosen)
                if chosen:
                    seq, ts, x, y, z, yaw, cos, sin = s, t, a, b, c, w, co, si
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=[*names, "selected"])

    return poses.repartition("seq_id").sortWithinPartitions("seq_id", "idx").mapInArrow(run, schema)


def keyframe_statistics(selected: DataFrame) -> DataFrame:
    """A-24: scans, keyframes, compression ratio and keyframes a second, per sequence."""
    n = F.count(F.lit(1))
    k = F.sum(F.col("selected").cast("long"))
    span = F.max("ts") - F.min("ts")
    return selected.groupBy("seq_id").agg(n.alias("scans"), k.alias("keyframes"), (n / F.greatest(k, F.lit(1))).alias("compression"), F.when(span > 0, k / span).otherwise(F.lit(0.0)).alias("rate"))


def spacing(poses: DataFrame) -> DataFrame:
    """W-05: distance and time from the row before, in sequence order; the first row has none."""
    w = Window.partitionBy("seq_id").orderBy("idx")
    d = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in ("x", "y", "z")), F.lit(0.0)))
    return poses.select("seq_id", "idx", d.alias("d"), (F.col("ts") - F.lag("ts").over(w)).alias("dt"))


def retain_last(poses: DataFrame, most: int) -> DataFrame:
    """W-03, W-12: number rows by age; the newest ``most`` of a sequence are active, older ones frozen."""
    age = F.row_number().over(Window.partitionBy("seq_id").orderBy(F.desc("idx")))
    place = F.row_number().over(Window.partitionBy("seq_id", "frozen").orderBy("idx")) - 1
    return poses.withColumn("frozen", age > most).withColumn("place", place)


def near_pairs(a: DataFrame, b: DataFrame, radius: float, dims: tuple[str, ...] = ("x", "y", "z"), closed: bool = False) -> DataFrame:
    """Pairs of one sequence within a radius, as ``seq_id, i, j, d``: an equi-join on grid cells of that size.

    ``b`` visits the neighbouring cells, the exact distance decides.
    """
    cells = [F.floor(F.col(c) / radius).cast("long").alias(f"_{c}") for c in dims]
    left = a.select("seq_id", F.col("idx").alias("i"), *[F.col(c).alias(f"p{c}") for c in dims], *cells)
    shifts = F.array(*[F.struct(*[F.lit(o).cast("long").alias(f"s{c}") for o, c in zip(offs, dims, strict=True)]) for offs in product((-1, 0, 1), repeat=len(dims))])
    right = b.select("seq_id", F.col("idx").alias("j"), *[F.col(c).alias(f"q{c}") for c in dims], *cells, F.explode(shifts).alias("s"))
    right = right.select("seq_id", "j", *[f"q{c}" for c in dims], *[(F.col(f"_{c}") + F.col(f"s.s{c}")).alias(f"_{c}") for c in dims])
    d = F.sqrt(sum(((F.col(f"p{c}") - F.col(f"q{c}")) ** 2 for c in dims), F.lit(0.0)))
    met = left.join(right, ["seq_id", *[f"_{c}" for c in dims]]).withColumn("d", d)
    return met.where(F.col("d") <= radius if closed else F.col("d") < radius).select("seq_id", "i", "j", "d")


def revisit_queries(poses: DataFrame, radius: float = 5.0, skip: int = 30, parts: int = 8) -> DataFrame:
    """J-02: poses that come within ``radius`` of one at least ``skip`` rows earlier, with the first such row.

    Poses are gathered by small cells (``parts`` to a radius).  Two cells whose boxes lie wholly within the radius
    offer the least row of the one to all rows of the other at once; only pairs of cells that the radius cuts are
    looked at pose by pose, and there only rows before the one on offer, so that laps over the same ground don't
    multiply pairs.
    """
    cells = [F.floor(F.col(c) / (radius / parts)).cast("long").alias(f"c{c}") for c in "xyz"]
    own = poses.select("seq_id", "idx", *"xyz", *cells)
    keys = ["cx", "cy", "cz"]
    boxes = own.groupBy("seq_id", *keys).agg(F.min("idx").alias("first"), *[f(c).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    boxes = boxes.withColumns({f"b{c}": F.floor(F.col(f"c{c}") / parts) for c in "xyz"})
    shifts = F.array(*[F.struct(*[F.lit(o).cast("long").alias(f"s{c}") for o, c in zip(offs, "xyz", strict=True)]) for offs in product((-1, 0, 1), repeat=3)])
    around = boxes.withColumn("s", F.explode(shifts)).select("seq_id", *[(F.col(f"b{c}") + F.col(f"s.s{c}")).alias(f"b{c}") for c in "xyz"], *[F.col(k).alias(f"o_{k}") for k in (*keys, "first", "lox", "hix", "loy", "hiy", "loz", "hiz")])
    met = boxes.join(around, ["seq_id", "bx", "by", "bz"])
    least = F.sqrt(sum((F.greatest(F.col(f"lo{c}") - F.col(f"o_hi{c}"), F.col(f"o_lo{c}") - F.col(f"hi{c}"), F.lit(0.0)) ** 2 for c in "xyz"), F.lit(0.0)))
    most = F.sqrt(sum((F.greatest(F.col(f"hi{c}") - F.col(f"o_lo{c}"), F.col(f"o_hi{c}") - F.col(f"lo{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    met = met.withColumns({"least": least, "most": most}).where(F.col("least") < radius)
    inside = F.col("most") < radius
    offers = met.where(inside).groupBy("seq_id", *keys).agg(F.min("o_first").alias("offer"))
    cut = met.where(~inside).join(offers, ["seq_id", *keys], "left").where(F.col("offer").isNull() | (F.col("o_first") < F.col("offer")))
    i = own.select("seq_id", *keys, F.col("idx").alias("i"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    j = own.select("seq_id", *[F.col(k).alias(f"o_{k}") for k in keys], F.col("idx").alias("j"), *[F.col(c).alias(f"q{c}") for c in "xyz"])
    # the earlier side first: few of its rows come before an offer
    early = cut.select("seq_id", *keys, *[f"o_{k}" for k in keys], "offer").join(j, ["seq_id", *[f"o_{k}" for k in keys]]).where(F.col("offer").isNull() | (F.col("j") < F.col("offer")))
    d = F.sqrt(sum(((F.col(f"p{c}") - F.col(f"q{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    exact = early.join(i, ["seq_id", *keys]).where((F.col("j") <= F.col("i") - skip) & (d < radius)).select("seq_id", "i", F.col("j").alias("match"))
    offered = i.join(offers, ["seq_id", *keys]).where(F.col("offer") <= F.col("i") - skip).select("seq_id", "i", F.col("offer").alias("match"))
    return exact.unionByName(offered).groupBy("seq_id", "i").agg(F.min("match").alias("match"))


def positives(poses: DataFrame, radius: float = 5.0, gap: int = 30) -> DataFrame:
    """J-03: other rows within ``radius`` (closed) and ``gap`` rows or more away, either way."""
    return near_pairs(poses, poses, radius, closed=True).where(F.abs(F.col("i") - F.col("j")) >= gap)


def _cell_pairs(own: DataFrame, radius: float, parts: int, closed: bool) -> DataFrame:
    """Pairs of small cells with rows that may lie within the radius, the ``o_`` side with its number of rows and their ends, and whether all do."""
    keys = ["cx", "cy", "cz"]
    boxes = own.groupBy("seq_id", *keys).agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"), *[f(c).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    boxes = boxes.withColumns({f"b{c}": F.floor(F.col(f"c{c}") / parts) for c in "xyz"})
    shifts = F.array(*[F.struct(*[F.lit(o).cast("long").alias(f"s{c}") for o, c in zip(offs, "xyz", strict=True)]) for offs in product((-1, 0, 1), repeat=3)])
    around = boxes.withColumn("s", F.explode(shifts)).select("seq_id", *[(F.col(f"b{c}") + F.col(f"s.s{c}")).alias(f"b{c}") for c in "xyz"], *[F.col(k).alias(f"o_{k}") for k in (*keys, "n", "first", "last", "lox", "hix", "loy", "hiy", "loz", "hiz")])
    met = boxes.drop("n", "first", "last").join(around, ["seq_id", "bx", "by", "bz"])
    least = F.sqrt(sum((F.greatest(F.col(f"lo{c}") - F.col(f"o_hi{c}"), F.col(f"o_lo{c}") - F.col(f"hi{c}"), F.lit(0.0)) ** 2 for c in "xyz"), F.lit(0.0)))
    most = F.sqrt(sum((F.greatest(F.col(f"hi{c}") - F.col(f"o_lo{c}"), F.col(f"o_hi{c}") - F.col(f"lo{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    met = met.withColumns({"least": least, "most": most}).where(F.col("least") <= radius if closed else F.col("least") < radius)
    return met.select("seq_id", *keys, *[f"o_{k}" for k in (*keys, "n", "first", "last")], (F.col("most") <= radius if closed else F.col("most") < radius).alias("inside"))


def _close_counts(poses: DataFrame, radius: float, gap: int, closed: bool, rows: int = 16384) -> DataFrame:
    """``seq_id, idx, close``: rows fewer than ``gap`` apart within the radius, the row itself included; by stretches of a sequence and what borders on them."""
    part = F.floor(F.col("idx") / rows)
    bordering = F.array_distinct(F.array(part, F.floor((F.col("idx") - (gap - 1)) / rows), F.floor((F.col("idx") + (gap - 1)) / rows)))
    spread = poses.select("seq_id", F.col("idx").cast("long").alias("idx"), *[F.col(c).cast("double").alias(c) for c in "xyz"], part.alias("home"), F.explode(bordering).alias("part"))

    def count(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("idx")
        i, at, n = t["idx"].to_numpy(), t[["x", "y", "z"]].to_numpy(), np.zeros(len(t), np.int64)
        for o in range(len(t)):
            apart = i[o:] - i[: len(i) - o]
            if not len(apart) or apart.min() >= gap:
                break
            d = np.sqrt(((at[o:] - at[: len(at) - o]) ** 2).sum(axis=1))
            near = (apart < gap) & (d <= radius if closed else d < radius)
            n[: len(n) - o] += near
            if o:
                n[o:] += near
        mine = (t["home"] == t["part"]).to_numpy()
        return pd.DataFrame({"seq_id": t["seq_id"].to_numpy()[mine], "idx": i[mine], "close": n[mine]})

    return spread.groupBy("seq_id", "part").applyInPandas(count, f"seq_id {poses.schema['seq_id'].dataType.simpleString()}, idx long, close long")


def near_counts(poses: DataFrame, radius: float, gap: int, closed: bool = False, parts: int = 32) -> DataFrame:
    """``seq_id, idx, n, first, last``: how many rows ``gap`` or more apart lie within the radius, and the ends of all that do, near in order or not.

    Poses are gathered by small cells, as for revisits: a cell wholly within the radius is added as one number, only pairs of cells that the
    radius cuts are looked at pose by pose, and rows fewer than ``gap`` apart are counted along the sequence and taken off.
    """
    keys = ["cx", "cy", "cz"]
    own = poses.select("seq_id", "idx", *"xyz", *[F.floor(F.col(c) / (radius / parts)).cast("long").alias(f"c{c}") for c in "xyz"])
    met = written(_cell_pairs(own, radius, parts, closed), "cell-pairs")
    whole = met.where("inside").groupBy("seq_id", *keys).agg(F.sum("o_n").alias("n"), F.min("o_first").alias("first"), F.max("o_last").alias("last"))
    i = own.select("seq_id", *keys, "idx", *[F.col(c).alias(f"p{c}") for c in "xyz"])
    j = own.select("seq_id", *[F.col(k).alias(f"o_{k}") for k in keys], F.col("idx").alias("j"), *[F.col(c).alias(f"q{c}") for c in "xyz"])
    d = F.sqrt(sum(((F.col(f"p{c}") - F.col(f"q{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    cut = met.where("not inside").select("seq_id", *keys, *[f"o_{k}" for k in keys]).join(j, ["seq_id", *[f"o_{k}" for k in keys]]).join(i, ["seq_id", *keys])
    exact = cut.where(d <= radius if closed else d < radius).groupBy("seq_id", "idx").agg(F.count(F.lit(1)).alias("n"), F.min("j").alias("first"), F.max("j").alias("last"))
    added = own.join(whole, ["seq_id", *keys]).select("seq_id", "idx", "n", "first", "last").unionByName(exact).unionByName(_close_counts(poses, radius, gap, closed).select("seq_id", "idx", (-F.col("close")).alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last")))
    return added.groupBy("seq_id", "idx").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def positive_counts(poses: DataFrame, radius: float = 5.0, gap: int = 30) -> DataFrame:
    """J-03 by row: ``seq_id, i, n, first_j, last_j`` of the rows that ``positives`` lists; rows without any are left out.

    Where the first of all rows within the radius isn't ``gap`` rows before, there is none before, and the first one after is looked up; so for the last.
    Such rows are on the first or the last lap over their ground.
    """
    held = written(near_counts(poses, radius, gap, closed=True).where("n > 0"), "near-counts")
    early, late = F.col("first") <= F.col("idx") - gap, F.col("last") >= F.col("idx") + gap
    asked = held.where(~(early & late)).select("seq_id", "idx").join(poses.select("seq_id", "idx", *"xyz"), ["seq_id", "idx"])
    # the few rows that ask go to the neighbouring cells
    listed = near_pairs(poses, asked, radius, closed=True).where(F.abs(F.col("i") - F.col("j")) >= gap).groupBy("seq_id", F.col("j").alias("idx")).agg(F.min("i").alias("f"), F.max("i").alias("l"))
    both = held.join(listed, ["seq_id", "idx"], "left")
    return both.select("seq_id", F.col("idx").alias("i"), "n", F.coalesce("f", "first").alias("first_j"), F.coalesce("l", "last").alias("last_j"))


def negative_counts(poses: DataFrame, radius: float = 10.0, gap: int = 30) -> DataFrame:
    """J-04: how many rows are ``radius`` or more away and ``gap`` rows apart: all that are apart, less the near ones.

    Neither the complement nor the near ones are listed.
    """
    size = poses.groupBy("seq_id").agg((F.max("idx") + 1).alias("n"))
    near = near_counts(poses, radius, gap).select("seq_id", "idx", F.col("n").alias("near"))
    apart = F.greatest(F.col("idx") - gap + 1, F.lit(0)) + F.greatest(F.col("n") - F.col("idx") - gap, F.lit(0))
    return poses.select("seq_id", "idx").join(size, "seq_id").join(near, ["seq_id", "idx"], "left").select("seq_id", "idx", (apart - F.coalesce("near", F.lit(0))).alias("negatives"))


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, ts: str, payload: str, bucket: float = 3_600.0) -> DataFrame:
    """J-01: for each left row the right row nearest in time; of two as near, the later.  Adds ``match, match_ts``.

    Both sides meet in buckets of time, and the last and first right row of each bucket (a row a bucket) are carried
    to the buckets after and before it, so that no window spans a key.
    """
    tagged = left.select(*left.columns, F.lit(None).cast(right.schema[payload].dataType).alias("_p"), F.lit(None).cast("double").alias("_t"), F.lit(1).alias("_left"))
    other = right.select(*[(F.col(c) if c in (key, ts) else F.lit(None)).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(payload).alias("_p"), F.col(ts).cast("double").alias("_t"), F.lit(0).alias("_left"))
    both = tagged.unionAll(other).withColumn("_bucket", F.floor(F.col(ts) / bucket))
    seen = F.when(F.col("_left") == 0, F.struct("_t", "_p"))
    ends = both.groupBy(key, "_bucket").agg(F.min(seen).alias("first"), F.max(seen).alias("last"))
    w = Window.partitionBy(key).orderBy("_bucket")
    ends = ends.select(key, "_bucket", F.last("last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    inner = Window.partitionBy(key, "_bucket")
    back = inner.orderBy(F.col(ts), F.col("_left"), "_p").rowsBetween(Window.unboundedPreceding, 0)
    ahead = inner.orderBy(F.col(ts), F.col("_left").desc(), "_p").rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumns({"_b": F.last(seen, True).over(back), "_a": F.first(seen, True).over(ahead)}).where("_left = 1")
    found = found.join(ends, [key, "_bucket"], "left").withColumns({"_b": F.coalesce("_b", "_before"), "_a": F.coalesce("_a", "_after")})
    earlier = F.col("_b").isNotNull() & (F.col("_a").isNull() | (F.col(ts) - F.col("_b._t") < F.col("_a._t") - F.col(ts)))
    pick = F.when(earlier, F.col("_b")).otherwise(F.col("_a"))
    return found.withColumn("_m", pick).select(*left.columns, F.col("_m._p").alias("match"), F.col("_m._t").alias("match_ts"))


def temporal_edges(nodes: DataFrame, half: int, mode: str = "both") -> DataFrame:
    """W-04: edges ``src -> dst`` to the ``half`` neighbours before and after; ``past`` or ``future`` sources only."""
    lows, highs = {"both": (-half, half), "past": (-half, -1), "future": (1, half)}[mode]
    size = nodes.groupBy("seq_id").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    steps = F.filter(F.sequence(F.lit(lows), F.lit(highs)), lambda o: o != 0)
    made = nodes.select("seq_id", F.col("idx").alias("dst"), F.explode(steps).alias("o")).join(size, "seq_id")
    src = F.col("dst") + F.col("o")
    return made.where((src >= F.col("first")) & (src <= F.col("last"))).select("seq_id", src.alias("src"), "dst")


DENSE_ROWS, MOST_CELLS = 512, 20_000  # rows about a row from which cells are files, and the most cells


def dense(poses: DataFrame, radius: float) -> Stored | None:
    """The poses in files by cells of ``radius``, where a row's cell holds ``DENSE_ROWS`` or more, so that listing near pairs would multiply rows; else None."""
    if not mount(poses.sparkSession):
        return None
    own = poses.select("seq_id", "idx", *[F.col(c).cast("double").alias(c) for c in "xyz"]).withColumns({f"_{c}": F.floor(F.col(c) / radius).cast("long") for c in "xyz"})
    cells = own.groupBy("seq_id", "_x", "_y", "_z").agg(F.count(F.lit(1)).alias("n"))
    facts = cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("pairs")).first()
    if not facts["rows"] or facts["pairs"] < DENSE_ROWS * facts["rows"] or facts["cells"] > MOST_CELLS:
        return None
    return Stored(own, ("x", "y", "z"), ("seq_id", "_x", "_y", "_z"), vectors=False)


def around(key: tuple) -> list[tuple]:
    """The cells next to one, and itself."""
    return [(key[0], *(k + o for k, o in zip(key[1:], offs, strict=True))) for offs in product((-1, 0, 1), repeat=3)]


def _places(b: Block, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a block by place, within one by ``order``; where each place begins (and the end), and the places."""
    at = np.stack([b.columns[c] for c in "xyz"], axis=1)
    turn = np.lexsort((*order[::-1], at[:, 2], at[:, 1], at[:, 0]))
    new = np.flatnonzero((np.diff(at[turn], axis=0) != 0).any(axis=1)) + 1
    start = np.concatenate(([0], new, [len(turn)]))
    return turn, start, at[turn[start[:-1]]]


def near_places(q: Block, places: np.ndarray, radius: float, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row of the queries, place and distance of those within ``radius`` (closed); poses at one place are compared once."""
    own, start, spots = _places(q)
    for s in range(0, len(spots), max(1, most // max(1, len(places)))):
        some = spots[s : s + max(1, most // max(1, len(places)))]
        d = np.sqrt(sum((some[:, None, c] - places[None, :, c]) ** 2 for c in range(3)))
        spot, place = np.nonzero(d <= radius)
        n = start[s + spot + 1] - start[s + spot]
        for e in np.split(np.arange(len(spot)), np.flatnonzero(np.diff(np.cumsum(n) // most)) + 1):
            m = n[e]
            within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            yield own[np.repeat(start[s + spot[e]], m) + within], np.repeat(place[e], m), np.repeat(d[spot[e], place[e]], m)


class Ordered:
    """A block's rows by place and number: ``i``, and how many of a place come before a number."""

    def __init__(self, b: Block):
        turn, self.start, self.places = _places(b, b.i)
        self.i, self.all = b.i[turn], np.unique(b.i)
        place = np.repeat(np.arange(len(self.places)), np.diff(self.start))
        self.key = place * (len(self.all) + 1) + np.searchsorted(self.all, self.i)

    def before(self, place: np.ndarray, number: np.ndarray, side: str = "left") -> np.ndarray:
        """Where rows of each place with a number less than this end (``right``: up to it)."""
        return np.searchsorted(self.key, place * (len(self.all) + 1) + np.searchsorted(self.all, number, side))


def nearest_places(poses: Stored, radius: float, gap: int, k: int) -> DataFrame:
    """``seq_id, q, c, rank``: of the rows within ``radius`` and ``gap`` apart the ``k`` nearest by distance to nine places, then by number.

    Of the rows at one place only the first ``k`` are ever looked at.
    """

    def work(q: Block, others: Callable[[], Iterator[Block]]) -> Iterator[pd.DataFrame]:
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for b in others():
            held = Ordered(b)
            for row, place, d in near_places(q, held.places, radius):
                end, later = held.before(place, q.i[row] - gap, "right"), held.before(place, q.i[row] + gap)
                early = np.minimum(end - held.start[place], k)
                late = np.minimum(held.start[place + 1] - later, k - early)
                new = []
                for begin, n in ((held.start[place], early), (later, late)):
                    which = np.repeat(np.arange(len(row)), n)
                    at = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    new.append((row[which], held.i[at], np.round(d[which], 9)))
                best = [np.concatenate(x) for x in zip(best, *new, strict=True)]
                order = np.lexsort((best[1], best[2], best[0]))
                rows = best[0][order]
                order = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]
                best = [x[order] for x in best]
        rows = best[0]
        yield pd.DataFrame({"q": q.i[rows], "c": best[1], "rank": (np.arange(len(rows)) - np.searchsorted(rows, rows) + 1).astype(np.int32)})

    return met(poses, poses, work, "q long, c long, rank int", around)


def least_mixed(poses: Stored, radius: float, gap: int, a: int, b: int, modulus: int) -> DataFrame:
    """``seq_id, a, p``: of the rows within ``radius`` and ``gap`` apart the one with the least ``(a * i + b * j) % modulus``, then the smallest number.

    The rows of a place stand in the order of their part of the sum, so that the least is looked up.
    """

    def work(q: Block, others: Callable[[], Iterator[Block]]) -> Iterator[pd.DataFrame]:
        least, found = np.full(len(q), modulus), np.zeros(len(q), np.int64)
        need = (modulus - (a * q.i) % modulus) % modulus
        for other in others():
            part = (b * other.i) % modulus
            turn, start, places = _places(other, part, other.i)
            i, key = other.i[turn], np.repeat(np.arange(len(places)), np.diff(start)) * modulus + part[turn]
            for row, place, _ in near_places(q, places, radius):
                first, n = np.searchsorted(key, place * modulus + need[row]) - start[place], start[place + 1] - start[place]
                left, step = np.arange(len(row)), 0
                while len(left):  # those that a row too near in order keeps from their least look at the next
                    r, g = row[left], place[left]
                    c = i[start[g] + (first[left] + step) % n[left]]
                    apart = np.abs(q.i[r] - c) >= gap
                    r, c = r[apart], c[apart]
                    value = (a * q.i[r] + b * c) % modulus
                    order = np.lexsort((c, value, r))
                    order = order[np.diff(r[order], prepend=-1) != 0]
                    r, c, value = r[order], c[order], value[order]
                    better = (value < least[r]) | ((value == least[r]) & (c < found[r]))
                    least[r[better]], found[r[better]] = value[better], c[better]
                    step += 1
                    left = left[~apart & (step < n[left])]
        got = least < modulus
        yield pd.DataFrame({"a": q.i[got], "p": found[got]})

    return met(poses, poses, work, "a long, p long", around)


def listed(queries: Stored, poses: Stored, radius: float, gap: int, rows: int = 128) -> DataFrame:
    """``seq_id, a, positives, v``: the rows within ``radius`` and ``gap`` apart in order, for ``rows`` queries at once; queries keep their vector."""

    def work(q: Block, others: Callable[[], Iterator[Block]]) -> Iterator[pd.DataFrame]:
        for s in range(0, len(q), rows):
            some, made = q.only(np.arange(s, min(s + rows, len(q)))), []
            for b in others():
                held = Ordered(b)
                for row, place, _ in near_places(some, held.places, radius):
                    n = held.start[place + 1] - held.start[place]
                    at = np.repeat(held.start[place], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    row, j = np.repeat(row, n), held.i[at]
                    far = np.abs(some.i[row] - j) >= gap
                    made.append((row[far], j[far]))
            if made:
                row, j = (np.concatenate(x) for x in zip(*made, strict=True))
                order = np.lexsort((j, row))
                row, j = row[order], j[order]
                own, start = np.unique(row, return_index=True)
                yield pd.DataFrame({"a": some.i[own], "positives": pd.Series(np.split(j, start[1:]) if len(own) else [], dtype=object), "v": pd.Series(list(some.v[own]), dtype=object)})

    return met(queries, poses, work, "a long, positives array<long>, v array<double>", around)


def earlier_near(poses: DataFrame, radius: float, gap: int) -> DataFrame:
    """How many pairs lie within ``radius`` (open), the one ``gap`` rows or more before the other: rows ``n`` to be summed."""
    if (held := dense(poses, radius)) is None:
        return near_pairs(poses, poses, radius).where(F.col("j") <= F.col("i") - gap).agg(F.count(F.lit(1)).alias("n"))

    def work(q: Block, others: Callable[[], Iterator[Block]]) -> Iterator[pd.DataFrame]:
        n = 0
        for b in others():
            own = Ordered(b)
            for row, place, d in near_places(q, own.places, radius):
                row, place = row[d < radius], place[d < radius]
                n += int((own.before(place, q.i[row] - gap, "right") - own.start[place]).sum())
        yield pd.DataFrame({"n": [n]})

    return met(held, held, work, "n long", around)
