"""Hard-negative mining by a two-dimensional block matrix product over integer vectors.

Anchors are cut into row blocks ``i``, all rows into column blocks ``j`` and the dimensions into chunks ``k``.  A task
multiplies one chunk of one pair of blocks to a partial tile of scores; partial tiles are shuffled by ``(i, j)``
and added up in 64-bit integers.  Added tiles are written once and then reduced twice: to the best rows of the anchor's label in
each tile, from which a window per anchor takes its positives, and, given the positives' scores, to the best rows of
other labels in each positive's window, from which a window per anchor and positive takes its negatives.  Only ``k`` rows an anchor
(and positive) leave a tile.

A task holds two chunks of blocks and one tile, or the tiles of one pair of blocks, whose number ``MAX_CHUNKS`` bounds, however long
the vectors, however many rows and however hot a label.  Tiles travel in the narrowest integers that hold them.

The tiles' entries are anchors times rows, which the task asks for; anchors are a stated query set.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; components that a vector lacks
against the longest count as 0, and an empty vector scores 0; components beyond the range of a long become its ends, and sums beyond it wrap as
sums of longs do; rows of one ``id`` are rows of their own, each an anchor and a candidate; a null id is never an anchor and is the
last among equal scores, and rows alike in score and id stand in the order of their numbers; equal scores go by the smaller id; an
anchor without positives, and a positive without negatives, give no rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import finite, written

ANCHOR_BLOCK, ROW_BLOCK = 512, 4_096
DIM_CHUNK, MAX_CHUNKS = 32, 16
MOST_TASKS = 100_000
BROADCAST_ANCHORS = 20_000  # whose windows may be broadcast: about 2 MB



def integers(v: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component."""
    return F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` in 64-bit integers; by doubles where these are exact."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    with np.errstate(over="ignore"):
        return a @ b.T


def packed(tile: np.ndarray) -> tuple[bytes, int]:
    """A tile's bytes in the narrowest integers that hold it, and their width."""
    low, high = int(tile.min(initial=0)), int(tile.max(initial=0))
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return tile.astype(kind).tobytes(), np.dtype(kind).itemsize


def unpacked(data: bytes, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").astype(np.int64).reshape(rows, -1)


PIECE = "b int, k int, rows binary, ids binary, nulls binary, labels binary, data binary, width int"


def _piece(chunk: int) -> Callable[[tuple[Any, ...], pd.DataFrame], pd.DataFrame]:
    """One chunk of a block as one row, its rows by id and number, so that the order of columns settles ties."""

    def run(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "row"], na_position="last")
        x = np.zeros((len(part), chunk), np.int64)
        for i, v in enumerate(part["x"]):
            x[i, : len(v)] = v
        data, width = packed(x)
        nulls = part["id"].isna().to_numpy()
        ids = part["id"].fillna(0).to_numpy(np.int64)
        made = (int(key[0]), int(key[1]), part["row"].to_numpy(np.int64).tobytes(), ids.tobytes(), nulls.tobytes(), part["label"].to_numpy(np.int64).tobytes(), data, width)
        return pd.DataFrame([made], columns=[c.split()[0] for c in PIECE.split(", ")])

    return run


def _pieces(rows: DataFrame, blocks: int, salt: int, chunk: int, chunks: int) -> DataFrame:
    """``rows`` in ``blocks`` packed blocks of ``chunks`` chunks each."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda k: F.struct(k.cast("int").alias("k"), F.slice("x", k * chunk + 1, chunk).alias("x")))
    block = F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(blocks)).cast("int")
    return rows.select("row", "id", F.col("label").cast("long").alias("label"), block.alias("b"), F.inline(parts)).groupBy("b", "k").applyInPandas(_piece(chunk), PIECE)


_SIDE = ("rows", "ids", "nulls", "labels")
TILE = "i int, j int, " + ", ".join(f"{s}_{c} binary" for s in "ab" for c in _SIDE) + ", tile binary, width int"
_TILE = [c.split()[0] for c in TILE.split(", ")]


def _multiply(batches):
    for batch in batches:
        for r in batch.itertuples(index=False):
            a, b = unpacked(r.a_data, r.a_width, len(r.a_rows) // 8), unpacked(r.b_data, r.b_width, len(r.b_rows) // 8)
            tile, width = packed(product(a, b))
            yield pd.DataFrame([(r.i, r.j, *[getattr(r, f"{s}_{c}") for s in "ab" for c in _SIDE], tile, width)], columns=_TILE)


def _add(parts: pd.DataFrame) -> pd.DataFrame:
    first = parts.iloc[0]
    total = np.zeros((len(first["a_rows"]) // 8, len(first["b_rows"]) // 8), np.int64)
    for tile, width in zip(parts["tile"], parts["width"], strict=True):
        total += unpacked(tile, width, len(total))
    data, width = packed(total)
    return parts.iloc[:1].assign(tile=[data], width=width)[_TILE]


def score_tiles(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, dims: int, anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK, dim_chunk: int = DIM_CHUNK) -> DataFrame:
    """Added tiles of the inner products of all ``anchors`` and ``rows`` (``row, id, label, x``)."""
    chunk = max(1, dim_chunk, math.ceil(dims / MAX_CHUNKS))
    chunks, ni, nj = max(1, math.ceil(dims / chunk)), max(1, math.ceil(n_anchors / anchor_block)), max(1, math.ceil(n_rows / row_block))

    def side(pieces: DataFrame, name: str, own: str, other: str, others: int) -> DataFrame:
        facts = [F.col(c).alias(f"{name}_{c}") for c in (*_SIDE, "data", "width")]
        return pieces.select(F.col("b").alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other), "k", *facts)

    a = side(_pieces(anchors, ni, 1, chunk, chunks), "a", "i", "j", nj)
    b = side(_pieces(rows, nj, 2, chunk, chunks), "b", "j", "i", ni)
    tasks = min(ni * nj * chunks, MOST_TASKS)  # a fixed number, as few large rows would be coalesced to one task
    met = a.repartition(tasks, "i", "j", "k").hint("shuffle_hash").join(b.repartition(tasks, "i", "j", "k"), ["i", "j", "k"])
    return met.mapInPandas(_multiply, TILE).groupBy("i", "j").applyInPandas(_add, TILE)


def first_columns(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` highest allowed scores of each row, lesser columns first among equals."""
    masked = np.where(allowed, score, np.iinfo(np.int64).min)
    cut = max(0, masked.shape[1] - k)
    bound = np.partition(masked, cut, axis=1)[:, cut : cut + 1]
    rows, cols = np.nonzero(allowed & (masked >= bound))
    order = np.lexsort((cols, ~score[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], cols[kept]


class _Tile:
    def __init__(self, r):
        def numbers(name: str) -> np.ndarray:
            return np.frombuffer(getattr(r, name), np.int64)

        self.i = r.i
        self.a_rows, self.a_ids, self.a_labels = (numbers(f"a_{c}") for c in ("rows", "ids", "labels"))
        self.b_rows, self.b_ids, self.b_labels = (numbers(f"b_{c}") for c in ("rows", "ids", "labels"))
        self.b_nulls = np.frombuffer(r.b_nulls, bool)
        self.score = unpacked(r.tile, r.width, len(self.a_rows))
        self.same = self.a_labels[:, None] == self.b_labels[None, :]

    def found(self, rows: np.ndarray, cols: np.ndarray) -> dict[str, Any]:
        """The chosen entries as columns."""
        ids = pd.array(self.b_ids[cols], dtype="Int64")
        ids[self.b_nulls[cols]] = pd.NA
        return {"anchor": self.a_rows[rows], "row": self.b_rows[cols], "id": ids, "score": self.score[rows, cols]}


def _positives(k: int):
    def run(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                t = _Tile(r)
                rows, cols = first_columns(t.score, t.same & (t.a_rows[:, None] != t.b_rows[None, :]), k)
                yield pd.DataFrame({"i": t.i, "anchor_id": t.a_ids[rows], **t.found(rows, cols)})

    return run


def _negatives(k: int, low: int, high: int):
    def run(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                t = _Tile(r)
                place = {row: at for at, row in enumerate(t.a_rows.tolist())}
                own: dict[int, list[tuple[int, int, int]]] = {}
                for w in r.windows:
                    own.setdefault(w["rank"], []).append((place[w["anchor"]], -(-low * w["score"] // 100), high * w["score"] // 100))
                for rank, windows in own.items():
                    at = np.array([w[0] for w in windows])
                    least, most = (np.array([w[n] for w in windows])[:, None] for n in (1, 2))
                    score = t.score[at]
                    rows, cols = first_columns(score, ~t.same[at] & (score >= least) & (score <= most), k)
                    yield pd.DataFrame({"rank": rank, **t.found(at[rows], cols)})

    return run


FOUND = "anchor long, row long, id long, score long"


def _first(found: DataFrame, by: tuple[str, ...], k: int, name: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def hard_negatives(
    vectors: DataFrame, id_col: str, vector_col: str, label_col: str, is_anchor: Column, scale: int = 256, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK, dim_chunk: int = DIM_CHUNK, broadcast_anchors: int = BROADCAST_ANCHORS
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, ``rank`` from 1.

    Scores are inner products of ``floor(scale * x)``.  An anchor's positives are its ``n_positives`` best other rows of its
    label; a positive's negatives the ``n_negatives`` best rows of other labels that score from ``low`` to ``high`` hundredths of it.
    """
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    taking = named.where(F.col("label").isNotNull() & finite(F.col("v")))
    # numbers are fixed by the writing
    rows = written(taking.select(F.monotonically_increasing_id().alias("row"), "id", "label", "anchor", integers(F.col("v"), scale).alias("x")), "integers")
    anchors = rows.where(F.col("anchor") & F.col("id").isNotNull())
    n_rows, n_anchors, dims = rows.agg(F.count(F.lit(1)), F.count_if(F.col("anchor") & F.col("id").isNotNull()), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    tiles = written(score_tiles(anchors, rows, n_anchors, n_rows, dims, anchor_block, row_block, dim_chunk), "tiles")
    best = tiles.mapInPandas(_positives(n_positives), f"i int, anchor_id long, {FOUND}")
    positives = written(_first(best, ("anchor",), n_positives, "rank"), "positives")
    windows = positives.groupBy("i").agg(F.collect_list(F.struct("anchor", "rank", "score")).alias("windows"))  # a block's anchors a row
    met = tiles.join(F.broadcast(windows) if n_anchors <= broadcast_anchors else windows, "i")
    chosen = _first(met.mapInPandas(_negatives(n_negatives, low, high), f"rank int, {FOUND}"), ("anchor", "rank"), n_negatives, "place")
    negatives = chosen.select("anchor", "rank", "place", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    asked = positives.select("anchor", "rank", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(asked, ["anchor", "rank"]).select("anchor_id", "positive_id", F.col("place").alias("rank"), "negative_id", "positive_score", "negative_score")
