"""Near-duplicate embeddings: spherical k-means cells and blocked cosine products.

Distinct vectors are numbered first; everything up to the last join goes by that number, so that neither repeated
nor null ids touch a link.  A bounded sample fits the cell centres of a length; every vector has the nearest
centre's cell as home.  A link has cosine >= ``threshold``, so its ends lie within chord ``r`` of each other.  If
their homes ``a`` and ``b`` differ, the plane between the two centres separates them, and one of the two is within
``r / 2`` of it: that one also visits the other's cell.  So each link is met where one end is at home, and none
is missed.

Vectors travel as they came (single precision stays so) in packed pieces of one cell, which are dealt to blocks,
those at home and visitors apart, and each task multiplies one pair of blocks, so memory is two blocks whatever a
cell's size or a vector's length.  Products are taken in single precision first; those that rounding could put on the
wrong side of the threshold are taken again in double.  Tasks return link counts per vector and a spanning forest of
the links instead of pairs.  One vector per component is kept.

The number of cells follows the number of vectors up to ``max_cells``; beyond that cells grow, and with them
the work per vector.  Results are the same for every number of cells.

Defined cases: a vector that is null, empty, zero, or holds a null or a non-finite component links with
nothing and is kept; vectors of unlike lengths never link; equal vectors link with one another; rows of one ``id`` are
vectors of their own; a null id is counted as a link of others and never names a component that has another id,
and where all ids of a component are null, so is ``component_id`` and all are kept; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import written
from trailmark.llm.components import connected_components

SLACK = 1e-9  # of the plane test, far above rounding
_AT_ONCE = 1 << 22  # entries of a product of rows by centres
_HELD = 48 << 20  # bytes of pieces that a placing task holds
_SAMPLE_BYTES, _CENTRE_BYTES = 128 << 20, 32 << 20  # of the sample that the driver fits on, and of a length's centres that are broadcast
_BLOCK_VALUES = 1 << 23  # components of a block's vectors at most


def usable(v: Column) -> Column:
    """Whether a vector can link: finite in every component and not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means on a bounded sample of unit vectors."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    step = max(1, _AT_ONCE // len(centres))
    for _ in range(rounds):
        nearest = np.concatenate([(sample[i : i + step] @ centres.T).argmax(axis=1) for i in range(0, len(sample), step)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norm = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(norm[:, None] > 0, sums / np.where(norm, norm, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def visits(x: np.ndarray, centres: np.ndarray, chord: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each row, and a mask of the cells it visits besides."""
    dots = x @ centres.T
    home = dots.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * centres[home] @ centres.T, 0))
    away = dots[np.arange(len(x)), home][:, None] - dots
    seen = away <= (chord / 2 + SLACK) * apart
    seen[np.arange(len(x)), home] = False
    return home, seen


PIECE = "dim int, cell int, visitor boolean, rows int, class binary, n binary, home binary, seen binary, others binary, v binary"
_COLUMNS = [c.split()[0] for c in PIECE.split(", ")]


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of the rows of an array as bytes, cut at ``bounds``."""
    flat = np.ascontiguousarray(values)
    size = flat.itemsize * int(np.prod(flat.shape[1:]))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * size).astype(np.int32)), pa.py_buffer(flat)])


def _pieces(dim: int, cells: np.ndarray, visitor: np.ndarray, ids: np.ndarray, n: np.ndarray, home: np.ndarray, seen: list[np.ndarray], v: np.ndarray, rows: np.ndarray, most: int) -> pa.RecordBatch:
    """One row a piece of at most ``most`` entries of one cell; an entry is a row of ``ids`` to ``v``."""
    order = np.lexsort((visitor, cells))
    cells, visitor, rows = cells[order], visitor[order], rows[order]
    new = np.flatnonzero(np.concatenate(([True], (cells[1:] != cells[:-1]) | (visitor[1:] != visitor[:-1]))))
    sizes = np.diff(np.concatenate((new, [len(cells)])))
    starts = np.concatenate([np.arange(at, at + size, most) for at, size in zip(new.tolist(), sizes.tolist(), strict=True)])
    bounds = np.concatenate((starts, [len(cells)]))
    counts = np.array([len(s) for s in seen], np.int64)[rows]
    others = np.concatenate([seen[r] for r in rows.tolist()]).astype(np.int32)
    cuts = np.concatenate(([0], np.cumsum(counts)))[bounds]
    columns = [
        pa.array(np.full(len(starts), dim, np.int32)),
        pa.array(cells[starts].astype(np.int32)),
        pa.array(visitor[starts]),
        pa.array(np.diff(bounds).astype(np.int32)),
        _binary(ids[rows], bounds),
        _binary(n[rows], bounds),
        _binary(home[rows].astype(np.int32), bounds),
        _binary(counts.astype(np.int32), bounds),
        pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((cuts * 4).astype(np.int32)), pa.py_buffer(others)]),
        _binary(v[rows], bounds),
    ]
    return pa.RecordBatch.from_arrays(columns, names=_COLUMNS)


def _place(shared, chord: float, piece_rows: int, kind: type):
    """Pieces of one cell's rows, at home or visiting; a length without fitted centres is one cell."""

    def place(dim: int, ids: np.ndarray, n: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        centres = shared.value.get(dim)
        if centres is None:
            home, seen = np.zeros(len(ids), np.int64), [np.zeros(0, np.int64)] * len(ids)
        else:
            homes, seen, step = [], [], max(1, _AT_ONCE // len(centres))
            for i in range(0, len(ids), step):
                h, mask = visits(unit(v[i : i + step]), centres, chord)
                homes.append(h)
                row, cell = np.nonzero(mask)
                seen += np.split(cell, np.cumsum(mask.sum(axis=1))[:-1])
            home = np.concatenate(homes)
        # entries in runs of rows that keep within the bound
        entries = np.array([1 + len(s) for s in seen])
        run = np.cumsum(entries) * v.itemsize * dim // _HELD
        for r in np.unique(run):
            own = np.flatnonzero(run == r)
            away = np.repeat(own, entries[own] - 1)
            cells = np.concatenate((home[own], *[seen[k] for k in own.tolist()]))
            visitor = np.arange(len(cells)) >= len(own)
            yield _pieces(dim, cells, visitor, ids, n, home, seen, v, np.concatenate((own, away)), piece_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for dim, parts in held.items():
                ids, n, v = (np.concatenate(p) for p in zip(*parts, strict=True))
                yield from place(dim, ids, n, v)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            lists = batch.column(2)
            flat, at = np.asarray(lists.flatten()), lists.offsets.to_numpy()
            at = at - at[0]
            dims = np.diff(at)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                v = flat[(at[own][:, None] + np.arange(dim)[None, :])].astype(kind)
                held.setdefault(dim, []).append((ids[own], n[own], v))
                size += v.nbytes
            if size > _HELD:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    return run


class Block:
    """The rows of a block's pieces."""

    def __init__(self, pieces: pd.DataFrame, dim: int, kind: type):
        def joined(name: str, of) -> np.ndarray:
            return np.frombuffer(b"".join(pieces[name]), of)

        self.ids, self.n, self.home = joined("class", np.int64), joined("n", np.int64), joined("home", np.int32)
        seen = joined("seen", np.int32)
        # visits as sorted pairs of row and cell
        self.others = np.sort(np.repeat(np.arange(len(seen), dtype=np.int64), seen) << 32 | joined("others", np.int32))
        self.x = unit(joined("v", kind).reshape(-1, dim))
        self.x32 = self.x.astype(np.float32)

    def visits(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether each of the rows visits the cell beside it."""
        if not len(self.others):
            return np.zeros(len(rows), bool)
        want = rows.astype(np.int64) << 32 | cells
        at = np.minimum(np.searchsorted(self.others, want), len(self.others) - 1)
        return self.others[at] == want


def merge(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the groups of ``u`` and ``v`` in ``root``, which holds each node's group: its least node."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def linked(a: Block, b: Block, start: int, end: int, threshold: float, at_once: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``a`` from ``start`` to ``end``, row of ``b``) with cosine >= ``threshold``."""
    near = a.x32[start:end] @ b.x32.T
    doubt = (a.x.shape[1] + 2) * 2.0**-22  # above the rounding of unit vectors and their products
    x, y = np.divmod(np.flatnonzero(near >= threshold - doubt), len(b.ids))
    unsure = np.flatnonzero(near[x, y] < threshold + doubt)
    x += start
    holds = np.ones(len(x), bool)
    for k in range(0, len(unsure), at_once):
        own = unsure[k : k + at_once]
        holds[own] = np.einsum("ij,ij->i", a.x[x[own]], b.x[y[own]]) >= threshold
    return x[holds], y[holds]


def _multiply(threshold: float, kind: type, rows_at_once: int = 256):
    """Link counts and a spanning forest of one pair of a cell's blocks: at home, and at home or visiting."""

    def run(key: tuple[Any, ...], pieces: pd.DataFrame) -> pd.DataFrame:
        dim, cell, i, j, visiting = (int(k) for k in key)
        first = ~pieces["visitor"] & (pieces["block"] == i)
        second = (pieces["visitor"] == bool(visiting)) & (pieces["block"] == j)
        if not first.any() or not second.any():
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("class", "links", "root")})
        a = Block(pieces[first], dim, kind)
        b = a if i == j and not visiting else Block(pieces[second], dim, kind)
        nodes, place = np.unique(np.concatenate((a.ids, b.ids)), return_inverse=True)
        of_a, of_b = place[: len(a.ids)], place[len(a.ids) :]
        links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for s in range(0, len(a.ids), rows_at_once):
            x, y = linked(a, b, s, min(s + rows_at_once, len(a.ids)), threshold)
            if visiting:  # a pair whose ends visit each other's cell counts in the lesser cell
                once = ~((b.home[y] < cell) & a.visits(x, b.home[y]))
            elif i == j:
                once = x < y
            else:
                once = np.ones(len(x), bool)
            x, y = x[once], y[once]
            if len(x):
                links += np.bincount(of_a[x], b.n[y], len(nodes)).astype(np.int64) + np.bincount(of_b[y], a.n[x], len(nodes)).astype(np.int64)
                merge(root, of_a[x], of_b[y])
        met = np.flatnonzero(links)
        return pd.DataFrame({"class": nodes[met], "links": links[met], "root": nodes[root[met]]})

    return run


def centres_of(classes: DataFrame, sample_rows: int, rows_per_cell: int, max_cells: int, max_lengths: int = 8) -> dict[int, np.ndarray]:
    """Fitted centres by length, for the commonest ``max_lengths`` lengths with enough vectors; the sample, spread by a hash of the
    vector's number, is ``sample_rows`` rows a length at most, and fewer of long vectors: sample and centres are bounded in bytes."""
    common = classes.groupBy(F.size("v").alias("dim")).count().where(F.col("count") >= 2 * rows_per_cell).orderBy(F.desc("count"), "dim").limit(max_lengths).collect()
    out = {}
    for r in common:
        own = classes.where(F.size("v") == r["dim"])
        row = 8 * max(1, r["dim"])  # bytes
        cells = max(1, min(max_cells, r["count"] // rows_per_cell, _CENTRE_BYTES // row))
        wanted = max(1, min(sample_rows, 64 * cells, _SAMPLE_BYTES // row))
        share = min(1.0, 1.1 * wanted / r["count"])
        picked = own.where(F.pmod(F.xxhash64("class"), F.lit(1_000_000)) < int(1_000_000 * share) + 1).orderBy(F.xxhash64("class")).limit(wanted)
        out[r["dim"]] = fit_centres(unit(np.array([x["v"] for x in picked.select("v").collect()])), cells)
    return out


def _links(classes: DataFrame, kind: type, threshold: float, sample_rows: int, rows_per_cell: int, max_cells: int, block_rows: int) -> DataFrame:
    """``class, links, root``: link counts and spanning forests per task."""
    centres = centres_of(classes, sample_rows, rows_per_cell, max_cells)
    shared = classes.sparkSession.sparkContext.broadcast(centres)
    piece_rows = max(1, min(1_024, block_rows // 4))
    placed = written(classes.select("class", "n", "v").mapInArrow(_place(shared, float(np.sqrt(2 - 2 * threshold)), piece_rows, kind), PIECE), "placed")
    most = F.greatest(F.lit(1), F.least(F.lit(block_rows), F.floor(F.lit(_BLOCK_VALUES) / F.col("dim")).cast("int")))

    def blocks(rows: Column) -> Column:
        return F.ceil(F.coalesce(F.sum(rows), F.lit(0)) / most).cast("int")

    # a row a cell
    counted = placed.groupBy("dim", "cell").agg(blocks(F.when(~F.col("visitor"), F.col("rows"))).alias("homes"), blocks(F.when(F.col("visitor"), F.col("rows"))).alias("visits"))
    block = F.pmod(F.xxhash64(F.substring("class", 1, 8)), F.when(F.col("visitor"), F.col("visits")).otherwise(F.col("homes"))).cast("int")
    sized = placed.join(counted, ["dim", "cell"]).withColumn("block", block)

    def numbers(n: str) -> Column:
        return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.expr("cast(array() as array<int>)"))

    def task(i: Column, j: Column, visiting: bool) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), F.lit(visiting).alias("visiting"))

    b = F.col("block")
    at_home = F.transform(numbers("homes"), lambda k: task(F.least(b, k), F.greatest(b, k), False))
    hosting = F.transform(numbers("visits"), lambda k: task(b, k, True))
    tasks = F.when(F.col("visitor"), F.transform(numbers("homes"), lambda k: task(k, b, True))).otherwise(F.concat(at_home, hosting))
    dealt = sized.withColumn("t", F.explode(tasks)).select("dim", "cell", "t.i", "t.j", "t.visiting", "block", "visitor", "class", "n", "home", "seen", "others", "v")
    return written(dealt.groupBy("dim", "cell", "i", "j", "visiting").applyInPandas(_multiply(threshold, kind), "class long, links long, root long"), "links")


def near_duplicates(
    vectors: DataFrame, id_col: str, vector_col: str, threshold: float = 0.95, sample_rows: int = 131_072, rows_per_cell: int = 8_192, max_cells: int = 16_384, block_rows: int = 16_384
) -> DataFrame:
    """One row a vector: ``id, n_links, component_id, kept``.

    ``sample_rows`` bounds the rows of a length that centres are fitted on and ``max_cells`` the centres; all
    rows are placed and compared.
    """
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    named = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    distinct = named.where(usable(F.col("v"))).groupBy("v").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    # numbers are fixed by the writing
    classes = written(distinct.select(F.monotonically_increasing_id().alias("class"), "first_id", "n", "v"), "classes")
    found = _links(classes, np.float32 if single else np.float64, threshold, sample_rows, rows_per_cell, max_cells, block_rows)
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    joined = connected_components(found.where("root <> class").select(F.col("class").alias("u"), F.col("root").alias("v")))
    labels = classes.join(links, "class", "left").join(joined.withColumnRenamed("node", "class"), "class", "left")
    labels = labels.select("v", "first_id", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "class").alias("root"))
    names = labels.groupBy("root").agg(F.min("first_id").alias("component_id"))
    facts = labels.join(names, "root").select("v", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id", F.lit(True).alias("known"))
    # vectors meet their facts again by value; a hot value is an ordinary skewed join
    out = named.join(facts, "v", "left").withColumn("component_id", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id")))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
