"""SimHash near-duplicate groups through a segment-popcount embedding.

Method: a 64-bit fingerprint is mapped to the bit counts of its 32 two-bit
segments.  The Manhattan distance of two such vectors never exceeds the Hamming
distance of the fingerprints, so fingerprints at Hamming distance ``d`` have
vectors at Manhattan distance ``d`` at most.  Cut into ``blocks`` blocks of
coordinates, two such vectors agree in whole blocks wherever no unit of distance
falls: in ``blocks - d`` of them at least.  One grid cell per choice of
``blocks - d`` blocks therefore meets every pair.  Within a cell the Manhattan
bound filters, and the exact Hamming distance decides.

More blocks make more rows per fingerprint and smaller cells; the number is a parameter, the same at every size, and
groups are the same for every number of blocks.

Defined cases: null or blank text has fingerprint 0, which links like any other;
repeated rows and equal texts share a fingerprint; an empty table gives no rows;
a null ``id`` keeps its fingerprint and group but is never a group's smallest id;
other columns of the input are not touched or looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import written
from trailmark.llm.components import connected_components

SEED = 42
_LOW = np.uint64(0x5555555555555555)
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The signed 64-bit SimHash of a text; ``bytes.split`` and ``bytes.lower`` only know ASCII."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in spans), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        octets = hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def simhash(text: Column, shingle: int = 4) -> Column:
    """Column of SimHash fingerprints as signed longs, over whole texts."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return of(text.cast("binary"))


def segment_counts(x: np.ndarray) -> np.ndarray:
    """The embedding: 32 two-bit fields that hold the bit counts of the two-bit segments."""
    return (x & _LOW) + ((x >> np.uint64(1)) & _LOW)


def manhattan(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed vectors with fields of 0, 1 or 2.

    A field's difference is odd where the low bits differ (distance 1) and two
    where the fields are 0 and 2 (only the high bits differ).
    """
    x = p ^ q
    odd, high = x & _LOW, (x >> np.uint64(1)) & _LOW
    return np.bitwise_count(odd).astype(np.int16) + 2 * np.bitwise_count(high & ~odd)


def cell_masks(distance: int, blocks: int) -> list[int]:
    """For each choice of ``blocks - distance`` blocks, the mask of their coordinates."""
    if not distance < blocks <= 32:
        raise ValueError("need distance < blocks <= 32")
    of = [sum(3 << (2 * i) for i in part.tolist()) for part in np.array_split(np.arange(32), blocks)]
    return [sum(c) for c in combinations(of, blocks - distance)]


def links_in(cell: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Breadth-first search over the fingerprints of one cell: pairs (each, its root).

    Every fingerprint is compared with the ones not yet reached only, so a cell
    of near copies costs about its size and not the square of it.
    """
    found, rest = [], np.unique(cell)
    counts = segment_counts(rest)
    while len(rest) > 1:
        root, queue, group = rest[0], [(rest[0], counts[0])], []
        rest, counts = rest[1:], counts[1:]
        while queue and len(rest):
            x, p = queue.pop()
            near = manhattan(counts, p) <= distance
            near &= np.bitwise_count(rest ^ x) <= distance
            if near.any():
                queue += list(zip(rest[near], counts[near], strict=True))
                group.append(rest[near])
                rest, counts = rest[~near], counts[~near]
        if group:
            members = np.concatenate(group)
            found.append((members, np.full(len(members), root)))
    return found


def _cells(distance: int, blocks: int):
    masks = np.array(cell_masks(distance, blocks), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            counts = segment_counts(x)
            for k, mask in enumerate(masks):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), k, np.int32)), pa.array((counts & mask).view(np.int64)), pa.array(x.view(np.int64))],
                    names=["choice", "cell", "fp"],
                )

    return run


def _links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []  # of the cell that the last batch ended in
        last = None

        def flush(x: np.ndarray):
            for u, v in links_in(x, distance):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            choice, cell, fp = (batch.column(i).to_numpy() for i in range(3))
            fp = fp.view(np.uint64)
            new = np.flatnonzero((choice[1:] != choice[:-1]) | (cell[1:] != cell[:-1])) + 1
            bounds = np.concatenate(([0], new, [len(fp)]))
            if last is not None and last != (choice[0], cell[0]) and kept:
                yield from flush(np.concatenate(kept))
                kept = []
            kept.append(fp[: bounds[1]].copy())
            if len(bounds) > 2:
                yield from flush(np.concatenate(kept))
                sizes = np.diff(bounds)
                for k in np.flatnonzero(sizes[1:-1] > 1) + 1:
                    yield from flush(fp[bounds[k] : bounds[k + 1]])
                kept = [fp[bounds[-2] :].copy()]
            last = (choice[-1], cell[-1])
        if kept:
            yield from flush(np.concatenate(kept))

    return run


def fingerprint_links(fingerprints: DataFrame, distance: int = 4, blocks: int = 7) -> DataFrame:
    """Edges ``u, v`` that connect the distinct fingerprints ``fp`` just as all pairs
    within ``distance`` bits would.  The rows per fingerprint are the number of
    block choices, whatever the group sizes."""
    spread = fingerprints.repartition(int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    cells = spread.mapInArrow(_cells(distance, blocks), "choice int, cell long, fp long")
    sorted_cells = cells.repartition("choice", "cell").sortWithinPartitions("choice", "cell")
    return sorted_cells.mapInArrow(_links(distance), "u long, v long")


def near_duplicate_groups(docs: DataFrame, id_col: str, text_col: str, distance: int = 4, blocks: int = 7, shingle: int = 4) -> DataFrame:
    """One row a document: ``id, fp, component_id``, the smallest id of its group.

    Texts are read once; after that only ids and fingerprints move.
    """
    marked = written(docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col), shingle).alias("fp")), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct")
    linked = connected_components(fingerprint_links(distinct.select("fp"), distance, blocks))
    root = F.coalesce("component", "fp")
    named = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", root.alias("root"))
    named = written(named, "roots")
    groups = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = named.join(groups, "root").select("fp", "component_id")
    return marked.join(by_print, "fp").select("id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
