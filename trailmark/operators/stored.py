"""Tables in blocks that are files of the shared folder, for jobs in which rows of one group meet many others of it.

Rows are dealt into blocks once.  A task then takes one block and reads, in turn, the blocks that its rows may meet, so that the disk holds each row once
however many blocks it meets, and a task's memory is two blocks and what it makes of them.  The shared folder must be mounted on every executor
(``file:``); where it isn't, ``mount`` says so and callers send rows to each other through a shuffle.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trailmark.operators.tables import delete, shared_folder, written

BLOCK_ROWS, BLOCK_BYTES = 8192, 4 << 20  # of a block, at most
PART_BYTES = 24 << 20  # what a partition of rows on their way to blocks is to hold
FEW_GROUPS = 10_000  # whose sizes may be broadcast


def mount(spark: SparkSession) -> str | None:
    """The path of the shared folder where it is mounted, else None."""
    parts = urlparse(shared_folder(spark))
    return parts.path if parts.scheme in ("", "file") else None


class Block:
    """Rows of one group in the order of ``idx``: ``i``, their vectors ``v`` and other columns by name."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            names = [str(n) for n in np.load(f)]
            held = {n: np.load(f) for n in names}
        self.i, self.v, self.columns = held.pop("idx"), held.pop("v", None), held

    def __len__(self) -> int:
        return len(self.i)

    def only(self, rows: np.ndarray) -> Block:
        """Some of the rows."""
        some = Block.__new__(Block)
        some.i, some.v, some.columns = self.i[rows], None if self.v is None else self.v[rows], {n: x[rows] for n, x in self.columns.items()}
        return some


class Stored:
    """``rows`` (``idx``, the ``keys``, ``extra`` columns and, with ``vectors``, ``v``) in blocks: their paths by group in ``paths``.

    ``width``: about how many bytes a row takes; ``ordered`` deals stretches of ``idx`` to blocks where these are of about equal size.
    """

    def __init__(self, rows: DataFrame, extra: tuple[str, ...] = (), keys: tuple[str, ...] = ("seq_id",), vectors: bool = True, ordered: bool = False, block_rows: int | None = None):
        self.spark, self.keys, self.schema = rows.sparkSession, keys, rows.schema
        folder = f"{mount(self.spark)}/trailmark/blocks-{uuid.uuid4().hex}"
        self.folder = f"file://{folder}"
        kept = rows.select(*keys, F.col("idx").cast("long").alias("idx"), *([F.col("v").cast("array<double>").alias("v")] if vectors else []), *extra)
        size = F.max(F.size("v")) if vectors else F.lit(0)
        width = 8 * (F.greatest(size, F.lit(0)) + 1 + len(extra))
        most = F.greatest(F.lit(1), F.least(F.lit(block_rows or BLOCK_ROWS), F.floor(F.lit(BLOCK_BYTES) / width)))
        sizes = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.ceil(F.count(F.lit(1)) / most).cast("int").alias("nb"), width.alias("width"), F.min("idx").alias("first"), F.max("idx").alias("last"))
        sizes = written(sizes, "sizes")
        total = sizes.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("rows") * (F.col("width") + 32)), F.lit(0)).alias("bytes")).first()
        few = total["groups"] <= FEW_GROUPS
        dealt = kept.join(F.broadcast(sizes.drop("rows", "width")) if few else sizes.drop("rows", "width"), list(keys))
        by_hash, stretch = F.pmod(F.xxhash64("idx"), F.col("nb")).cast("int"), F.floor((F.col("idx") - F.col("first")) * F.col("nb") / (F.col("last") - F.col("first") + 1)).cast("int")
        if ordered:
            fullest = dealt.groupBy(*keys, stretch.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.first(F.lit(block_rows or BLOCK_ROWS)).alias("most")).agg(F.coalesce(F.max(F.col("n") / F.col("most")), F.lit(0))).first()[0]
            ordered = fullest <= 4
        dealt = dealt.withColumn("block", stretch if ordered else by_hash).drop("nb", "first", "last")
        names = ["idx", *(["v"] if vectors else []), *extra]

        def write(t: pa.Table) -> pa.Table:
            os.makedirs(folder, exist_ok=True)
            idx = t.column("idx").to_numpy()
            turn, path = np.argsort(idx, kind="stable"), f"{folder}/{uuid.uuid4().hex}"
            with open(path, "wb") as f:  # under a name of its own: another attempt's file stays unread
                np.save(f, np.array(names))
                for name in names:
                    values = t.column(name).combine_chunks()
                    flat = values.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(t), -1) if name == "v" else values.to_numpy(zero_copy_only=False)
                    np.save(f, flat[turn])
            return pa.table({**{k: t.column(k).slice(0, 1) for k in keys}, "path": pa.array([path]), "least": pa.array([int(idx.min())])})

        kinds = ", ".join(f"{k} {kept.schema[k].dataType.simpleString()}" for k in keys)
        parts = max(-(-total["bytes"] // PART_BYTES), int(self.spark.conf.get("spark.sql.shuffle.partitions")) if total["bytes"] > PART_BYTES else 1)
        made = dealt.repartition(int(parts), *keys, "block").groupBy(*keys, "block").applyInArrow(write, f"{kinds}, path string, least long")
        self.paths: dict[tuple, list[str]] = {}
        for r in written(made, "blocks").orderBy(*keys, "least").collect():  # a row a block
            self.paths.setdefault(tuple(r[k] for k in keys), []).append(r["path"])

    def discard(self) -> None:
        """Deletes the blocks, which nothing may read any more."""
        delete(self.spark, self.folder)


def met(queries: Stored, base: Stored, work: Callable[[Block, Callable[[], Iterator[Block]]], Iterable[pd.DataFrame]], schema: str, around: Callable[[tuple], list[tuple]] = lambda key: [key]) -> DataFrame:
    """``seq_id``, the first of the keys, and what ``work`` makes of each block of queries and the blocks of base rows of the groups ``around`` its own, which it may read more than once."""
    tasks, theirs = [(key, path) for key, paths in queries.paths.items() for path in reversed(paths)], base.paths
    shape = f"seq_id {queries.schema[queries.keys[0]].dataType.simpleString()}, {schema}"
    arrow = to_arrow_schema(StructType.fromDDL(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                key, path = tasks[n]
                others = [p for other in around(key) for p in theirs.get(other, ())]
                for made in work(Block(path), lambda: (Block(p) for p in others)):
                    if len(made):
                        made = made.copy(deep=False)
                        made.insert(0, "seq_id", key[0])
                        yield from pa.Table.from_pandas(made, arrow, preserve_index=False).to_batches(max_chunksize=1 << 14)
                pa.default_memory_pool().release_unused()  # a worker outlives its task

    return queries.spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInArrow(run, shape)
