"""A cache of encoded scans that a job fills a part at a time and goes on with after a stop."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_keys(points: DataFrame, config: dict[str, Any]) -> DataFrame:
    """IO-09: ``scan_id, key``: a digest of each scan's points, in any order, and of what they are encoded with.

    Points are summed up as hashes, so no scan is gathered in one row.
    """
    parts = [F.xxhash64(*[F.col(c).cast("double") for c in points.columns if c != "scan_id"], F.lit(salt)) for salt in (1, 2)]
    held = points.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(p.cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i, p in enumerate(parts)])
    return held.select("scan_id", F.sha2(F.concat_ws(":", "n", "s0", "s1", F.lit(json.dumps(config, sort_keys=True))), 256).alias("key"))


class EncodedCache:
    """IO-10, IO-11: rows ``scan_id, key`` and what ``encode`` makes of points, below ``path``; and side tables by the same keys.

    A scan whose content and configuration are stored already is not encoded again; a changed one gets a new row and its old one is left alone.
    """

    def __init__(self, spark: SparkSession, path: str, config: dict[str, Any]):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config

    def _stored(self, name: str) -> DataFrame | None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(place) or not files.listStatus(place):
            return None
        return self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.path}/{name}")

    def missing(self, points: DataFrame, name: str = "main") -> DataFrame:
        """``scan_id, key`` of the scans that aren't stored."""
        keys, stored = content_keys(points, self.config), self._stored(name)
        return keys if stored is None else keys.join(stored.select("scan_id", "key"), ["scan_id", "key"], "left_anti")

    def update(self, points: DataFrame, encode: Callable[[DataFrame], DataFrame], name: str = "main", parts: int = 1) -> int:
        """Encode what is missing, in ``parts`` parts by a hash of the scan, each written when it is done; how many scans that was.

        ``encode`` takes points and gives a row a ``scan_id``.  A run that stops keeps the parts before, and the next goes on from them.
        """
        done = 0
        for part in range(parts):
            todo = self.missing(points, name).where(F.pmod(F.xxhash64("scan_id"), F.lit(parts)) == part)
            folder = f"{self.path}/{name}-todo/{uuid.uuid4().hex}"
            todo.write.parquet(folder)  # what this part encodes is settled here, whatever is stored meanwhile
            todo = self.spark.read.schema(todo.schema).parquet(folder)
            if n := todo.count():
                made = encode(points.join(todo.select("scan_id"), "scan_id", "left_semi"))
                made.join(todo, "scan_id").write.parquet(f"{self.path}/{name}/{uuid.uuid4().hex}")
                done += n
        return done

    def read(self, points: DataFrame, *sides: str) -> DataFrame:
        """The stored rows of these scans as they now are, with the columns of side tables; a scan that lacks one of them is an error."""
        keys = content_keys(points, self.config)
        out = keys
        for name in ("main", *sides):
            stored = self._stored(name)
            if stored is None:
                raise ValueError(f"{self.path}: nothing is stored as {name}")
            out = out.join(stored.dropDuplicates(["scan_id", "key"]).withColumn(f"_{name}", F.lit(True)), ["scan_id", "key"], "left")
        lacks = F.concat_ws(", ", *[F.when(F.col(f"_{n}").isNull(), F.lit(n)) for n in ("main", *sides)])
        checked = F.when(lacks != "", F.raise_error(F.concat(F.lit("scan "), F.col("scan_id").cast("string"), F.lit(" lacks "), lacks))).otherwise(F.col("key"))
        return out.withColumn("key", checked).drop(*[f"_{n}" for n in ("main", *sides)])
