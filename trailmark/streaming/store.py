"""A growing store of descriptors: a Parquet table that batches and streams append to and that queries read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from trailmark.operators import knn

BUCKETS = 64


class DescriptorStore:
    """S-04, R-02, Y-07: rows ``seq_id, idx, v`` and what else ``schema`` has, below ``path``.

    Folders are ``version=/part=/bucket=``: a version for each ``clear``, a part for each ``add`` or micro-batch, and a bucket by a hash of
    the sequence, so that a question reads the buckets of its own sequences only.  The newest version's folder is the pointer that all readers and
    writers go by, on any session; older files stay until someone deletes them.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets
        if not self._versions():
            self._open(0)

    def _place(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _open(self, version: int) -> None:
        place, files = self._place(f"{self.path}/version={version}")
        files.mkdirs(place)

    def _versions(self) -> list[int]:
        place, files = self._place(self.path)
        names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))

    @property
    def version(self) -> int:
        """The newest stored version."""
        return self._versions()[-1]

    @property
    def folder(self) -> str:
        return f"{self.path}/version={self.version}"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("seq_id"), F.lit(self.buckets)).cast("int")

    def add(self, rows: DataFrame, part: str | None = None) -> None:
        """Append rows; a ``part`` that is there already is written anew."""
        rows.withColumn("bucket", self._bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/part={part or uuid.uuid4().hex}")

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows so far, or those of some buckets."""
        held = self.spark.read.schema(f"{self.schema}, part string, bucket int").parquet(self.folder)
        return (held if buckets is None else held.where(F.col("bucket").isin(buckets))).drop("part", "bucket")

    def clear(self) -> None:
        self._open(self.version + 1)

    def query(self, asked: DataFrame, k: int, metric: str = "cosine", gap: int | None = None) -> DataFrame:
        """The best ``k`` stored rows of each asked row, of its past only: ``seq_id, q, c, score, rank``.

        Which buckets the asked rows are in is looked up first, a number a bucket at most.
        """
        met = sorted(r[0] for r in asked.select(self._bucket().alias("b")).where("b is not null").distinct().collect())
        return knn.nearest(asked, self.rows(met), k, metric, gap, past_only=True)

    def answer(self, batch: DataFrame, number: int, out: str, every: int, k: int, gap: int) -> None:
        """Append a micro-batch of keyframes, then let those of its rows whose number ``every`` divides (never 0) ask the store as it then is;
        answers go below ``out``.  Both are named by the batch's number, so that one that runs again after a failure writes the same."""
        self.add(batch, str(number))
        asked = batch.where((F.col("idx") % every == 0) & (F.col("idx") > 0))
        self.query(asked, k, gap=gap).write.mode("overwrite").parquet(f"{out.rstrip('/')}/part={number}")

    def follow(self, keyframes: DataFrame, out: str, every: int, k: int, gap: int) -> DataStreamWriter:
        """S-01: a stream of keyframes through ``answer``."""
        return keyframes.writeStream.foreachBatch(lambda batch, number: self.answer(batch, number, out, every, k, gap))
