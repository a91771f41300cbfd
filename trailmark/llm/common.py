"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the named Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master may do without the setting; it then gets a folder of
    its own, as in tests.  On a cluster a missing setting is an error, because
    a machine-local folder would lose rows there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="trailmark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark)}/trailmark/{label}-{uuid.uuid4().hex}"


def posix_path(path: str) -> str:
    """The mount path of a ``file:`` URI; other stores can't be memory-mapped."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: memory-mapped arrays need a shared folder mounted on every executor")
    return parts.path


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to a folder and read again: lineage ends there, so a lost executor costs a read and not a recomputation."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a new folder of the shared one and read again."""
    return stored(df, new_path(df.sparkSession, label))


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``new_path`` that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def finite(v: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row and bound to a lambda variable."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII text takes the plain (much faster) lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words_of(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` in the lower-cased text; null text has none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
