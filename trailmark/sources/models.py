"""Fitted statistics and weights as one-row tables, and loaders by a data set's kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.sources import scans


def save_fitted(fitted: DataFrame, path: str, kind: str) -> None:
    """IO-19: a one-row table of fitted numbers, with its kind; an error if something is there already."""
    fitted.withColumn("kind", F.lit(kind)).coalesce(1).write.mode("errorifexists").parquet(path)


def load_fitted(spark: SparkSession, path: str, kind: str, columns: tuple[str, ...]) -> DataFrame:
    """IO-19, Y-12: the stored row; another kind, a missing column, or a null in one is an error that names it."""
    held = spark.read.parquet(path)
    lacking = [c for c in (*columns, "kind") if c not in held.columns]
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    wrong = F.concat(F.lit(f"{path} holds "), F.col("kind"))
    checked = F.when(F.col("kind") == kind, True).otherwise(F.raise_error(wrong))
    empty = [F.when(F.col(c).isNotNull(), True).otherwise(F.raise_error(F.lit(f"{path} has no {c}"))) for c in columns]
    for condition in (checked, *empty):
        held = held.where(condition)
    return held.select(*columns)


#: IO-04: readers of scans and poses by a data set's kind.
LOADERS: dict[str, tuple[str, Callable[[SparkSession, str], DataFrame]]] = {
    "kitti": ("float4", scans.read_matrix_poses),
    "nclt": ("packed12", scans.read_csv_poses),
    "helipr": ("packed22", scans.read_quaternion_poses),
    "mulran": ("float4", scans.read_csv_poses),
}


def load_sequence(spark: SparkSession, kind: str, scan_path: str, pose_path: str) -> tuple[DataFrame, DataFrame]:
    """IO-04: points and poses of a sequence of the kind, in upper or lower case; an unknown kind is an error."""
    if kind.lower() not in LOADERS:
        raise ValueError(f"{kind}: none of {', '.join(LOADERS)}")
    layout, poses = LOADERS[kind.lower()]
    return scans.read_scans(spark, scan_path, layout), poses(spark, pose_path)
