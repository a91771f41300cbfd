"""Readers of binary scans and pose files: files are read by Spark, each decoded in one task as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The packed records of the formats.
LAYOUTS = {
    "float4": np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("i", "<f4")]),
    "packed12": np.dtype([("x", "<u2"), ("y", "<u2"), ("z", "<u2"), ("i", "u1"), ("laser", "u1"), ("t", "<u4")]),
    "packed22": np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("i", "<f4"), ("ring", "<u2"), ("t", "<f4")]),
}
POINT = "scan string, x double, y double, z double, intensity double"


def decode(data: bytes, layout: str) -> np.ndarray:
    """IO-01 to IO-03: points ``x, y, z, intensity`` of a file; a size that isn't a whole number of records is an error.

    ``packed12`` holds steps of 5 mm from -100 m and intensities of 255; points that aren't numbers or
    lie 200 m out or more are dropped.
    """
    kind = LAYOUTS[layout]
    if len(data) % kind.itemsize:
        raise ValueError(f"{len(data)} bytes are no whole number of {kind.itemsize}-byte records")
    raw = np.frombuffer(data, kind)
    out = np.stack([raw[c].astype(np.float64) for c in ("x", "y", "z", "i")], axis=1)
    if layout == "packed12":
        out[:, :3] = out[:, :3] * 0.005 - 100.0
        out[:, 3] /= 255.0
    xyz = out[:, :3]
    return out[np.isfinite(xyz).all(axis=1) & (np.abs(xyz) < 200).all(axis=1)]


def read_scans(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """One row a point; ``scan`` is the file's name without its ending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p = decode(data, layout)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(p), pa.string()), *[pa.array(p[:, k]) for k in range(4)]], names=["scan", "x", "y", "z", "intensity"])

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("scan"), "content").mapInArrow(run, POINT)


def read_matrix_poses(spark: SparkSession, path: str) -> DataFrame:
    """IO-05: lines of twelve numbers, other lines skipped: ``line, m`` (row by row) in file order."""
    parts = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("double"))
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), parts.alias("m"))
    return lines.where((F.size("m") == 12) & ~F.exists("m", lambda x: x.isNull()))


def read_csv_poses(spark: SparkSession, path: str) -> DataFrame:
    """IO-06: ``ts, x, y, z, roll, pitch, yaw``; lines with fewer numbers, with words or without a position are skipped."""
    parts = F.transform(F.split("value", ","), lambda x: F.trim(x).try_cast("double"))
    names = ("ts", "x", "y", "z", "roll", "pitch", "yaw")
    held = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 7).select(*[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return held.where("ts is not null and x is not null and not isnan(x)")


def read_quaternion_poses(spark: SparkSession, path: str) -> DataFrame:
    """IO-07: ``ts, x, y, z, qx, qy, qz, qw``; lines with fewer numbers are skipped."""
    parts = F.transform(F.split(F.trim("value"), r"[\s,]+"), lambda x: x.try_cast("double"))
    names = ("ts", "x", "y", "z", "qx", "qy", "qz", "qw")
    return spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 8).select(*[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names)]).where("ts is not null")
