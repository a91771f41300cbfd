"""The sensor dimension, and small decoders of names and settings."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sensor, number, beams; and the beams of an unknown sensor.
SENSORS = (("kitti", 0, 64.0), ("nclt", 1, 32.0), ("helipr", 2, 16.0), ("mulran", 3, 64.0))
UNKNOWN_BEAMS = 64.0


def sensor_of(name: Column) -> Column:
    """F-14: what stands before the first underscore, in lower case."""
    return F.lower(F.split_part(name, F.lit("_"), F.lit(1)))


def truthy(text: Column) -> Column:
    """F-18: whether a setting says yes."""
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "y", "on"), F.lit(False))


def dimension(spark: SparkSession, settings: dict[str, Any] | None = None) -> DataFrame:
    """J-12, Y-20: ``sensor, sensor_id, beams`` and a column per setting; the last row, of sensor null, is that of unknown ones.

    A setting is one number for all, a list by sensor number (shorter ones are filled with 0), or a dictionary by sensor name or number
    with a ``default``.
    """

    def value(of: Any, name: str | None, number: int) -> float:
        if isinstance(of, dict):
            held = {str(k).lower(): v for k, v in of.items()}
            return float(held.get(name or "", held.get(str(number), held.get("default", 0.0))) if name else held.get("default", 0.0))
        if isinstance(of, (list, tuple)):
            return float(of[number]) if number < min(len(of), len(SENSORS)) else 0.0
        return float(of)

    extra = settings or {}
    rows = [(n, i, b, *[value(v, n, i) for v in extra.values()]) for n, i, b in SENSORS]
    rows.append((None, len(SENSORS), UNKNOWN_BEAMS, *[value(v, None, len(SENSORS)) for v in extra.values()]))
    return spark.createDataFrame(rows, ", ".join(["sensor string", "sensor_id int", "beams double", *[f"{k} double" for k in extra]]))


def with_sensor(rows: DataFrame, name: str, dims: DataFrame) -> DataFrame:
    """J-12: rows with their sensor's columns, or those of the unknown sensor; the dimension is a handful of rows."""
    labels = dims.where("sensor is not null").select("sensor").withColumn("known", F.lit(True))
    marked = rows.withColumn("_s", sensor_of(F.col(name))).join(F.broadcast(labels), F.col("_s") == F.col("sensor"), "left").drop("sensor")
    keyed = marked.withColumn("_k", F.when(F.col("known"), F.col("_s")))
    return keyed.join(F.broadcast(dims), F.col("_k").eqNullSafe(F.col("sensor"))).drop("_s", "_k", "known")


def scaled_context(v: Column, raw: int, scale: Column | float, context: int | None = None) -> Column:
    """PF-11: an embedding whose part after the first ``raw`` values (``context`` of them, or all) is scaled; the rest stays."""
    by = F.lit(scale) if isinstance(scale, float) else scale
    end = F.size(v) if context is None else F.lit(raw + context)
    return F.transform(v, lambda x, i: F.when((i >= raw) & (i < end), x * by).otherwise(x))
