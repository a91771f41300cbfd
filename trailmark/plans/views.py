"""Proxy views that map the driver's tables to scans, poses, points and descriptors.

Each view exists twice: as a DataFrame, and as SQL text for the oracle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RADIUS, LAP = 20.0, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight trajectories on a circle, odd laps reversed: ``seq_id, idx, ts, x, y, z, yaw``."""
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("seq_id"), "event_id")
    numbered = events.withColumn("idx", F.row_number().over(Window.partitionBy("seq_id").orderBy("event_id")).cast("long") - 1)
    lap = F.floor(F.col("idx") / LAP) % 2
    step = numbered.withColumn("ph", F.when(lap == 0, F.col("idx") % LAP).otherwise(LAP - 1 - F.col("idx") % LAP)).withColumn("dirn", lap)
    angle = 2 * F.pi() * (F.col("ph") / float(LAP))
    return step.select(
        "seq_id",
        "idx",
        F.col("event_id").cast("double").alias("ts"),
        (RADIUS * F.cos(angle)).alias("x"),
        (RADIUS * F.sin(angle)).alias("y"),
        F.lit(0.0).alias("z"),
        (angle + F.pi() / 2 + F.col("dirn") * F.pi()).alias("yaw"),
    )


POSE_SQL = f"""v_pose as (
  select seq_id, idx, event_id::double as ts, {RADIUS} * cos(2 * pi() * (ph / {LAP}.0)) as x, {RADIUS} * sin(2 * pi() * (ph / {LAP}.0)) as y,
         0.0::double as z, 2 * pi() * (ph / {LAP}.0) + pi() / 2 + dirn * pi() as yaw
  from (select seq_id, idx, event_id, case when (idx // {LAP}) % 2 = 0 then idx % {LAP} else {LAP - 1} - idx % {LAP} end as ph, (idx // {LAP}) % 2 as dirn
        from (select user_id % 8 as seq_id, event_id, row_number() over (partition by user_id % 8 order by event_id) - 1 as idx from events)))"""


STEPS = 3600


def _directions(spark: SparkSession) -> DataFrame:
    """``step, cos, sin`` of the directions that points have, from the C library, whose last digits are those of the SQL; Java's differ in a few."""
    angles = [2 * math.pi * (k + 0.5) / float(STEPS) - math.pi for k in range(STEPS)]
    return spark.createDataFrame([(k, math.cos(a), math.sin(a)) for k, a in enumerate(angles)], "step long, cos double, sin double")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan per supplier: ``scan_id, x, y, z, intensity``, kept off bin edges."""
    step = (F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_linenumber")) % STEPS
    line = table(spark, sf_dir, "lineitem")
    flat = line.select(F.col("l_suppkey").alias("scan_id"), step.alias("step"), (1.25 + F.col("l_quantity") * 1.5).alias("r0"), (-2.87 + F.col("l_discount") * 70).alias("z"), F.col("l_tax").alias("intensity"))
    met = flat.join(F.broadcast(_directions(spark)), "step", "left")
    return met.select("scan_id", (F.col("r0") * F.col("cos")).alias("x"), (F.col("r0") * F.col("sin")).alias("y"), "z", "intensity")


POINTS_SQL = """v_points as (
  select scan_id, r0 * cos(th) as x, r0 * sin(th) as y, z, intensity
  from (select l_suppkey as scan_id, 2 * pi() * (((l_orderkey * 31 + l_partkey * 7 + l_linenumber) % 3600) + 0.5) / 3600.0 - pi() as th,
               1.25 + l_quantity * 1.5 as r0, -2.87 + l_discount * 70 as z, l_tax as intensity from lineitem))"""


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as descriptors: ``idx, v, label``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("v"), "label")


DESC_SQL = "v_desc as (select vec_id as idx, embedding::double[] as v, label from embeddings)"


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors as images of 4 rows by 16 sectors: ``idx, row, vals``."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.struct(r.alias("row"), F.slice("v", r * 16 + 1, 16).alias("vals")))
    return descriptors(spark, sf_dir).select("idx", F.inline(rows))


LAYOUT_SQL = DESC_SQL + ", v_layout as (select idx, r::int as row, v[r * 16 + 1 : r * 16 + 16] as vals from v_desc, range(4) t(r))"


#: Rows of posed sequences are numbered through: sequence times this, plus the row's number.
APART = 10_000_000


def posed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sequences with descriptors: poses joined to descriptors on ``idx``, then numbered through as ``idx``."""
    met = poses(spark, sf_dir).join(descriptors(spark, sf_dir), "idx")
    return met.withColumn("idx", F.col("seq_id") * APART + F.col("idx"))


POSED_SQL = POSE_SQL + ", " + DESC_SQL + f", v_posed as (select seq_id * {APART} + idx as idx, v_pose.* exclude (idx), v, label from v_pose join v_desc using (idx))"
