"""Queries of the comparison descriptors and of the learned parts with fixed weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import baselines, grids, learned
from trailmark.plans.base import query, r6
from trailmark.plans.views import POSE_SQL, descriptors, points, poses

R_MAX = 80.0
FREQS = [10_000.0 ** (-k / 8) for k in range(0, 8, 2)]


@query(
    f"with {POSE_SQL}, f as (select * from (values {', '.join(f'({i}, {f!r}::double)' for i, f in enumerate(FREQS))}) t(k, f)) "
    "select seq_id, idx, k, round(sin(yaw * f), 6) + 0.0 as s, round(cos(yaw * f), 6) + 0.0 as c from v_pose, f"
)
def sinusoidal_encoding(spark: SparkSession, sf: str) -> DataFrame:
    made = poses(spark, sf).select("seq_id", "idx", learned.sinusoidal(F.col("yaw"), 8).alias("e"))
    each = made.select("seq_id", "idx", F.posexplode(F.arrays_zip(F.slice("e", 1, 4).alias("s"), F.slice("e", 5, 4).alias("c"))).alias("k", "x"))
    return each.select("seq_id", "idx", "k", r6("x.s").alias("s"), r6("x.c").alias("c"))


HIDDEN = learned.Dense([[0.5, -1.0, 0.25], [-0.75, 0.5, 1.0]], [0.1, -0.2])
LAST = learned.Dense([[1.5, -2.0]], [0.05])


@query(
    """with e as (select vec_id as idx, vec_id % 2 as etype, embedding::double[] as v from embeddings),
h as (select idx, etype, greatest(0.5 * v[1] - 1.0 * v[2] + 0.25 * v[3] + 0.1, 0) as a, greatest(-0.75 * v[1] + 0.5 * v[2] + 1.0 * v[3] - 0.2, 0) as b from e)
select idx, etype, round(case when etype = 0 then 0.0 else 3.0 * tanh(1.5 * a - 2.0 * b + 0.05) end, 6) + 0.0 as logit from h"""
)
def edge_confidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = descriptors(spark, sf).withColumn("etype", F.col("idx") % 2)
    gate = learned.edge_gate(F.slice("v", 1, 3), F.col("etype"), HIDDEN, LAST)
    return rows.select("idx", "etype", r6(gate).alias("logit"))


@query(
    """with e as (select vec_id as c, vec_id % 7 as q, embedding::double[] as v from embeddings),
s as (select q, c, 10.0 * list_max(v[1:16]) + v[17] as score from e) select q, c, round(score, 6) + 0.0 as score, row_number() over (partition by q order by score desc, c)::int as rank from s"""
)
def phase_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Closed form of the re-ranker; curves and similarities are parts of the vectors."""
    rows = descriptors(spark, sf).select((F.col("idx") % 7).alias("q"), F.col("idx").alias("c"), F.slice("v", 1, 16).alias("curve"), F.get("v", F.lit(16)).alias("sim"))
    return learned.rerank(rows).select("q", "c", r6("score").alias("score"), "rank")


def _rounded(df: DataFrame, name: str) -> DataFrame:
    return df.select("scan_id", F.posexplode(name).alias("dim", "x")).select("scan_id", "dim", r6("x").alias("x"))


@query()
def log_polar_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    cells = grids.max_height(grids.polar_cells(points(spark, sf), 20, 60, R_MAX, 0.1, open_low=True))
    return _rounded(baselines.spectral_signature(baselines.images(cells, "val", 60)), "descriptor")


@query()
def log_gabor_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Coarse signatures of the templates."""
    codes = grids.layer_code(grids.polar_cells(points(spark, sf), 80, 360, R_MAX, 0.5), -1.0, 5.0, 8)
    made = baselines.iris_templates(baselines.images(codes, "code", 360))
    return _rounded(made.select("scan_id", baselines.coarse_signature(F.col("template")).alias("s")), "s")


@query()
def plane_projection(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(baselines.plane_projection(points(spark, sf)), "descriptor")


@query()
def principal_tokens(spark: SparkSession, sf: str) -> DataFrame:
    made = baselines.principal_tokens(descriptors(spark, sf), "v", 16)
    return made.select("idx", F.posexplode("token").alias("dim", "x")).select("idx", "dim", r6("x").alias("x"))
