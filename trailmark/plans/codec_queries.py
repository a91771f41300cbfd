"""Queries of the codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import codec, trajectory as tr
from trailmark.plans.base import query, r6
from trailmark.plans.views import DESC_SQL, POSE_SQL, descriptors, poses

HIST_SQL = f"""with {DESC_SQL}, h as (select idx, generate_subscripts(h, 1) as p, unnest(h) as x from (select idx, list_transform(v[1:16], lambda x: abs(x)) as h from v_desc)),
q as (select *, round_even(x / (sum(x) over (partition by idx order by p rows between unbounded preceding and unbounded following) + 1e-8) * 65535, 0)::bigint as q from h),
m as (select *, row_number() over (partition by idx order by q desc, p) as r, 65535 - sum(q) over (partition by idx) as e from q)"""


def _quantized(spark, sf) -> DataFrame:
    hist = descriptors(spark, sf).select("idx", F.transform(F.slice("v", 1, 16), F.abs).alias("h"))
    return hist.withColumn("q", codec.quantize(F.col("h")))


@query(f"{HIST_SQL} select idx, p - 1 as bin, (q + case when r = 1 then e else 0 end)::bigint as q from m")
def quantize_u16(spark: SparkSession, sf: str) -> DataFrame:
    made = _quantized(spark, sf).select("idx", F.posexplode("q").alias("bin", "q"))
    return made.select("idx", F.col("bin").cast("long").alias("bin"), "q")


@query(f"with {POSE_SQL} select seq_id, idx, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y, round(cos(atan2(sin(yaw), cos(yaw)) / 2), 6) + 0.0 as qw, round(abs(sin(atan2(sin(yaw), cos(yaw)) / 2)), 6) as qz from v_pose")
def pose_7dof(spark: SparkSession, sf: str) -> DataFrame:
    p = poses(spark, sf)
    made = p.select("seq_id", "idx", codec.seven(F.col("x"), F.col("y"), F.col("z"), F.col("yaw")).alias("s"))
    return made.select("seq_id", "idx", r6(F.get("s", F.lit(0))).alias("x"), r6(F.get("s", F.lit(1))).alias("y"), r6(F.get("s", F.lit(3))).alias("qw"), r6(F.abs(F.get("s", F.lit(6)))).alias("qz"))


INFORMATION = [100.0] * 3 + [1000.0] * 3
UPPER = " ".join(f"{INFORMATION[i] if i == j else 0.0:.1f}" for i in range(6) for j in range(i, 6))
HALF = "atan2(sin(p.yaw), cos(p.yaw)) / 2"


@query(
    f"""with {POSE_SQL.replace("v_pose as (", "v_pose as materialized (", 1)}, m as (select a.seq_id, a.idx, min(b.idx) as match from v_pose a join v_pose b on a.seq_id = b.seq_id and b.idx <= a.idx - 30
  and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) < 5.0 group by all)
select seq_id, 'EDGE_SE3:QUAT ' || idx || ' ' || match || ' ' || {" || ' ' || ".join(f"printf('%.6f', round({c}, 6) + 0.0)" for c in ("p.x", "p.y", "p.z", "0.0::double", "0.0::double", f"sin({HALF})", f"cos({HALF})"))} || ' {UPPER}' as line
from m join v_pose p using (seq_id, idx)"""
)
def g2o_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Revisits of all sequences as pose-graph edges, here with the pose of the revisit."""
    met = tr.revisit_queries(poses(spark, sf)).withColumnRenamed("i", "idx").join(poses(spark, sf), ["seq_id", "idx"])
    seven = codec.seven(F.col("x"), F.col("y"), F.col("z"), F.col("yaw"))
    return met.select("seq_id", codec.g2o_line(F.col("idx"), F.col("match"), seven, INFORMATION).alias("line"))
