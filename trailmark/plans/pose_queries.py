"""Queries of rigid motions: the pose view with a tilt that follows the row's number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import poses as se
from trailmark.plans.base import query, r6
from trailmark.plans.views import POINTS_SQL, POSE_SQL, points, poses

TILT = "(idx % 7 - 3) * 0.1"
LEAN = "(idx % 5 - 2) * 0.2"
MOTION_SQL = f"""{POSE_SQL}, mo as materialized (select seq_id, idx, x, y, z + idx % 3 as z, yaw, cos({TILT}) as cr, sin({TILT}) as sr, cos({LEAN}) as cp, sin({LEAN}) as sp, cos(yaw) as cy, sin(yaw) as sy from v_pose),
ro as materialized (select seq_id, idx, [x, y, z] as t, [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]] as r from mo)"""


def _motions(spark, sf) -> DataFrame:
    p = poses(spark, sf)
    tilt, lean = (F.col("idx") % 7 - 3) * 0.1, (F.col("idx") % 5 - 2) * 0.2
    return p.select("seq_id", "idx", se.from_angles(F.col("x"), F.col("y"), F.col("z") + F.col("idx") % 3, tilt, lean, F.col("yaw")).alias("m"))


def _paired(df: DataFrame) -> DataFrame:
    """Each motion with the next of its sequence."""
    after = df.select("seq_id", (F.col("idx") - 1).alias("idx"), F.col("m").alias("n"))
    return df.join(after, ["seq_id", "idx"])


def _rel(i: int, j: int) -> str:
    return " + ".join(f"a.r[{k}][{i}] * b.r[{k}][{j}]" for k in (1, 2, 3))


def _gap(i: int) -> str:
    return " + ".join(f"a.r[{k}][{i}] * (b.t[{k}] - a.t[{k}])" for k in (1, 2, 3))


@query(
    f"""with {MOTION_SQL} select a.seq_id, a.idx, {", ".join(f"round({_gap(i)}, 6) + 0.0 as t{i}" for i in (1, 2, 3))}, {", ".join(f"round({_rel(i, j)}, 6) + 0.0 as r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))},
round(degrees(acos(least(greatest(({" + ".join(f"a.r[{i}][{j}] * b.r[{i}][{j}]" for i in (1, 2, 3) for j in (1, 2, 3))} - 1) / 2, -1), 1))), 5) as angle, true as valid
from ro a join ro b on a.seq_id = b.seq_id and b.idx = a.idx + 1"""
)
def relative_motions(spark: SparkSession, sf: str) -> DataFrame:
    """F-07: each pose as seen from the one before."""
    met = _paired(_motions(spark, sf)).withColumn("d", se.relative(F.col("m"), F.col("n")))
    parts = [r6(F.get("d", F.lit(4 * (i - 1) + 3))).alias(f"t{i}") for i in (1, 2, 3)] + [r6(F.get("d", F.lit(4 * (i - 1) + j - 1))).alias(f"r{i}{j}") for i in (1, 2, 3) for j in (1, 2, 3)]
    return met.select("seq_id", "idx", *parts, F.round(F.degrees(se.rotation_angle(F.col("m"), F.col("n"))), 5).alias("angle"), se.is_valid(F.col("d")).alias("valid"))


QUAT_SQL = """qu as materialized (select seq_id, idx, t, r, sqrt(greatest(1 + r[1][1] + r[2][2] + r[3][3], 0)) / 2 as w,
  sqrt(greatest(1 + r[1][1] - r[2][2] - r[3][3], 0)) / 2 as x, sqrt(greatest(1 - r[1][1] + r[2][2] - r[3][3], 0)) / 2 as y, sqrt(greatest(1 - r[1][1] - r[2][2] + r[3][3], 0)) / 2 as z from ro)"""


@query(f"with {MOTION_SQL}, {QUAT_SQL} select seq_id, idx, round(t[1], 6) + 0.0 as tx, round(w, 5) as qw, round(x, 5) as qx, round(y, 5) as qy, round(z, 5) as qz, true as back from qu")
def motion_quaternions(spark: SparkSession, sf: str) -> DataFrame:
    """F-08: sizes of the quaternion's parts, and whether the way back gives the same motion."""
    df = _motions(spark, sf).withColumn("s", se.to_seven(F.col("m")))
    back = F.forall(F.zip_with("m", se.from_seven(F.col("s")), lambda a, b: F.abs(a - b)), lambda d: d < 1e-9)
    return df.select("seq_id", "idx", r6(F.get("s", F.lit(0))).alias("tx"), *[F.round(F.abs(F.get("s", F.lit(3 + k))), 5).alias(n) for k, n in enumerate(("qw", "qx", "qy", "qz"))], back.alias("back"))


@query(f"with {POINTS_SQL} select scan_id, count(*) as n, round(sum(cos(0.3) * x - sin(0.3) * z + 1.0), 4) + 0.0 as sx, round(sum(y - 2.0), 4) + 0.0 as sy, round(sum(sin(0.3) * x + cos(0.3) * z + 0.5), 4) + 0.0 as sz, round(sum(intensity), 4) as si from v_points group by scan_id")
def moved_points(spark: SparkSession, sf: str) -> DataFrame:
    """PF-06: points under a motion with a tilt."""
    lit = F.lit
    m = se.from_angles(lit(1.0), lit(-2.0), lit(0.5), lit(0.0), lit(-0.3), lit(0.0))
    made = se.moved(points(spark, sf), m).groupBy("scan_id")
    return made.agg(F.count(lit(1)).alias("n"), *[(F.round(F.sum(c), 4) + 0.0).alias(f"s{c[0]}") for c in ("x", "y", "z")], F.round(F.sum("intensity"), 4).alias("si"))
