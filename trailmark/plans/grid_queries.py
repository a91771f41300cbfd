"""Queries of the grid operators over the point view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import grids
from trailmark.plans.base import query, r6
from trailmark.plans.views import POINTS_SQL, points

ROWS, COLS, R_MAX = 16, 60, 80.0
TAU = repr(grids.TWO_PI)
W = f"with {POINTS_SQL}"


def _bin(u: str, n: int) -> str:
    return f"least(greatest(floor(({u}) * {n}), 0), {n - 1})::int"


AZ = f"(((atan2(y, x) + pi()) % {TAU}) + {TAU}) % {TAU}"
RANGE_SQL = f"""v_range as (
  select scan_id, "row", col, min(r) as range, max(intensity) filter (where r = m) as intensity from (
    select *, min(r) over (partition by scan_id, "row", col) as m from (
      select scan_id, r, intensity, {_bin("(degrees(asin(z / greatest(r, 1e-8))) - -30.0) / 60.0", ROWS)} as "row", {_bin(f"{AZ} / {TAU}", COLS)} as col
      from (select *, sqrt(x * x + y * y + z * z) as r from v_points) where r >= 1.0 and r <= 80.0))
  group by all)"""
POLAR_SQL = f"""v_polar as (
  select scan_id, {_bin("r / 80.0", 20)} as "row", {_bin(f"{AZ} / {TAU}", COLS)} as col, z
  from (select *, sqrt(x * x + y * y) as r from v_points) where r >= 0.0 and r < 80.0 and z > -3.0)"""
GRID_SQL = 'v_grid as (select scan_id, "row", col, max(z) as val from v_polar group by all)'


def _range(spark, sf):
    return grids.range_image(points(spark, sf), ROWS, COLS, 1.0, 80.0, -30.0, 30.0)


def _polar(spark, sf):
    return grids.polar_cells(points(spark, sf), 20, COLS, R_MAX, 0.0, -3.0)


@query(f'{W}, {RANGE_SQL} select scan_id, "row", col, round(range, 6) as range, intensity from v_range')
def range_image_min(spark: SparkSession, sf: str) -> DataFrame:
    return _range(spark, sf).withColumn("range", r6("range"))


@query(f'{W}, {POLAR_SQL}, {GRID_SQL} select scan_id, "row", col, round(val, 6) as val from v_grid')
def bev_max_height(spark: SparkSession, sf: str) -> DataFrame:
    return grids.max_height(_polar(spark, sf)).withColumn("val", r6("val"))


@query(f'{W}, {POLAR_SQL} select scan_id, "row", col, bit_or((1 << {_bin("(z - -3.0) / 8.0", 8)})::int) as code from v_polar group by all')
def bev_iris_code(spark: SparkSession, sf: str) -> DataFrame:
    return grids.layer_code(_polar(spark, sf), -3.0, 5.0, 8)


@query(
    f"""{W}, {POLAR_SQL}, c as (select scan_id, "row", col, max(z) as top, min(z) as low, ln(1 + count(*) / (("row" + 0.5) * 4.0)) as d from v_polar group by scan_id, "row", col)
select scan_id, "row", col, round(least(greatest((top - -3.0) / 8.0, 0), 1), 6) as height, round(d / max(d) over (partition by scan_id), 6) as density, round((top - low) / 8.0, 6) as span from c"""
)
def bev_physics3(spark: SparkSession, sf: str) -> DataFrame:
    made = grids.physics3(_polar(spark, sf), -3.0, 5.0, 4.0)
    return made.select("scan_id", "row", "col", r6("height").alias("height"), r6("density").alias("density"), r6("span").alias("span"))


@query(
    f"""{W} select scan_id, {_bin("r / 80.0", 20)} as "row", {_bin(f"{AZ} / {TAU}", COLS)} as col, round(max(z), 6) as val
from (select *, sqrt(x * x + y * y) as r from v_points) where r > 0.1 and r < 80.0 group by all"""
)
def scan_context(spark: SparkSession, sf: str) -> DataFrame:
    cells = grids.polar_cells(points(spark, sf), 20, COLS, R_MAX, 0.1, open_low=True)
    return grids.max_height(cells).withColumn("val", r6("val"))


@query(
    f"""{W} select scan_id, {_bin("(x + 80.0) / 160.0", 40)} as "row", {_bin("(y + 80.0) / 160.0", 40)} as col, round(max(z) / 256, 6) as val
from v_points where abs(x) < 80.0 and abs(y) < 80.0 group by all"""
)
def cartesian_bev(spark: SparkSession, sf: str) -> DataFrame:
    return grids.cartesian_max(points(spark, sf), 40, 80.0).withColumn("val", r6("val"))


@query(
    f"""{W}, {POLAR_SQL}, {GRID_SQL}, f as (select scan_id, r as "row", coalesce(m, 0) as m from (select distinct scan_id from v_grid) s, range(20) t(r)
  left join (select scan_id as sid, "row" as rr, sum(val) / {COLS} as m from v_grid group by all) g on g.sid = s.scan_id and g.rr = t.r),
n as (select *, greatest(sqrt(sum(m * m) over (partition by scan_id)), 1e-8) as nn from f)
select scan_id, "row"::int as "row", round(m / nn, 6) + 0.0 as key from n"""
)
def ring_key(spark: SparkSession, sf: str) -> DataFrame:
    keys = grids.ring_key(grids.max_height(_polar(spark, sf)), 20, COLS)
    return keys.select("scan_id", F.posexplode("key").alias("row", "key")).withColumn("key", r6("key"))


def _pool_sql(axis: str, n: int, m: int, channels: int = 1, how: str = "mean") -> str:
    other = "col" if axis == "row" else "row"
    spans = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(grids.channel_windows(n, m, channels)))
    value = "sum(val) / any_value(b - a)" if how == "mean" else "case when count(*) < any_value(b - a) then greatest(max(val), 0) else max(val) end"
    return f"""{W}, {POLAR_SQL}, {GRID_SQL}, s(o, a, b) as (values {spans})
select scan_id, "{other}", o::int as "{axis}", round({value}, 6) + 0.0 as val from v_grid join s on "{axis}" >= a and "{axis}" < b group by scan_id, "{other}", o"""


@query(_pool_sql("row", 20, 6))
def pool_rows(spark: SparkSession, sf: str) -> DataFrame:
    return grids.pool(grids.max_height(_polar(spark, sf)), "row", 20, 6).withColumn("val", r6("val"))


@query(_pool_sql("row", 20, 6, 2))
def pool_channel_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A-09: the upper and the lower ten rows pooled apart."""
    return grids.pool(grids.max_height(_polar(spark, sf)), "row", 20, 6, 2).withColumn("val", r6("val"))


@query(_pool_sql("col", COLS, 16, 1, "max"))
def pool_max_cols(spark: SparkSession, sf: str) -> DataFrame:
    return grids.pool(grids.max_height(_polar(spark, sf)), "col", COLS, 16, how="max").withColumn("val", r6("val"))


@query(_pool_sql("col", COLS, 16))
def pool_cols(spark: SparkSession, sf: str) -> DataFrame:
    return grids.pool(grids.max_height(_polar(spark, sf)), "col", COLS, 16).withColumn("val", r6("val"))


@query(
    f"""{W}, {RANGE_SQL}, n as (
  select scan_id, "row", col as c0, range as v0,
         coalesce(lead(col) over w, first_value(col) over w + {COLS}) as c1, coalesce(lead(range) over w, first_value(range) over w) as v1
  from v_range window w as (partition by scan_id, "row" order by col rows between unbounded preceding and unbounded following))
select scan_id, "row", (c % {COLS})::int as col, round(v0 + (v1 - v0) * ((c - c0) / (c1 - c0)), 6) as val
from (select *, unnest(range(c0, c1)) as c from n)"""
)
def circular_gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    image = _range(spark, sf).select("scan_id", "row", "col", F.col("range").alias("val"))
    return grids.fill_gaps(image, COLS).withColumn("val", r6("val"))


@query(
    f"""{W}, {RANGE_SQL}, f as (select scan_id, "row", sum(range) as total, max(range) as most from v_range group by all),
src as (select scan_id, i::int as i, coalesce(max("row") filter (where "row" <= i), min("row")) as "row" from f, range({ROWS}) t(i) group by scan_id, i)
select scan_id, i as "row", round(total, 6) as total, round(most, 6) as most from src join f using (scan_id, "row")"""
)
def empty_row_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as sums of their cells, as one array a scan, with empty rows filled."""
    image = _range(spark, sf).groupBy("scan_id", "row").agg(F.array(F.sum("range"), F.max("range")).alias("r"))
    held = image.groupBy("scan_id").agg(F.map_from_entries(F.collect_list(F.struct("row", "r"))).alias("m"))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    grid = F.transform(F.sequence(F.lit(0), F.lit(ROWS - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), zero))
    filled = grids.fill_rows(held.select("scan_id", grid.alias("grid")), ROWS)
    return filled.select("scan_id", F.posexplode("grid").alias("row", "r")).select("scan_id", "row", r6(F.get("r", F.lit(0))).alias("total"), r6(F.get("r", F.lit(1))).alias("most"))


@query(
    f"""{W}, {RANGE_SQL} select scan_id, "row", col, round(range * cos(el) * cos(az), 6) + 0.0 as x, round(range * cos(el) * sin(az), 6) + 0.0 as y, round(range * sin(el), 6) + 0.0 as z
from (select *, radians(-30.0 + "row" * (60.0 / {ROWS})) as el, col * ({TAU} / {COLS}) - pi() as az from v_range) where range > 0"""
)
def unproject(spark: SparkSession, sf: str) -> DataFrame:
    made = grids.unproject(_range(spark, sf), ROWS, COLS, -30.0, 30.0)
    return made.select("scan_id", "row", "col", r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"))


@query(f"{W} select scan_id, count(*) as n, round(sum(cos(0.7) * x - sin(0.7) * y), 4) + 0.0 as sx, round(sum(sin(0.7) * x + cos(0.7) * y), 4) + 0.0 as sy from v_points group by scan_id")
def yaw_rotate(spark: SparkSession, sf: str) -> DataFrame:
    turned = grids.yaw_rotate(points(spark, sf), 0.7).groupBy("scan_id")
    return turned.agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("x"), 4) + 0.0).alias("sx"), (F.round(F.sum("y"), 4) + 0.0).alias("sy"))


@query(
    f"""{W}, {RANGE_SQL}, b as (select scan_id - 1 as scan_id, "row", col, range from v_range),
d as (select scan_id, avg(abs(a.range - b.range) / greatest(a.range, 1e-8)) as d from v_range a join b using (scan_id, "row", col) group by scan_id)
select scan_id, round(coalesce(d, 1.0), 6) as d from (select distinct scan_id from v_range) left join d using (scan_id)"""
)
def image_diff(spark: SparkSession, sf: str) -> DataFrame:
    a = _range(spark, sf)
    return grids.image_difference(a, a.withColumn("scan_id", F.col("scan_id") - 1), "range").withColumn("d", r6("d"))


def _voxel(t: str) -> str:
    return f"select distinct {t} as pair_id, floor(x / 4.0) as vx, floor(y / 4.0) as vy, floor(z / 4.0) as vz from v_points"


@query(
    f"""{W}, a as ({_voxel("scan_id")}), b as ({_voxel("scan_id - 1")})
select coalesce(a.pair_id, b.pair_id) as pair_id, round(count(*) filter (where a.pair_id is not null and b.pair_id is not null) / count(*), 6) as iou
from a full join b on a.pair_id = b.pair_id and a.vx = b.vx and a.vy = b.vy and a.vz = b.vz group by 1"""
)
def voxel_iou(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    a, b = p.withColumn("pair_id", F.col("scan_id")), p.withColumn("pair_id", F.col("scan_id") - 1)
    return grids.voxel_iou(a, b, 4.0).withColumn("iou", r6("iou"))
