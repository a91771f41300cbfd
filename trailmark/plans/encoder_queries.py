"""Queries of the encoder over the point view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import encoder, grids, spectral
from trailmark.plans.base import query, r6
from trailmark.plans.grid_queries import COLS, GRID_SQL, POLAR_SQL, RANGE_SQL, ROWS, W, _polar
from trailmark.plans.views import points

SPEC = encoder.Spec(rows=ROWS, cols=COLS, out_rows=8, e_min=-30.0, e_max=30.0, layout_cols=12)
R, N, BINS = SPEC.out_rows, SPEC.freqs, spectral.bins_of(SPEC.bins, SPEC.freqs)


def _spans(n: int, m: int) -> str:
    return ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(grids.adaptive_windows(n, m)))


FULL_SQL = f"""{RANGE_SQL}, gap as (
  select scan_id, "row", col as c0, range as v0, coalesce(lead(col) over w, first_value(col) over w + {COLS}) as c1, coalesce(lead(range) over w, first_value(range) over w) as v1
  from v_range window w as (partition by scan_id, "row" order by col rows between unbounded preceding and unbounded following)),
filled as materialized (select scan_id, "row", (c % {COLS})::int as col, v0 + (v1 - v0) * ((c - c0) / (c1 - c0)) as val from (select *, unnest(range(c0, c1)) as c from gap)),
src as (select s.scan_id, i::int as i, coalesce(max(s."row") filter (where s."row" <= i), min(s."row")) as "row" from (select distinct scan_id, "row" from filled) s, range({ROWS}) t(i) group by s.scan_id, i),
grid as materialized (select scan_id, i, col, val from src join filled using (scan_id, "row")),
spans(r, a, b) as (values {_spans(ROWS, R)}),
image as materialized (select scan_id, r, col, sum(val) / any_value(b - a) as val from grid join spans on i >= a and i < b group by scan_id, r, col)"""
SPECTRUM_SQL = f"""{FULL_SQL}, spec as materialized (select scan_id, r, k::int as k, sum(val * cos(2 * pi() * col * k / {COLS})) as re, -sum(val * sin(2 * pi() * col * k / {COLS})) as im from image, range({N}) t(k) group by all),
mag as materialized (select scan_id, r, k, sqrt(re * re + im * im) as m from spec)"""


@query(f"""{W}, {FULL_SQL} select scan_id, i as "row", round(sum(val), 6) as total, round(max(val), 6) as most from grid group by scan_id, i""")
def full_image_rows(spark: SparkSession, sf: str) -> DataFrame:
    """W-09 as a whole: gaps, then empty rows."""
    cells = grids.range_image(points(spark, sf), ROWS, COLS, 1.0, 80.0, -30.0, 30.0)
    made = encoder.full_rows(cells.select("scan_id", "row", "col", F.col("range").alias("val")), ROWS, COLS)
    rows = made.select("scan_id", F.posexplode("grid").alias("row", "v"))
    return rows.select("scan_id", "row", r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"), r6(F.array_max("v")).alias("most"))


@query(
    f"""{W}, {SPECTRUM_SQL}, b(bin, i, j) as (values {", ".join(f"({b}, {i}, {j})" for b, (i, j) in enumerate(BINS))}),
st as materialized (select scan_id, r, bin, avg(m) as mean, sqrt(var_pop(m) + 1e-8) as std from mag join b on k >= i and k < j group by all),
ch as (
  select scan_id, 0 as ch, r * {len(BINS)} + bin as p, mean as x from st union all select scan_id, 1, r * {len(BINS)} + bin, std from st
  union all select scan_id, 2, r * {len(BINS) - 1} + bin, d from (select *, lead(mean) over (partition by scan_id, r order by bin) - mean as d from st) where d is not null
  union all select scan_id, 3, r * {len(BINS) - 1} + bin, d from (select *, lead(std) over (partition by scan_id, r order by bin) - std as d from st) where d is not null),
en as (select scan_id, avg(h) as h from (select scan_id, r, -sum(m * m / t * ln(m * m / t + 1e-8)) as h from (select *, sum(m * m) over (partition by scan_id, r) + 1e-8 as t from mag) group by scan_id, r) group by scan_id)
select scan_id, ch::int as ch, p::int as p, round(x / greatest(sqrt(sum(x * x) over (partition by scan_id, ch)), 1e-12), 4) + 0.0 as val from ch
union all select scan_id, -1, 0, round(h, 4) from en"""
)
def encode_points(spark: SparkSession, sf: str) -> DataFrame:
    """SP-04: every channel of every scan's descriptor, and its entropy as channel -1."""
    made = encoder.encode_points(points(spark, sf), SPEC, keep=True)
    each = made.select("scan_id", F.posexplode("channels").alias("ch", "c")).select("scan_id", "ch", F.posexplode("c").alias("p", "x"))
    entropy = made.select("scan_id", F.lit(-1).alias("ch"), F.lit(0).alias("p"), F.col("entropy").alias("x"))
    return each.unionByName(entropy).select("scan_id", "ch", "p", (F.round("x", 4) + 0.0).alias("val"))


@query(f"""{W}, {FULL_SQL}, cs(o, a, b) as (values {_spans(COLS, SPEC.layout_cols)}) select scan_id, r::int as "row", o::int as col, round(sum(val) / any_value(b - a), 6) as val from image join cs on col >= a and col < b group by scan_id, r, o""")
def layout_projection(spark: SparkSession, sf: str) -> DataFrame:
    """SP-13: the layout that a scan keeps beside its descriptor."""
    made = encoder.encode_points(points(spark, sf), SPEC).select("scan_id", F.posexplode("layout").alias("p", "val"))
    n = SPEC.layout_cols
    return made.select("scan_id", F.floor(F.col("p") / n).cast("int").alias("row"), (F.col("p") % n).cast("int").alias("col"), r6("val").alias("val"))


COARSE, KEPT = 5, 3


@query(
    f"""{W}, {POLAR_SQL}, {GRID_SQL}, cell as materialized (select s.scan_id, r::int as r, c::int as c, coalesce(val, 0) as val from (select distinct scan_id from v_grid) s, range(20) t(r), range({COLS}) u(c) left join v_grid g on g.scan_id = s.scan_id and g."row" = r and g.col = c),
rk as (select scan_id, r, avg(val) as k from cell group by all), rv as materialized (select scan_id, list(k order by r) as v from rk group by scan_id),
top as (select * from (select q, c, row_number() over (partition by q order by score desc, c) as rank from (select a.scan_id as q, b.scan_id as c,
  round(list_inner_product(a.v, b.v) / (greatest(sqrt(list_inner_product(a.v, a.v)), 1e-8) * greatest(sqrt(list_inner_product(b.v, b.v)), 1e-8)), 9) as score from rv a join rv b on a.scan_id <> b.scan_id)) where rank <= {COARSE}),
cv as materialized (select scan_id, c, list(val order by r) as v, sqrt(sum(val * val)) as n from cell group by all),
e as (select q, t.c as cand, s, sum(case when x.n > 1e-8 and y.n > 1e-8 then 1 - list_inner_product(x.v, y.v) / (x.n * y.n + 1e-8) else 0 end) / greatest(sum(case when x.n > 1e-8 and y.n > 1e-8 then 1 else 0 end), 1) as dist
  from top t join cv x on x.scan_id = q, range({COLS}) u(s) join cv y on y.scan_id = t.c and y.c = (x.c - s + {COLS}) % {COLS} group by all)
select q, cand as c, round(round(dist, 9), 6) as dist, rank from (select *, row_number() over (partition by q order by round(dist, 9), cand) as rank from (select q, cand, min(dist) as dist from e group by all)) where rank <= {KEPT}"""
)
def two_stage_context(spark: SparkSession, sf: str) -> DataFrame:
    """BL-02: ring keys fetch candidates, the least column-shift distance of the whole matrices orders them."""
    made = encoder.dense_images(grids.max_height(_polar(spark, sf)), 20, COLS)
    ring = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda r: F.aggregate(F.slice("image", r * COLS + 1, COLS), F.lit(0.0), lambda s, x: s + x) / COLS)
    keys = made.select(F.lit(0).alias("seq_id"), F.col("scan_id").alias("idx"), "image", ring.alias("v"))
    return encoder.two_stage(keys, COARSE, KEPT, 20, COLS).select("q", "c", r6("dist").alias("dist"), F.col("rank").cast("long").alias("rank"))
