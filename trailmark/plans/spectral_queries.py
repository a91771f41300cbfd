"""Queries of the spectral operators over descriptors seen as images of 4 rows by 16 sectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import spectral
from trailmark.plans.base import query, r6
from trailmark.plans.views import LAYOUT_SQL, descriptors

R, S, N, K = 4, 16, 9, 4
OCTAVE, EXPO = spectral.octave_edges(N), spectral.exponential_edges(N, 5, 1.5)
SPEC_SQL = LAYOUT_SQL + f""", v_spec as (
  select idx, "row", k::int as k, sum(val * cos(2 * pi() * j * k / {S})) as re, -sum(val * sin(2 * pi() * j * k / {S})) as im
  from (select idx, "row", unnest(vals) as val, generate_subscripts(vals, 1) - 1 as j from v_layout), range({N}) t(k) group by all),
v_mag as (select idx, "row", k, sqrt(re * re + im * im) as m from v_spec)"""
SKETCH_SQL = SPEC_SQL + f', v_sk as (select idx, "row", k, re, im from v_spec where k between 1 and {K})'


def _bins_sql(edges: list[float]) -> str:
    return "b(bin, i, j) as (values " + ", ".join(f"({b}, {i}, {j})" for b, (i, j) in enumerate(spectral.bins_of(edges, N))) + ")"


def _stats_sql(edges: list[float]) -> str:
    return f"""with {SPEC_SQL}, {_bins_sql(edges)}, v_bin as (
  select idx, "row", bin, coalesce(sum(m), 0) as total, coalesce(avg(m), 0) as mean, sqrt(coalesce(var_pop(m), 0) + 1e-8) as std, coalesce(max(m), 0) as most, coalesce(min(m), 0) as least
  from (select distinct idx, "row" from v_mag) cross join b left join v_mag using (idx, "row") where m is null or true and k >= i and k < j or j = i and k = 0 group by all)"""


def _mags(spark, sf) -> DataFrame:
    return descriptors(spark, sf).select("idx", "v", spectral.magnitudes(spectral.rfft(F.col("v"), R, 0, N - 1)).alias("m"))


def _sketch(spark, sf) -> DataFrame:
    return descriptors(spark, sf).select("idx", "v", spectral.rfft(F.col("v"), R, 1, K).alias("z"))


def _stats(spark, sf, edges) -> DataFrame:
    return _mags(spark, sf).select("idx", spectral.bin_statistics(F.col("m"), R, N, edges).alias("s"))


def _flat(df: DataFrame, array: str, n: int, name: str = "val") -> DataFrame:
    """One row a value, from an array of ``n`` values a row."""
    made = df.select("idx", F.posexplode(array).alias("p", name))
    return made.select("idx", F.floor(F.col("p") / n).cast("int").alias("row"), (F.col("p") % n).cast("int").alias("k"), r6(name).alias(name))


@query(f'with {SPEC_SQL} select idx, "row", k, round(m, 6) as val from v_mag')
def dft_magnitude(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_mags(spark, sf), "m", N)


_STAT_COLUMNS = 'idx, "row", bin, round(total, 6) as total, round(mean, 6) as mean, round(std, 5) as std, round(most, 6) as most, round(least, 6) as least'


def _stat_rows(df: DataFrame) -> DataFrame:
    rows = df.select("idx", F.inline("s"))
    return rows.select("idx", "row", "bin", r6("total").alias("total"), r6("mean").alias("mean"), F.round("std", 5).alias("std"), r6("most").alias("most"), r6("least").alias("least"))


@query(f"{_stats_sql(OCTAVE)} select {_STAT_COLUMNS} from v_bin")
def octave_bin_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _stat_rows(_stats(spark, sf, OCTAVE))


@query(f"{_stats_sql(EXPO)} select {_STAT_COLUMNS} from v_bin")
def exp_bin_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _stat_rows(_stats(spark, sf, EXPO))


def _inter_sql(expr: str) -> str:
    return f"""{_stats_sql(OCTAVE)} select idx, "row", bin, round({expr}, 6) + 0.0 as d from (select *, lead(mean) over (partition by idx, "row" order by bin) as nxt from v_bin) where nxt is not null"""


@query(_inter_sql("nxt - mean"))
def interbin_diff(spark: SparkSession, sf: str) -> DataFrame:
    made = _stats(spark, sf, OCTAVE).select("idx", F.inline(spectral.inter_bin(F.col("s"), "mean", 5, False)))
    return made.withColumn("d", r6("d"))


@query(_inter_sql("ln(nxt + 1e-8) - ln(mean + 1e-8)"))
def interbin_ratio(spark: SparkSession, sf: str) -> DataFrame:
    made = _stats(spark, sf, OCTAVE).select("idx", F.inline(spectral.inter_bin(F.col("s"), "mean", 5, True)))
    return made.withColumn("d", r6("d"))


@query(
    f"""{_stats_sql(OCTAVE)}, c as (select idx, 0 as ch, "row" * 5 + bin as p, mean as val from v_bin union all select idx, 1, "row" * 5 + bin, std from v_bin)
select idx, ch::int as ch, p::int as p, round(val / greatest(sqrt(sum(val * val) over (partition by idx, ch)), 1e-8), 5) as val from c"""
)
def descriptor_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """SP-03: mean and deviation channels, each of unit length."""
    s = _stats(spark, sf, OCTAVE)
    channels = F.array(*[F.struct(F.lit(i).alias("ch"), spectral.unit(F.col(f"s.{name}")).alias("v")) for i, name in enumerate(("mean", "std"))])
    return s.select("idx", F.inline(channels)).select("idx", "ch", F.posexplode("v").alias("p", "val")).withColumn("val", F.round("val", 5))


@query(
    f"""with {SPEC_SQL} select idx, round(avg(h), 6) as h from (select idx, "row", -sum(m * m / t * ln(m * m / t + 1e-8)) as h
from (select *, sum(m * m) over (partition by idx, "row") + 1e-8 as t from v_mag) group by idx, "row") group by idx"""
)
def spectral_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return _mags(spark, sf).select("idx", r6(spectral.entropy(F.col("m"), R, N)).alias("h"))


CROSS_SQL = """c as (select a.idx, a."row", a.k, (a.re * b.re + a.im * b.im) / s as re, (a.im * b.re - a.re * b.im) / s as im
  from (select a.*, sqrt(a.re * a.re + a.im * a.im) * sqrt(b.re * b.re + b.im * b.im) + 1e-8 as s from v_sk a join v_sk b on a.idx = b.idx and a.k = b.k and b."row" = a."row" + 1) a
  join v_sk b on a.idx = b.idx and a.k = b.k and b."row" = a."row" + 1)"""


@query(f'with {SKETCH_SQL}, {CROSS_SQL} select idx, "row", k - 1 as k, round(re, 6) + 0.0 as re, round(im, 6) + 0.0 as im from c')
def cross_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    made = _sketch(spark, sf).select("idx", F.posexplode(spectral.cross_spectrum(F.col("z"), R, K)).alias("p", "c"))
    return made.select("idx", F.floor(F.col("p") / K).cast("int").alias("row"), (F.col("p") % K).cast("int").alias("k"), r6("c.re").alias("re"), r6("c.im").alias("im"))


@query(f'with {SKETCH_SQL} select idx, "row", k - 1 as k, round(re, 6) + 0.0 as re, round(im, 6) + 0.0 as im from v_sk')
def phase_sketch(spark: SparkSession, sf: str) -> DataFrame:
    made = _sketch(spark, sf).select("idx", F.posexplode(F.arrays_zip("z.re", "z.im")).alias("p", "c"))
    return made.select("idx", F.floor(F.col("p") / K).cast("int").alias("row"), (F.col("p") % K).cast("int").alias("k"), r6("c.re").alias("re"), r6("c.im").alias("im"))


@query(f'with {SKETCH_SQL} select idx, "row", k - 1 as k, round(m / greatest(sqrt(sum(m * m) over (partition by idx)), 1e-8), 6) as val from (select *, sqrt(re * re + im * im) as m from v_sk)')
def phase_sketch_key(spark: SparkSession, sf: str) -> DataFrame:
    made = _sketch(spark, sf).select("idx", spectral.unit(spectral.magnitudes(F.col("z"))).alias("key"))
    return _flat(made, "key", K)


@query(f'with {SKETCH_SQL}, {CROSS_SQL} select idx, round(sum(ln(1 + m)), 5) as mag, round(any_value(cr), 5) + 0.0 as cross_re from (select idx, sqrt(re * re + im * im) as m from v_sk) join (select idx, sum(re) as cr from c group by idx) using (idx) group by idx')
def phase_features(spark: SparkSession, sf: str) -> DataFrame:
    """SP-07: log magnitudes next to the cross spectrum, summed."""
    z = _sketch(spark, sf)
    mag = F.aggregate(spectral.magnitudes(F.col("z")), F.lit(0.0), lambda a, m: a + F.log1p(m))
    cross = F.aggregate(spectral.cross_spectrum(F.col("z"), R, K), F.lit(0.0), lambda a, c: a + c["re"])
    return z.select("idx", F.round(mag, 5).alias("mag"), (F.round(cross, 5) + 0.0).alias("cross_re"))


@query(f'with {SKETCH_SQL} select idx, "row", k - 1 as k, round(ln(1 + re * re + im * im), 6) as val from v_sk')
def power_features(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_sketch(spark, sf).select("idx", spectral.power(F.col("z")).alias("p")), "p", K)


@query(
    f"""with {SKETCH_SQL} select idx, "row", k1, k2, round(re * e + im * f, 6) + 0.0 as re, round(im * e - re * f, 6) + 0.0 as im from (
  select a.idx, a."row", a.k as k1, b.k as k2, a.re * b.re - a.im * b.im as re, a.re * b.im + a.im * b.re as im, c.re as e, c.im as f
  from v_sk a join v_sk b on a.idx = b.idx and a."row" = b."row" and a.k <= b.k join v_sk c on c.idx = a.idx and c."row" = a."row" and c.k = a.k + b.k)"""
)
def bispectrum(spark: SparkSession, sf: str) -> DataFrame:
    made = _sketch(spark, sf).select("idx", F.inline(spectral.bispectrum(F.col("z"), R, K)))
    return made.select("idx", "row", "k1", "k2", r6("re").alias("re"), r6("im").alias("im"))


CURVE_SQL = f"""{SKETCH_SQL}, x as (
  select a.idx as q, b.idx as c, a.k, sum(a.re * b.re + a.im * b.im) as re, sum(a.re * b.im - a.im * b.re) as im
  from v_sk a join v_sk b on b.idx = a.idx + 1 and a."row" = b."row" and a.k = b.k group by all),
nr as (select idx, sqrt(sum(re * re + im * im)) as n from v_sk group by idx),
curve as (
  select q, c, s::int as s, sum(re * cos(2 * pi() * k * s / {S}) + im * sin(2 * pi() * k * s / {S})) / greatest(any_value(a.n * b.n), 1e-8) as sim
  from x join nr a on a.idx = q join nr b on b.idx = c, range({S}) t(s) group by q, c, s)"""


def _pairs(df: DataFrame, *cols: str) -> DataFrame:
    """Each row with the next one by ``idx``."""
    a = df.select(F.col("idx").alias("q"), *[F.col(c).alias(f"q_{c}") for c in cols])
    b = df.select(F.col("idx").alias("c"), *[F.col(c).alias(f"c_{c}") for c in cols])
    return a.join(b, F.col("c") == F.col("q") + 1)


@query(f"with {CURVE_SQL} select q, c, round(max(sim), 6) as sim from curve group by all")
def cyclic_shift_sketch(spark: SparkSession, sf: str) -> DataFrame:
    curve = spectral.shift_curve(F.col("q_z"), F.col("c_z"), R, K, S)
    return _pairs(_sketch(spark, sf), "z").select("q", "c", r6(F.array_max(curve)).alias("sim"))


@query(
    f"""with {CURVE_SQL}, w as (select *, max(sim) over (partition by q, c) as best, row_number() over (partition by q, c order by sim desc, s) as rn from curve),
e as (select q, c, max(best) as score, max(case when rn = 1 then s end) as s, max(best) - max(case when rn = 2 then sim end) as margin, sum(exp((sim - best) / 0.05)) as mass from w group by q, c),
h as (select q, c, -sum(exp((sim - best) / 0.05) / mass * ln(greatest(exp((sim - best) / 0.05) / mass, 1e-8))) / ln({S}.0) as ent from w join e using (q, c) group by q, c)
select q, c, round(score, 6) as score, round(sin(2 * pi() * s / {S}), 6) + 0.0 as shift_sin, round(cos(2 * pi() * s / {S}), 6) + 0.0 as shift_cos, round(margin, 6) as margin, round(ent, 6) as entropy from e join h using (q, c)"""
)
def alignment_features(spark: SparkSession, sf: str) -> DataFrame:
    curve = spectral.shift_curve(F.col("q_z"), F.col("c_z"), R, K, S)
    made = _pairs(_sketch(spark, sf), "z").select("q", "c", spectral.alignment_features(curve, S).alias("f"))
    return made.select("q", "c", *[r6(f"f.{n}").alias(n) for n in ("score", "shift_sin", "shift_cos", "margin", "entropy")])


@query(
    f"""with {SKETCH_SQL}, g as (select q, c, "row", k, re / (sqrt(re * re + im * im) + 1e-6) as re, im / (sqrt(re * re + im * im) + 1e-6) as im from (
  select a.idx as q, b.idx as c, a."row", a.k, a.re * b.re + a.im * b.im as re, a.im * b.re - a.re * b.im as im from v_sk a join v_sk b on b.idx = a.idx + 1 and a."row" = b."row" and a.k = b.k)),
p as (select q, c, "row", n, sqrt(pow(sum(re * cos(2 * pi() * (k - 1) * n / {4 * K}) - im * sin(2 * pi() * (k - 1) * n / {4 * K})), 2) + pow(sum(re * sin(2 * pi() * (k - 1) * n / {4 * K}) + im * cos(2 * pi() * (k - 1) * n / {4 * K})), 2)) / {K} as m
  from g, range({4 * K}) t(n) group by q, c, "row", n)
select q, c, round(avg(m), 6) as sim from (select q, c, "row", least(greatest(max(m), 0), 1) as m from p group by all) group by q, c"""
)
def poc_coherence(spark: SparkSession, sf: str) -> DataFrame:
    peak = spectral.phase_only_peak(F.col("q_z"), F.col("c_z"), R, K)
    return _pairs(_sketch(spark, sf), "z").select("q", "c", r6(peak).alias("sim"))


@query(
    f"""with {LAYOUT_SQL}, cell as (select idx, "row", generate_subscripts(vals, 1) - 1 as j, unnest(vals) as val from v_layout),
nr as (select idx, j, sqrt(sum(val * val)) as n from cell group by all),
d as (select a.idx as q, b.idx as c, a.j, s, sum(a.val * b.val) as dot from cell a, range({S}) t(s) join cell b on b.idx = a.idx + 1 and b."row" = a."row" and b.j = (a.j - s + {S}) % {S} group by all),
e as (select q, c, s, sum(case when x.n > 1e-8 and y.n > 1e-8 then 1 - dot / (x.n * y.n + 1e-8) else 0 end) / greatest(sum(case when x.n > 1e-8 and y.n > 1e-8 then 1 else 0 end), 1) as dist
  from d join nr x on x.idx = q and x.j = d.j join nr y on y.idx = c and y.j = (d.j - s + {S}) % {S} group by q, c, s)
select q, c, round(min(dist), 6) as dist from e group by q, c"""
)
def cyclic_shift_layout(spark: SparkSession, sf: str) -> DataFrame:
    least = spectral.column_shift_distance(F.col("q_v"), F.col("c_v"), R, S)
    return _pairs(descriptors(spark, sf), "v").select("q", "c", r6(least).alias("dist"))


_WEIGHTS = spectral.soft_bins(N, OCTAVE)


@query(
    f"""with {SPEC_SQL}, w(bin, k, x) as (values {", ".join(f"({b}, {k}, {x!r}::double)" for b, one in enumerate(_WEIGHTS) for k, x in enumerate(one))})
select idx, "row", bin::int as k, round(sum(m * x), 6) as val from v_mag join w using (k) group by idx, "row", bin"""
)
def soft_binning_octave(spark: SparkSession, sf: str) -> DataFrame:
    made = _mags(spark, sf).select("idx", spectral.soft_binned(F.col("m"), R, N, _WEIGHTS).alias("b"))
    return _flat(made, "b", len(_WEIGHTS))
