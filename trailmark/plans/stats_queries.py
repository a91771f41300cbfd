"""Queries of fitted statistics, Bayesian tests and evaluation roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import knn, retrieval as rt, stats, trajectory as tr
from trailmark.plans.base import query, r6
from trailmark.plans.retrieval_queries import COS, HIT_SQL, NEAR, QUERY_SQL, TOP_SQL, D, _base, _hits, _queries, _top
from trailmark.plans.views import DESC_SQL, POSE_SQL, descriptors, posed, poses

PAIRS = 20_000
SIM = "list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)))"
PAIR_SQL = f"""sz as (select seq_id, count(*) as n, min(idx) as first, row_number() over (order by seq_id) - 1 as place, count(*) over () as every from v_posed group by seq_id),
pr as (select k, first + (k * 7919 + 13) % n as i, first + (k * 104729 + (k // 97) * 31 + 7) % n as j from range({PAIRS}) t(k) join sz on place = k % every where i <> j)"""
OBS_SQL = f"""ob as (select k, i, j, {SIM} as sim, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda x: pow(x[1] - x[2], 2)))) as l2, {NEAR} as geo,
  abs(degrees(atan2(sin(a.yaw - b.yaw), cos(a.yaw - b.yaw)))) as turn from pr join v_posed a on a.idx = i join v_posed b on b.idx = j)"""


def _pairs(spark, sf) -> DataFrame:
    nodes = posed(spark, sf)
    met = stats.with_ends(stats.sample_pairs(nodes, PAIRS), nodes, "x", "y", "z", "yaw", "v")
    geo = F.sqrt(sum(((F.col(f"i_{c}") - F.col(f"j_{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    l2 = knn.norm(F.zip_with("i_v", "j_v", lambda x, y: x - y))
    return met.select("k", "i", "j", knn.cosine(F.col("i_v"), F.col("j_v")).alias("sim"), l2.alias("l2"), geo.alias("geo"), F.abs(tr.wrapped_degrees(F.col("j_yaw"), F.col("i_yaw"))).alias("turn"))


@query(f"with {DESC_SQL}, f as (select generate_subscripts(v, 1) - 1 as dim, unnest(v) as x from v_desc) select dim, round(avg(x), 6) + 0.0 as mean, round(greatest(stddev_pop(x), 1e-8), 6) as std from f group by dim")
def zscore_stats(spark: SparkSession, sf: str) -> DataFrame:
    fitted = stats.column_stats(descriptors(spark, sf), "v")
    made = fitted.select(F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "s"))
    return made.select(F.col("dim").cast("long").alias("dim"), r6("s.mean").alias("mean"), r6("s.std").alias("std"))


@query(
    f"""with {DESC_SQL}, f as (select idx, generate_subscripts(v, 1) as dim, unnest(v) as x from v_desc), z as (select idx, dim, (x - avg(x) over w) / greatest(stddev_pop(x) over w, 1e-8) as x from f window w as (partition by dim))
select idx, round(sum(x), 5) + 0.0 as total, round(sum(abs(x)), 5) as size from z group by idx"""
)
def zscore_transform(spark: SparkSession, sf: str) -> DataFrame:
    rows = descriptors(spark, sf)
    made = stats.standardize(rows, "v", stats.column_stats(rows, "v"))
    return made.select("idx", (F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5) + 0.0).alias("total"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x)), 5).alias("size"))


@query(f"{D}, {PAIR_SQL}, {OBS_SQL} select k, i, j, round(sim, 6) + 0.0 as sim, round(geo, 6) + 0.0 as geo from ob")
def pair_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("k", "i", "j", r6("sim").alias("sim"), r6("geo").alias("geo"))


FIT_SQL = """fit as (select count(*) filter (where geo < 5) as n_same, count(*) filter (where geo > 10) as n_diff, avg(z) filter (where geo < 5) as mu_same, greatest(stddev_pop(z) filter (where geo < 5), 1e-6) as sigma_same,
  avg(z) filter (where geo > 10) as mu_diff, greatest(stddev_pop(z) filter (where geo > 10), 1e-6) as sigma_diff from (select *, atanh(least(greatest(sim, -0.9999), 0.9999)) as z from ob where abs(i - j) >= 30))"""


def _fit(pairs: DataFrame) -> DataFrame:
    return stats.fit_places(pairs.where(F.abs(F.col("i") - F.col("j")) >= 30), stats.fisher(F.col("sim")), "geo")


@query(f"{D}, {PAIR_SQL}, {OBS_SQL}, {FIT_SQL} select n_same, n_diff, n_same >= 10 and n_diff >= 10 as fitted, round(mu_same, 6) as mu_same, round(sigma_same, 6) as sigma_same, round(mu_diff, 6) as mu_diff, round(sigma_diff, 6) as sigma_diff from fit")
def gaussian_fit(spark: SparkSession, sf: str) -> DataFrame:
    made = _fit(_pairs(spark, sf))
    return made.select("n_same", "n_diff", "fitted", *[r6(c).alias(c) for c in ("mu_same", "sigma_same", "mu_diff", "sigma_diff")])


def _pdf(kind: str) -> str:
    return f"exp(-0.5 * pow((atanh(least(greatest(sim, -0.9999), 0.9999)) - mu_{kind}) / sigma_{kind}, 2)) / (sigma_{kind} * sqrt(2 * pi()))"


@query(f"{D}, {PAIR_SQL}, {OBS_SQL}, {FIT_SQL} select k, round({_pdf('same')} * 0.05 / greatest({_pdf('same')} * 0.05 + {_pdf('diff')} * 0.95, 1e-30), 6) as post from ob, fit")
def posterior(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf)
    return pairs.select("k", r6(stats.posterior(F.col("sim"), F.lit(0.05), _fit(pairs))).alias("post"))


DENSITY_SQL = "dn as (select q, avg(score) as density from top where rank <= 10 group by q)"


def _density(df: DataFrame) -> DataFrame:
    return _top(df).where("rank <= 10").groupBy("q").agg(F.avg("score").alias("density"))


@query(f"{D}, {TOP_SQL}, {DENSITY_SQL} select q, round(density, 6) as density, round(0.01 / (1 + exp(10.0 * (density - (select quantile_cont(density, 0.5) from dn)))), 8) as prior from dn")
def density_prior(spark: SparkSession, sf: str) -> DataFrame:
    made = stats.density_prior(_density(_base(spark, sf)), "density")
    return made.select("q", r6("density").alias("density"), F.round("prior", 8).alias("prior"))


@query(f"{D}, {TOP_SQL}, {DENSITY_SQL} select q, round(0.01 / (1 + exp(-10.0 * (density - (select quantile_cont(density, 0.5) from dn)))), 8) as prior from dn")
def entropy_prior(spark: SparkSession, sf: str) -> DataFrame:
    """The prior's other direction, over the same signal."""
    return stats.entropy_prior(_density(_base(spark, sf)), "density").select("q", F.round("prior", 8).alias("prior"))


def _rate_sql(name: str, where: str) -> str:
    n, hit = f"count(*) filter (where geo >= 25 and {where})", f"count(*) filter (where geo >= 25 and {where} and l2 <= 1.3)"
    return f"round(case when {n} > 0 then {hit} / {n} else 'nan'::double end, 6) as rate_{name}, {n} as n_{name}, {hit} as hits_{name}"


@query(f"{D}, {PAIR_SQL}, {OBS_SQL} select {_rate_sql('all', 'true')}, {_rate_sql('forward', 'turn <= 30')}, {_rate_sql('reverse', 'turn > 90')} from ob")
def alias_rate(spark: SparkSession, sf: str) -> DataFrame:
    made = stats.alias_rate(_pairs(spark, sf).withColumnRenamed("l2", "desc"), 1.3, 25.0)
    return made.withColumns({c: r6(c) for c in ("rate_all", "rate_forward", "rate_reverse")})


RECORD_SQL = f"""{TOP_SQL}, {QUERY_SQL}, rec as (select qs.q, coalesce({NEAR} < 5.0, false) as hit, t.score as score, {NEAR} as d, coalesce(p.rank - 1, -1) as place,
  abs(degrees(atan2(sin(m.yaw - a.yaw), cos(m.yaw - a.yaw)))) as turn, qs.q % 4 as seq, qs.q % 2 as sensor
  from qs join v_posed a on a.idx = qs.q join v_posed m on m.idx = qs.match left join top t on t.q = qs.q and t.rank = 1 left join v_posed b on b.idx = t.c left join top p on p.q = qs.q and p.c = qs.match)"""


def _records(spark, sf) -> DataFrame:
    """Per query: whether its first candidate hits, its score and distance, the true match's rank, and the turn to it."""
    df = posed(spark, sf).select("seq_id", "idx", "v", "x", "y", "z", "yaw")
    top, asked = _top(df), _queries(df)
    first = _hits(top, df).where("rank = 1").select("q", "hit", "score", "d")
    yaw = df.select("idx", "yaw")
    turned = asked.join(yaw.select(F.col("idx").alias("q"), F.col("yaw").alias("y0")), "q").join(yaw.select(F.col("idx").alias("match"), F.col("yaw").alias("y1")), "match")
    made = turned.join(rt.match_rank(top, asked).select("q", "place"), "q").join(first, "q", "left")
    return made.select("q", F.coalesce("hit", F.lit(False)).alias("hit"), "score", "d", "place", F.abs(tr.wrapped_degrees(F.col("y0"), F.col("y1"))).alias("turn"), (F.col("q") % 4).alias("seq"), (F.col("q") % 2).alias("sensor"))


@query(f"{D}, {RECORD_SQL} select coalesce(bin, 'all') as bin, round(avg(hit::int), 6) as r1, count(*) as n from (select *, case when turn <= 30 then 'forward' when turn <= 90 then 'oblique' else 'reverse' end as bin from rec) group by rollup (bin)")
def yaw_recall(spark: SparkSession, sf: str) -> DataFrame:
    return stats.by_yaw(_records(spark, sf)).withColumn("r1", r6("r1"))


@query(
    f"""{D}, {RECORD_SQL} select count(*) as n, round(avg(hit::int), 6) as recall_at_1, round(avg((place = 0)::int), 6) as top1, round(avg((place between 0 and 4)::int), 6) as top5, round(avg((place between 0 and 9)::int), 6) as top10, round(avg((place = -1)::int), 6) as never,
round(avg(score), 6) as score_mean, round(stddev_pop(score), 6) as score_std, round(quantile_cont(d, 0.5), 5) as d_p50, round(quantile_cont(d, 0.9), 5) as d_p90 from rec"""
)
def failure_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    made = stats.failure_breakdown(_records(spark, sf))
    return made.select("n", *[r6(c).alias(c) for c in ("recall_at_1", "top1", "top5", "top10", "never", "score_mean", "score_std")], F.round("d_p50", 5).alias("d_p50"), F.round("d_p90", 5).alias("d_p90"))


@query(
    f"""{D}, {RECORD_SQL}, sq as (select sensor, seq, sum(hit::int) as s, count(*) as n, avg(hit::int) as m from rec group by all), se as (select sensor, sum(s) as s, sum(n) as n, sum(m) as ms, count(*) as k, avg(m) as m from sq group by all)
select round(sum(s) / sum(n), 6) as r_query, round(sum(ms) / sum(k), 6) as r_sequence, round(avg(m), 6) as r_sensor, round(stddev_pop(m), 6) as sigma_sensor, round(min(m), 6) as r_min from se"""
)
def macro_average(spark: SparkSession, sf: str) -> DataFrame:
    made = stats.macro_average(_records(spark, sf).withColumn("hit", F.col("hit").cast("double")), "seq", "sensor", "hit")
    return made.select(*[r6(c).alias(c) for c in made.columns])


LEVELS = [0.1, 0.2, 0.3, 0.4, 0.5]
TRUE_SQL = f"tp as (select a.idx, b.idx as j from v_posed a join v_posed b on a.seq_id = b.seq_id and b.idx <= a.idx - 30 and {NEAR} < 5.0)"


@query(
    f"""{D}, {TRUE_SQL}, ap as materialized (select {COS} as score, {NEAR} < 5.0 as hit from v_posed a join v_posed b on a.seq_id = b.seq_id and b.idx <= a.idx - 30),
  c as (select t.threshold::double as threshold, count(score) as n_edges, count(*) filter (where score is not null and hit) as n_true from (select unnest({LEVELS}) as threshold) t
  left join ap on ap.score >= t.threshold group by all), r as (select *, case when n_edges > 0 then n_true / n_edges else 0 end as p, n_true / (select count(*) from tp) as rc from c)
select threshold, n_edges, n_true, round(p, 6) as precision, round(rc, 6) as recall, round(case when p + rc > 0 then 2 * p * rc / (p + rc) else 0 end, 6) as f1 from r"""
)
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """A-21 over all pairs: blocks count, no pair is listed."""
    df = _base(spark, sf)
    truths = tr.earlier_near(df, 5.0, 30)
    made = stats.rated(knn.level_counts(df, LEVELS, 5.0, gap=30, past_only=True), truths)
    return made.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


BOOT = 10_000
POISSON_SQL = ", ".join(str(int(share * stats.PRIME)) for share in stats.POISSON)


def _mixed_sql(rounds: int) -> str:
    h = f"((p * 48271 + b * 69621 + 1) % {stats.PRIME})"
    out = [f"h0 as (select p, b, x, {h} as h from s, range({BOOT}) r(b))"]
    return ", ".join(out + [f"h{k + 1} as (select p, b, x, (h * h + p + b) % {stats.PRIME} as h from h{k})" for k in range(rounds)])


@query(
    f"""with {POSE_SQL}, s as (select seq_id::bigint as p, avg(y) as x from v_pose group by seq_id), {_mixed_sql(3)},
c as (select b, x, len(list_filter([{POISSON_SQL}], lambda t: t <= h)) as n from h3), m as (select sum(n * x) / sum(n) as m from c group by b having sum(n) > 0)
select round(quantile_cont(m, 0.025), 6) + 0.0 as low, round(quantile_cont(m, 0.975), 6) + 0.0 as high from m"""
)
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    values = poses(spark, sf).groupBy("seq_id").agg(F.avg("y").alias("x"))
    made = stats.bootstrap_interval(values, "x", "seq_id", BOOT)
    return made.select(r6("low").alias("low"), r6("high").alias("high"))
