"""Queries of retrieval, fusion and recall over the posed descriptors of all sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import diagnostics as dg, knn, retrieval as rt, trajectory as tr
from trailmark.plans.base import query, r6
from trailmark.plans.views import DESC_SQL, POSED_SQL, descriptors, posed

D = f"with {POSED_SQL.replace('v_posed as (', 'v_posed as materialized (', 1)}"
COS = "round(list_inner_product(a.v, b.v) / (greatest(sqrt(list_inner_product(a.v, a.v)), 1e-8) * greatest(sqrt(list_inner_product(b.v, b.v)), 1e-8)), 9)"
L2 = "round(-sqrt(greatest(list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(a.v, b.v), 0)), 9)"
NEAR = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"
GAP, RADIUS = 30, 5.0


def _top_sql(score: str, k: int, where: str, name: str = "top") -> str:
    return f"""{name} as (select * from (select q, c, score, row_number() over (partition by q order by score desc, c) as rank
  from (select a.idx as q, b.idx as c, {score} as score from v_posed a join v_posed b on a.seq_id = b.seq_id and {where})) where rank <= {k})"""


TOP_SQL = _top_sql(COS, 20, f"b.idx <= a.idx - {GAP}")
QUERY_SQL = f"qs as (select a.idx as q, min(b.idx) as match from v_posed a join v_posed b on a.seq_id = b.seq_id and b.idx <= a.idx - {GAP} and {NEAR} < {RADIUS} group by a.idx)"
HIT_SQL = f"hits as (select t.q, t.c, t.rank, {NEAR} < {RADIUS} as hit from top t join v_posed a on a.idx = t.q join v_posed b on b.idx = t.c)"


def _base(spark, sf) -> DataFrame:
    return posed(spark, sf).select("seq_id", "idx", "v", "x", "y", "z")


def _top(df: DataFrame, k: int = 20) -> DataFrame:
    return knn.nearest(df, df, k, gap=GAP, past_only=True).drop("seq_id")


def _hits(ranks: DataFrame, df: DataFrame) -> DataFrame:
    a = df.select(F.col("idx").alias("q"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = df.select(F.col("idx").alias("c"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    d = F.sqrt(sum(((F.col(f"a{c}") - F.col(f"b{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    return ranks.join(a, "q").join(b, "c").select("q", "c", "rank", "score", d.alias("d"), (d < RADIUS).alias("hit"))


def _queries(df: DataFrame) -> DataFrame:
    return tr.revisit_queries(df, RADIUS, GAP).select(F.col("i").alias("q"), "match")


@query(f"{D}, {TOP_SQL} select q, c, rank, round(score, 6) + 0.0 as score from top where rank <= 10")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _top(_base(spark, sf), 10).select("q", "c", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


@query(f"{D}, {_top_sql(L2, 10, 'a.idx <> b.idx')} select q, c, rank, round(score, 6) + 0.0 as score from top")
def l2_topk(spark: SparkSession, sf: str) -> DataFrame:
    df = _base(spark, sf)
    return knn.nearest(df, df, 10, "l2").select("q", "c", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


RECALL_SQL = """select round(coalesce(avg((coalesce(f, 999) <= 1)::int), 0), 6) as r1, round(coalesce(avg((coalesce(f, 999) <= 5)::int), 0), 6) as r5, round(coalesce(avg((coalesce(f, 999) <= 10)::int), 0), 6) as r10, count(*) as n_queries
from qs left join (select q, min(rank) as f from hits where hit group by q) using (q)"""


@query(f"{D}, {TOP_SQL}, {QUERY_SQL}, {HIT_SQL} {RECALL_SQL}")
def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    df = _base(spark, sf)
    found = rt.recall(_hits(_top(df), df), _queries(df), (1, 5, 10))
    return found.select(*[r6(c).alias(c) for c in ("r1", "r5", "r10")], "n_queries")


@query(
    f"""{D}, {_top_sql(COS, 70, 'a.idx <> b.idx', 'fetched')}, top as (select q, c, score, row_number() over (partition by q order by rank) as rank from fetched where c < q - {GAP}), {QUERY_SQL}, {HIT_SQL} {RECALL_SQL}"""
)
def recall_post_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Q10: fetch ``k`` and twice the gap first, filter by time afterwards."""
    df = _base(spark, sf)
    fetched = knn.nearest(df, df, 70, sieve=lambda q, c, score: c < q - GAP, first=10).drop("seq_id").withColumnRenamed("rank", "rank0")
    kept = rt.ranked(fetched, [F.col("rank0")])
    found = rt.recall(_hits(kept, df), _queries(df), (1, 5, 10))
    return found.select(*[r6(c).alias(c) for c in ("r1", "r5", "r10")], "n_queries")


@query(f"{D}, {TOP_SQL}, {QUERY_SQL} select q, match, coalesce(rank - 1, -1)::bigint as place from qs left join top on top.q = qs.q and top.c = qs.match".replace("select q, match", "select qs.q, match"))
def true_match_rank(spark: SparkSession, sf: str) -> DataFrame:
    df = _base(spark, sf)
    return rt.match_rank(_top(df), _queries(df)).withColumn("place", F.col("place").cast("long"))


HIST_SQL = "h as (select seq_id, idx, x, y, z, list_transform(v, lambda e: abs(e)) as h, list_sum(list_transform(v, lambda e: abs(e))) as s from v_posed)"
WASS_SQL = f"""{HIST_SQL}, cdf as materialized (select seq_id, idx, j, sum(e) over (partition by idx order by j) as f from (select seq_id, idx, unnest(h) / s as e, generate_subscripts(h, 1) as j from h)),
wp as (select a.idx as q, b.idx as c, sum(abs(a.f - b.f)) as d from cdf a join cdf b on a.seq_id = b.seq_id and a.j = b.j and b.idx <= a.idx - {GAP} group by all)"""


def _shares(df: DataFrame) -> DataFrame:
    return df.withColumn("v", rt.running_shares(F.transform("v", F.abs)))


@query(f"{D}, {WASS_SQL} select q, count(*) as n, round(min(d), 6) as least, round(max(d), 6) as most, round(avg(d), 6) as mean from wp group by q")
def wasserstein_pairs(spark: SparkSession, sf: str) -> DataFrame:
    made = knn.distance_summary(_shares(_base(spark, sf)), "l1", gap=GAP, past_only=True)
    return made.select("q", "n", *[r6(c).alias(c) for c in ("least", "most", "mean")])


def _distances(found: DataFrame) -> DataFrame:
    return found.select("q", "c", F.col("rank").cast("long").alias("rank"), r6(-F.col("score")).alias("d"))


@query(f"{D}, {WASS_SQL} select q, c, rank, round(round(d, 9), 6) as d from (select *, row_number() over (partition by q order by round(d, 9), c) as rank from wp) where rank <= 5")
def wasserstein_topk(spark: SparkSession, sf: str) -> DataFrame:
    df = _shares(_base(spark, sf))
    return _distances(knn.nearest(df, df, 5, "l1", gap=GAP, past_only=True))


@query(
    f"""{D}, {WASS_SQL}, far as (select wp.* from wp join v_posed a on a.idx = q join v_posed b on b.idx = c where {NEAR} >= 10.0)
select q, c, rank, round(round(d, 9), 6) as d from (select *, row_number() over (partition by q order by round(d, 9), c) as rank from far) where rank <= 5"""
)
def two_stage_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """R-03: candidates at least ten metres off (the spatial predicate keeps the far ones), then the nearest histograms."""
    df = _shares(_base(spark, sf))
    return _distances(knn.nearest(df, df, 5, "l1", gap=GAP, past_only=True, at_least=10.0))


KEYS_SQL = 'keys as (select idx, list_transform(range(4), lambda r: list_avg(v[r * 16 + 1 : r * 16 + 16])) as k from v_posed)'
CAND_SQL = f"""{TOP_SQL}, {KEYS_SQL}, cand as (
  select q, c, rank as rank0, 1 - score as raw, round(sqrt(list_sum(list_transform(list_zip(a.k, b.k), lambda x: pow(x[1] - x[2], 2)))), 9) as lay from top join keys a on a.idx = q join keys b on b.idx = c),
mm as (select *, case when max(raw) over w - min(raw) over w < 1e-8 then 0 else (raw - min(raw) over w) / (max(raw) over w - min(raw) over w) end as r, case when max(lay) over w - min(lay) over w < 1e-8 then 0 else (lay - min(lay) over w) / (max(lay) over w - min(lay) over w) end as o from cand window w as (partition by q))"""


def _candidates(df: DataFrame, top: DataFrame | None = None) -> DataFrame:
    """Cosine candidates (``top``, if they are known) with the distance of their layout row keys."""
    sums = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.aggregate(F.slice("v", r * 16 + 1, 16), F.lit(0.0), lambda a, x: a + x) / 16)
    keys = df.select("idx", sums.alias("k"))
    top = (_top(df) if top is None else top).withColumn("rank", F.col("rank").cast("long"))
    a, b = keys.select(F.col("idx").alias("q"), F.col("k").alias("a")), keys.select(F.col("idx").alias("c"), F.col("k").alias("b"))
    gap = F.zip_with("a", "b", lambda x, y: x - y)
    return top.join(a, "q").join(b, "c").select("q", "c", F.col("rank").alias("rank0"), (1 - F.col("score")).alias("raw"), F.round(knn.norm(gap), 9).alias("lay"))


def _fused(df: DataFrame) -> DataFrame:
    return df.where("rank <= 5").select("q", "c", F.col("rank").cast("long").alias("rank"), r6("fused").alias("fused"))


@query(f"{D}, {CAND_SQL} select q, c, rank, round(f, 6) + 0.0 as fused from (select *, row_number() over (partition by q order by f, rank0, c) as rank from (select *, round(r + 0.5 * o, 9) as f from mm)) where rank <= 5")
def minmax_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(rt.fuse_scores(_candidates(_base(spark, sf)), "raw", "lay", 0.5))


@query(
    f"""{D}, {CAND_SQL} select q, c, rank, round(f, 6) as fused from (select *, row_number() over (partition by q order by f, rank0) as rank from (
  select *, row_number() over (partition by q order by lay, rank0) - 1 + 0.5::double * (rank0 - 1) as f from cand)) where rank <= 5"""
)
def rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(rt.fuse_ranks(_candidates(_base(spark, sf)), "lay", 0.5))


@query(
    f"""{D}, {CAND_SQL}, g as (select *, list_sort(list(r) over (partition by q)) as rs from mm),
w as (select *, case when len(rs) < 2 then 0.8 else 0.2 + (0.8 - 0.2) * least(greatest(1 - (rs[2] - rs[1]) / 0.3, 0), 1) end as wt from g)
select q, c, rank, round(f, 6) + 0.0 as fused from (select *, row_number() over (partition by q order by f, rank0, c) as rank from (select *, round(r + wt * o, 9) as f from w)) where rank <= 5"""
)
def adaptive_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(rt.fuse_adaptive(_candidates(_base(spark, sf)), "raw", "lay", 0.2, 0.8, 0.3))


@query(f"{D}, {_top_sql(COS, 5, f'b.idx <= a.idx - {GAP}', 't1')}, {_top_sql(L2, 5, f'b.idx <= a.idx - {GAP}', 't2')} select q, c from t1 union select q, c from t2")
def candidate_union(spark: SparkSession, sf: str) -> DataFrame:
    df = _base(spark, sf)
    l2 = knn.nearest(df, df, 5, "l2", gap=GAP, past_only=True)
    return _top(df, 5).select("q", "c").union(l2.select("q", "c")).distinct()


@query(
    f"""{D}, p as (select a.idx as q, b.idx as c, {COS} as s, {NEAR} as d from v_posed a join v_posed b on a.seq_id = b.seq_id and b.idx <= a.idx - {GAP})
select q, c, round(s, 6) + 0.0 as score, case when d >= 20 then 'false' else 'true' end as kind from p where s >= 0.25 and (d >= 20 or d < 5)"""
)
def false_positive_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """R-11: similar pairs that lie far apart (false) or close together (true)."""
    df = _base(spark, sf)
    met = knn.above(df, df, 0.25, gap=GAP, past_only=True, made=dg.far_or_near(5.0, 20.0), schema=dg.FAR_OR_NEAR, extra=("x", "y", "z"))
    return met.select("q", "c", r6("score").alias("score"), F.when(F.col("d") >= 20, "false").otherwise("true").alias("kind"))


@query(f"with {DESC_SQL} select idx, round(list_sum(list_transform(list_zip(v, list_reverse(v)), lambda x: abs((x[1] + x[2]) / 2))), 6) as total from v_desc")
def embedding_average(spark: SparkSession, sf: str) -> DataFrame:
    """R-10: mean of two branches, here a descriptor and its reverse."""
    mean = F.zip_with("v", F.reverse("v"), lambda a, b: (a + b) / 2)
    return descriptors(spark, sf).select("idx", r6(F.aggregate(mean, F.lit(0.0), lambda s, x: s + F.abs(x))).alias("total"))


BITS_SQL = "bits as (select idx, list_sum(list_transform(range(16), lambda j: case when v[j + 1] > 0 then (1 << j)::bigint else 0 end))::bigint as b from v_desc)"


@query(
    f"""with {DESC_SQL}, {BITS_SQL} select a.idx as q, b.idx as c, min(bit_count(xor(a.b, (((b.b << k) & 65535) | (b.b >> (16 - k)))::bigint)))::bigint as bits
from bits a join bits b on b.idx = a.idx + 1, (select ((s + 16) % 16)::int as k from range(-4, 5) t(s)) group by all"""
)
def template_hamming(spark: SparkSession, sf: str) -> DataFrame:
    code = F.aggregate(F.transform(F.slice("v", 1, 16), lambda x, j: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    held = descriptors(spark, sf).select("idx", code.alias("b"))
    a, b = held.select(F.col("idx").alias("q"), F.col("b").alias("p")), held.select(F.col("idx").alias("c"), F.col("b").alias("r"))
    met = a.join(b, F.col("c") == F.col("q") + 1)
    return met.select("q", "c", rt.rotation_hamming(F.col("p"), F.col("r"), 16, 4).cast("long").alias("bits"))
