"""Queries of the graph operators over the posed descriptors of all sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import graph, trajectory as tr
from trailmark.plans.base import query, r6
from trailmark.plans.retrieval_queries import COS, NEAR, D, _top_sql
from trailmark.plans.views import APART, posed

HALF, MAX_K, MIN_K, THRESHOLD = 3, 6, 3, 0.3
CHANNELS = [(0, 16), (16, 40), (40, 64)]
COS_FULL = COS.removeprefix("round(").removesuffix(", 9)")
DIFF = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda x: pow(x[1] - x[2], 2))))"
ENDS = "join v_posed a on a.idx = src join v_posed b on b.idx = dst"


def _nodes(spark, sf) -> DataFrame:
    return posed(spark, sf).select("seq_id", "idx", "x", "y", "z", "yaw", "v", "label")


def _temporal(nodes: DataFrame) -> DataFrame:
    return graph.temporal(tr.temporal_edges(nodes, HALF))


def _edges(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", r6("cos").alias("cos"), r6("l2").alias("l2"), r6("post").alias("post"))


def _accept_sql(strict: str, name: str = "kept") -> str:
    """From ``cand(q, c, rank, ...)``."""
    return f"""{name} as (select * from (select *, row_number() over (partition by q, strict order by rank) as r, count(*) filter (where strict) over (partition by q) as ns
  from (select *, {strict} as strict from cand)) where (strict and r <= {MAX_K}) or (not strict and r <= {MIN_K} - least(ns, {MAX_K})))"""


TEMPORAL_SQL = f"te as (select b.idx as src, a.idx as dst from v_posed a join v_posed b on a.seq_id = b.seq_id and b.idx - a.idx between -{HALF} and {HALF} and a.idx <> b.idx)"
FETCH_SQL = f"{_top_sql(COS, max(MAX_K, 4 * MIN_K) + 2 * HALF, 'a.idx <> b.idx', 'fetched')}, cand as (select * from fetched where abs(q - c) > {HALF})"
COSINE_SQL = f"{FETCH_SQL}, {_accept_sql(f'score >= {THRESHOLD}')}, se as (select q as src, c as dst, score from kept)"


@query(f"{D}, {COSINE_SQL} select src, dst, round({COS_FULL}, 6) + 0.0 as cos, round({DIFF}, 6) as l2, 1.0::double as post from se {ENDS}")
def similarity_edges_cosine(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _nodes(spark, sf)
    return _edges(graph.cosine_edges(nodes, THRESHOLD, MAX_K, MIN_K, HALF))


@query(f"{D}, {COSINE_SQL} select src, count(*) as n from se group by src having count(*) >= {MIN_K}")
def relaxed_min_k(spark: SparkSession, sf: str) -> DataFrame:
    """T-03: every query gets its least number of neighbours, the relaxed ones included."""
    made = graph.cosine_edges(_nodes(spark, sf), THRESHOLD, MAX_K, MIN_K, HALF)
    return made.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_K)


MODEL = {"mu_same": 0.45, "sigma_same": 0.2, "mu_diff": 0.05, "sigma_diff": 0.15}
DENSITY_K, BASE, BETA, CONFIDENCE, FLOOR = 20, 0.05, 10.0, 0.1, 0.35


def _pdf(kind: str) -> str:
    return f"exp(-0.5 * pow((z - {MODEL[f'mu_{kind}']}) / {MODEL[f'sigma_{kind}']}, 2)) / ({MODEL[f'sigma_{kind}']} * sqrt(2 * pi()))"


def _cos_of(i: int, j: int) -> str:
    a, b = f"a.v[{i + 1}:{j}]", f"b.v[{i + 1}:{j}]"
    return f"list_inner_product({a}, {b}) / sqrt(list_inner_product({a}, {a}) * list_inner_product({b}, {b}))"


BAYES_SQL = f"""{_top_sql(COS, max(max(MAX_K, 4 * MIN_K) + 2 * HALF, DENSITY_K), 'a.idx <> b.idx', 'fetched')},
dens as (select q, avg(score) as density from fetched where rank <= {DENSITY_K} group by q),
pri as (select q, density, {BASE} / (1 + exp({BETA} * (density - (select quantile_cont(density, 0.5) from dens)))) as prior from dens),
j as (select q, c, rank, score, prior, atanh(least(greatest(score, -0.9999), 0.9999)) as z from fetched join pri using (q) where abs(q - c) > {HALF}),
cand as (select *, {_pdf("same")} * prior / greatest({_pdf("same")} * prior + {_pdf("diff")} * (1 - prior), 1e-30) as post from j where
  {_pdf("same")} * prior / greatest({_pdf("same")} * prior + {_pdf("diff")} * (1 - prior), 1e-30) >= {CONFIDENCE})"""


def _model(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in MODEL.items()])


@query(f"{D}, {BAYES_SQL}, {_accept_sql(f'score >= {FLOOR}')} select q as src, c as dst, round({COS_FULL}, 6) + 0.0 as cos, round({DIFF}, 6) as l2, round(post, 6) as post from kept join v_posed a on a.idx = q join v_posed b on b.idx = c")
def similarity_edges_bayes(spark: SparkSession, sf: str) -> DataFrame:
    made = graph.bayes_edges(_nodes(spark, sf), _model(spark), FLOOR, CONFIDENCE, MAX_K, MIN_K, HALF, DENSITY_K, BETA, BASE)
    return _edges(made)


@query(f"{D}, {COSINE_SQL}, x as (select src, dst, unnest([{', '.join(_cos_of(*s) for s in CHANNELS)}]) as x from se {ENDS}) select src, dst, round(1 - stddev_pop(x), 6) as consistency from x group by src, dst")
def multiscale_consistency(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _nodes(spark, sf)
    made = graph.ends(graph.cosine_edges(nodes, THRESHOLD, MAX_K, MIN_K, HALF), nodes, "v")
    return made.select("src", "dst", r6(graph.consistency(F.col("src_v"), F.col("dst_v"), CHANNELS)).alias("consistency"))


POSE_EDGE_SQL = f"""pe as (select q as src, c as dst from (select a.idx as q, b.idx as c, row_number() over (partition by a.idx order by round({NEAR}, 9), b.idx) as r
  from v_posed a join v_posed b on a.seq_id = b.seq_id and abs(a.idx - b.idx) >= 30 and {NEAR} <= 5.0) where r <= 4)"""


@query(f"{D}, {POSE_EDGE_SQL} select src, dst, round({COS_FULL}, 6) + 0.0 as cos, round({DIFF}, 6) as l2, 1.0::double as post from pe {ENDS}")
def pose_gt_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(graph.pose_edges(_nodes(spark, sf), 5.0, 30, 4, HALF))


PHASE_SQL = f"""ph as (select idx, generate_subscripts(v, 1) as j, unnest(list_transform(v, lambda x: sign(x) * ln(1 + abs(x)))) as x from v_posed),
pz as (select idx, j, (x - avg(x) over w) / greatest(stddev_pop(x) over w, 1e-6) as x from ph window w as (partition by j)),
pv as materialized (select idx // {APART} as seq_id, idx, list(x order by j) as v from pz group by idx),
fetched as (select * from (select q, c, score, row_number() over (partition by q order by score desc, c) as rank from (select a.idx as q, b.idx as c, {COS} as score from pv a join pv b on a.seq_id = b.seq_id and a.idx <> b.idx)) where rank <= {5 * 8 + 30}),
fresh as (select *, row_number() over (partition by q order by rank) as place from fetched f where abs(q - c) > 30 and score >= 0.0 and not exists (select 1 from te where src = q and dst = c))"""


@query(f"{D}, {TEMPORAL_SQL}, {PHASE_SQL} select q as src, c as dst, round({COS_FULL}, 6) + 0.0 as cos, round(sqrt(greatest(2 - 2 * {COS_FULL}, 0)), 5) as l2, round(least(greatest((score + 1) / 2, 0), 1), 6) as post from fresh join v_posed a on a.idx = q join v_posed b on b.idx = c where place <= 5")
def phase_edges(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _nodes(spark, sf).withColumn("phase", F.col("v"))
    made = graph.phase_edges(nodes, _temporal(nodes), 5, 0.0, 30)
    return made.select("src", "dst", r6("cos").alias("cos"), F.round("l2", 5).alias("l2"), r6("post").alias("post"))


def _graph(nodes: DataFrame) -> DataFrame:
    return _temporal(nodes).unionByName(graph.cosine_edges(nodes, THRESHOLD, MAX_K, MIN_K, HALF))


GRAPH_SQL = f"{TEMPORAL_SQL}, {COSINE_SQL}, ge as materialized (select src, dst, 0 as etype, 0.0 as cos from te union all select src, dst, 1, score from se)"


@query(
    f"""{D}, {GRAPH_SQL} select src, dst, etype::int as etype, round(case when etype = 0 then ln(1 + {NEAR}) / 5 * sign(dst - src) else 0 end, 6) + 0.0 as dist,
round(case when etype = 0 then acos(least(greatest(cos(a.yaw - b.yaw), -1), 1)) / pi() else 0 end, 5) as rot, round(case when etype = 0 then 0 else {COS_FULL} end, 6) + 0.0 as cos, round(case when etype = 0 then 0 else ln(1 + {DIFF}) / 5 end, 6) as l2, 1.0::double as post,
case when etype = 0 or {NEAR} < 5.0 then 1.0::double else 0.0::double end as label from ge {ENDS}"""
)
def edge_labels(spark: SparkSession, sf: str) -> DataFrame:
    """G-01: the whole graph with its five attributes and pose labels, distances signed by direction."""
    nodes = _nodes(spark, sf)
    made = graph.edge_features(_graph(nodes), nodes, signed=True)
    return made.select("src", "dst", "etype", r6("dist").alias("dist"), F.round("rot", 5).alias("rot"), r6("cos").alias("cos"), r6("l2").alias("l2"), r6("post").alias("post"), "label")


START = "idx % 200 = 7"
HOP_SQL = f"""{GRAPH_SQL}, h0 as (select idx, 0 as hop from v_posed where {START}),
h1 as materialized (select distinct dst as idx, 1 as hop from h0 join ge on src = idx where dst not in (select idx from h0)),
h01 as materialized (select * from h0 union all select * from h1),
hops as materialized (select * from h01 union all select distinct dst, 2 from h1 join ge on src = idx where dst not in (select idx from h01))"""


@query(f"{D}, {HOP_SQL} select idx, hop::int as hop from hops")
def k_hop(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _nodes(spark, sf)
    return graph.k_hop(_graph(nodes), nodes.where(START), 2).select("idx", "hop")


@query(f"{D}, {HOP_SQL}, m as materialized (select idx, row_number() over (partition by idx // {APART} order by idx) - 1 as new from hops), g1 as materialized (select ge.*, m.new as src_new from ge join m on m.idx = src) select src, dst, etype::int as etype, src_new, m.new as dst_new from g1 join m on m.idx = dst")
def local_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _nodes(spark, sf)
    edges = _graph(nodes)
    members = graph.k_hop(edges, nodes.where(START), 2)
    return graph.subgraph(edges, members).select("src", "dst", "etype", "src_new", "dst_new")


@query(f"""{D}, {GRAPH_SQL} select seq_id, nodes, temporal, similarity, round((temporal + similarity) / nodes, 6) as degree from (select seq_id, count(*) as nodes from v_posed group by seq_id)
join (select src // {APART} as seq_id, count(*) filter (where etype = 0) as temporal, count(*) filter (where etype = 1) as similarity from ge group by 1) using (seq_id)""")
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _nodes(spark, sf)
    return graph.graph_statistics(nodes, _graph(nodes)).withColumn("degree", r6("degree"))


@query(f"{D}, {TEMPORAL_SQL}, {POSE_EDGE_SQL} select src, dst, 0 as etype from te union all select src, dst, 1 from pe")
def replace_similarity_edges(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _nodes(spark, sf)
    return graph.replace_similarity(_temporal(nodes), graph.pose_edges(nodes, 5.0, 30, 4, HALF)).select("src", "dst", "etype")


@query(f"{D}, {POSE_EDGE_SQL} select q as src, c as dst from (select src as q, dst as c from pe where src > dst union all select dst, src from pe where src > dst)")
def loop_closure_edges(spark: SparkSession, sf: str) -> DataFrame:
    """G-04: verified pairs, here the pose neighbours in the past, as edges both ways."""
    pairs = graph.pose_edges(_nodes(spark, sf), 5.0, 30, 4, HALF).where("src > dst")
    return graph.loop_closures(pairs.select("seq_id", F.col("src").alias("q"), F.col("dst").alias("c"))).select("src", "dst")


ATTENTION_SQL = f"""{GRAPH_SQL}, s as (select src, dst, list_transform(list_zip(a.v, b.v), lambda x: x[1] - x[2]) as diff, b.v as h from ge {ENDS}),
e as (select *, exp(sc - max(sc) over (partition by dst)) as e from (select *, list_inner_product(h, diff) / sqrt(len(h)) as sc from s)),
att as (select *, e / sum(e) over (partition by dst) as attn from e)"""


@query(f"{D}, {ATTENTION_SQL}, o as (select dst, j, sum(attn * x) as val from (select dst, attn, unnest(diff) as x, generate_subscripts(diff, 1) as j from att) group by all) select dst, round(sum(val), 5) + 0.0 as total, round(sum(abs(val)), 5) as size from o group by dst")
def diffattn_identity(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _nodes(spark, sf)
    out = graph.attended(graph.difference_attention(_graph(nodes), nodes)).groupBy("dst")
    return out.agg((F.round(F.sum("val"), 5) + 0.0).alias("total"), F.round(F.sum(F.abs("val")), 5).alias("size"))


@query(f"{D}, {ATTENTION_SQL} select dst, round(sum(-attn * ln(attn + 1e-10)), 6) as entropy from att group by dst")
def attention_entropy(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _nodes(spark, sf)
    return graph.attention_entropy(graph.difference_attention(_graph(nodes), nodes)).select("dst", r6("entropy").alias("entropy"))
