"""Re-rankers compared per sensor over the posed descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import evaluation, network as nw, retrieval as rt
from trailmark.operators.tables import written
from trailmark.plans.base import query, r6
from trailmark.plans.network_queries import _vec, bias, weight
from trailmark.plans.retrieval_queries import CAND_SQL, NEAR, QUERY_SQL, RADIUS, D, _base, _candidates, _hits, _queries
from trailmark.plans.views import APART

KS = (1, 5, 10)
#: Reads the cosine distance and the layout distance of a candidate.
READER = nw.Chain((nw.Linear(weight(2, 2, 1), bias(2, 1)), nw.relu, nw.Linear(weight(1, 2, 3), bias(1, 0))))
METHODS = {
    "cosine": lambda found: found.withColumn("rank", F.col("rank0")),
    "fused": lambda found: rt.fuse_scores(found, "raw", "lay", 0.5),
    "learned": evaluation.by_model(["raw", "lay"], READER),
}


@query(
    f"""{D}, {CAND_SQL}, {QUERY_SQL}, hid as (select q, c, rank0, list_transform({_vec("[raw, lay]", 2, 2, 1, 1)}, lambda v: greatest(v, 0)) as h from cand), lg as (select q, c, rank0, round(({_vec("h", 1, 2, 3, 0)})[1], 9) as logit from hid),
ranked as (select 'cosine' as method, q, c, rank0 as rank from cand
  union all select 'fused', q, c, row_number() over (partition by q order by round(r + 0.5 * o, 9), rank0, c) from mm
  union all select 'learned', q, c, row_number() over (partition by q order by logit desc, rank0, c) from lg),
firsts as (select method, q, min(rank) as first from ranked join v_posed a on a.idx = q join v_posed b on b.idx = c where {NEAR} < {RADIUS} group by all),
ev as (select method, q, 's' || ((q // {APART}) % 3) as sensor from qs, (values ('cosine'), ('fused'), ('learned')) m(method))
select method, sensor, k::int as k, round(avg(case when coalesce(first, 999) <= k then 1.0::double else 0.0 end), 6) as recall, count(*) as n from ev left join firsts using (method, q), (values (1), (5), (10)) t(k) group by all"""
)
def sensor_recall(spark: SparkSession, sf: str) -> DataFrame:
    """N-11, Y-11: three methods by sensor and cut-off over the same candidates; a sequence's sensor goes by its number."""
    df = _base(spark, sf)
    found = written(_candidates(df), "candidates")
    hits = _hits(found.withColumnsRenamed({"rank0": "rank", "raw": "score"}), df).where("hit")
    truths = _queries(df).select("q", F.concat(F.lit("s"), (F.floor(F.col("q") / APART) % 3).cast("string")).alias("sensor"))
    made = evaluation.recall_by_group(evaluation.ranked_by(METHODS, found), truths, hits, KS)
    return made.select("method", "sensor", "k", r6("recall").alias("recall"), "n")
