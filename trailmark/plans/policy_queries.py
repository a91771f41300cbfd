"""Spectral policies with rule-made weights over descriptors as images of magnitudes, and the timing profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import diagnostics, network as nw, policies
from trailmark.plans.base import query, r6
from trailmark.plans.network_queries import bias, weight
from trailmark.plans.views import DESC_SQL, descriptors, table

ROWS, N = 4, 16
#: Each row's magnitudes as a list.
IMAGE_SQL = DESC_SQL + f", im as (select idx, r, list_transform(v[r * {N} + 1 : r * {N} + {N}], lambda x: abs(x)) as m from v_desc, range({ROWS}) t(r))"


def _w(i: str, j: str, salt: int) -> str:
    return f"((({i}) * 3 + ({j}) * 5 + {salt}) % 7 - 3) / 4.0"


def _numbered(spark: SparkSession, sf: str, policy) -> DataFrame:
    """``idx, at, val`` of what a policy makes of each descriptor."""
    x = descriptors(spark, sf).select("idx", F.transform("v", F.abs).alias("x"))
    made = nw.applied(x, {"d": ("x", policy)})
    return made.select("idx", F.posexplode("d").alias("at", "val")).select("idx", "at", r6("val").alias("val"))


@query(f"with {IMAGE_SQL} select idx, (r * 3 + i)::int as at, round(list_sum(list_transform(range({N}), lambda j: m[j + 1] * {_w('i', 'j', 2)})), 6) + 0.0 as val from im, range(3) u(i)")
def policy_filterbank(spark: SparkSession, sf: str) -> DataFrame:
    """N-09: three filters, the same for all rows."""
    return _numbered(spark, sf, policies.Filterbank(ROWS, nw.Linear(weight(3, N, 2))))


KERNELS = [[[((r + c * 3 + w * 5) % 7 - 3) / 4 for w in range(3)] for c in range(2)] for r in range(ROWS)]


@query(
    f"""with {IMAGE_SQL}, s as (select idx, r, c, f, greatest(list_sum(list_transform(range(3), lambda w: case when f + w between 1 and {N} then m[f + w] else 0 end * (((r + c * 3 + w * 5) % 7 - 3) / 4.0))) + case when c = 0 then 0.05 else -0.05 end, 0) as y
  from im, range(2) u(c), range({N}) t(f)) select idx, (r * 8 + c * 4 + f // 4)::int as at, round(avg(y), 6) + 0.0 as val from s group by idx, r, c, f // 4"""
)
def policy_convolution(spark: SparkSession, sf: str) -> DataFrame:
    """N-09: two kernels a row over the frequencies, averaged over four windows."""
    return _numbered(spark, sf, policies.ConvolutionPool(ROWS, KERNELS, [[0.05, -0.05]] * ROWS, 4))


@query(
    f"""with {IMAGE_SQL}, h as (select idx, r, m, list_transform(range(2), lambda i: greatest(list_sum(list_transform(range(3), lambda j: ([list_avg(m), list_stddev_samp(m), list_max(m)])[j + 1] * {_w('i', 'j', 1)})) + ((i + 1) % 3 - 1) / 8.0, 0)) as h from im),
g as (select idx, r, list_transform(range({N}), lambda k: m[k + 1] / (1 + exp(-(list_sum(list_transform(range(2), lambda i: h[i + 1] * {_w('k', 'i', 3)})) + ((k + 2) % 3 - 1) / 8.0)))) as m from h)
select idx, (kind * {ROWS} + r)::int as at, round(case kind when 0 then list_avg(m) when 1 then list_stddev_samp(m) else list_max(m) end, 6) + 0.0 as val from g, range(3) u(kind)"""
)
def policy_gated(spark: SparkSession, sf: str) -> DataFrame:
    """N-09: three facts of a row gate its frequencies; the same facts of the gated rows are the descriptor."""
    return _numbered(spark, sf, policies.GatedPool(ROWS, nw.Linear(weight(2, 3, 1), bias(2, 1)), nw.Linear(weight(N, 2, 3), bias(N, 2))))


@query("select event_type as section, round(sum(value), 4) as total, count(*) as n, round(avg(value), 6) as mean, round(100 * sum(value) / sum(sum(value)) over (), 6) as share from events group by event_type")
def timing_profile(spark: SparkSession, sf: str) -> DataFrame:
    """A-29: events as timed sections."""
    sections = table(spark, sf, "events").select(F.col("event_type").alias("section"), F.col("value").alias("seconds"))
    return diagnostics.timing(sections).select("section", F.round("total", 4).alias("total"), "n", r6("mean").alias("mean"), r6("share").alias("share"))
