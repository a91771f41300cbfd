"""Ranking, fusion and recall over candidate rows ``q, c, score, rank``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def min_max(x: Column, by: str = "q") -> Column:
    """PF-07: to 0..1 within each query; 0 where the spread is below 1e-8 or not a number."""
    w = Window.partitionBy(by)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    flat = F.isnan(lo) | F.isnan(hi) | (F.abs(lo) == float("inf")) | (F.abs(hi) == float("inf")) | (hi - lo < 1e-8)
    return F.when(flat, F.lit(0.0)).otherwise((x - lo) / (hi - lo))


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """W-06: position of a candidate within its query, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy("q").orderBy(*order)))


def fuse_scores(df: DataFrame, raw: str, other: str, weight: float) -> DataFrame:
    """R-06: order by normalised raw distance plus ``weight`` times the normalised other distance."""
    return ranked(df.withColumn("fused", F.round(min_max(F.col(raw)) + weight * min_max(F.col(other)), 9)), [F.col("fused"), F.col("rank0"), F.col("c")])


def fuse_ranks(df: DataFrame, other: str, weight: float) -> DataFrame:
    """R-07: order by the rank under ``other`` plus ``weight`` times the raw rank ``rank0``; stable in the raw order."""
    second = ranked(df, [F.col(other), F.col("rank0")], "rank1")
    return ranked(second.withColumn("fused", F.col("rank1") - 1 + weight * (F.col("rank0") - 1)), [F.col("fused"), F.col("rank0")])


def top_two_margin(x: Column, smallest: bool = True) -> Column:
    """W-08: gap between the best two values of each query; null with fewer than two."""
    have = F.array_sort(F.collect_list(x).over(Window.partitionBy("q")))
    return F.get(have, F.lit(1)) - F.get(have, F.lit(0)) if smallest else F.get(have, F.size(have) - 1) - F.get(have, F.size(have) - 2)


def fuse_adaptive(df: DataFrame, raw: str, other: str, low: float, high: float, gap_scale: float) -> DataFrame:
    """R-08: the other distance counts more where the best two raw distances lie close together."""
    made = df.withColumn("r", min_max(F.col(raw))).withColumn("o", min_max(F.col(other)))
    margin = top_two_margin(F.col("r"))
    ambiguity = F.least(F.greatest(1.0 - margin / gap_scale, F.lit(0.0)), F.lit(1.0)) if gap_scale > 1e-8 else F.lit(1.0)
    weight = F.coalesce(low + (high - low) * ambiguity, F.lit(high))
    return ranked(made.withColumn("fused", F.round(F.col("r") + weight * F.col("o"), 9)), [F.col("fused"), F.col("rank0"), F.col("c")])


def recall(ranks: DataFrame, queries: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """A-16: share of all queries with a hit in the first ``k``; ``ranks`` has ``q, rank, hit``; no candidates is a miss."""
    first = ranks.where("hit").groupBy("q").agg(F.min("rank").alias("first"))
    every = queries.select("q").join(first, "q", "left")
    shares = [F.coalesce(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"r{k}") for k in ks]
    return every.agg(*shares, F.count(F.lit(1)).alias("n_queries"))


def match_rank(ranks: DataFrame, truth: DataFrame) -> DataFrame:
    """W-07: rank of the true match ``q, match`` from 0, -1 where it isn't a candidate."""
    own = ranks.select("q", F.col("c").alias("match"), (F.col("rank") - 1).alias("place"))
    return truth.join(own, ["q", "match"], "left").select("q", "match", F.coalesce("place", F.lit(-1)).alias("place"))


def wasserstein(p: Column, q: Column) -> Column:
    """R-01: one-dimensional distance of two histograms, each over its sum: total absolute difference of the running sums."""

    def share(h: Column) -> Column:
        return F.element_at(F.transform(F.array(F.aggregate(h, F.lit(0.0), lambda a, x: a + x)), lambda s: F.transform(h, lambda x: F.when(s > 0, x / s).otherwise(F.lit(0.0)))), 1)

    start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("t"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["d"] + x).alias("d"), (acc["t"] + F.abs(acc["d"] + x)).alias("t"))

    return F.aggregate(F.zip_with(share(p), share(q), lambda a, b: a - b), start, step, lambda acc: acc["t"])


def running_shares(histogram: Column) -> Column:
    """W-11: running sums of a histogram over its sum; the absolute distance of two such arrays is R-01."""
    total = F.aggregate(histogram, F.lit(0.0), lambda a, x: a + x)
    shares = F.element_at(F.transform(F.array(total), lambda t: F.transform(histogram, lambda x: F.when(t > 0, x / t).otherwise(0.0))), 1)
    start = F.struct(F.lit(0.0).alias("d"), F.expr("cast(array() as array<double>)").alias("out"))
    return F.aggregate(shares, start, lambda acc, x: F.struct((acc["d"] + x).alias("d"), F.array_append(acc["out"], acc["d"] + x).alias("out")), lambda acc: acc["out"])


def rotation_hamming(a: Column, b: Column, bits: int, most: int) -> Column:
    """R-12: least number of differing bits over cyclic shifts of up to ``most`` either way, for ``bits`` bits in a long."""
    mask = (1 << bits) - 1

    def shifted(s: Column) -> Column:
        k = F.pmod(s, F.lit(bits)).cast("int")
        up = F.call_function("shiftleft", b, k).bitwiseAND(F.lit(mask))
        return up.bitwiseOR(F.call_function("shiftrightunsigned", b, F.lit(bits) - k))

    return F.array_min(F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda s: F.bit_count(a.bitwiseXOR(shifted(s)))))
