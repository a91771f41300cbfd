"""Evaluation of re-rankers over the same candidates: per method, group of sequences and cut-off."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.network import applied

Reranker = Callable[[DataFrame], DataFrame]


def by_model(features: list[str], model: Callable[[np.ndarray], np.ndarray], before: str = "rank0") -> Reranker:
    """N-11: a re-ranker that orders each query's candidates by a model's falling logit over their ``features`` (then by ``before``, then
    by ``c``); the model sees batches of candidates of many queries at once."""

    def run(candidates: DataFrame) -> DataFrame:
        scored = applied(candidates.withColumn("x", F.array(*[F.col(f).cast("double") for f in features])), {"logit": ("x", model)})
        logit = F.round(F.get("logit", F.lit(0)), 9)
        order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("at"), before, "c"))
        return scored.withColumn("at", logit).withColumn("rank", order).drop("x", "logit", "at")

    return run


def ranked_by(methods: dict[str, Reranker], candidates: DataFrame) -> DataFrame:
    """Y-15: ``method, q, c, rank`` of all methods over the same candidates."""
    made = [run(candidates).select(F.lit(name).alias("method"), "q", "c", F.col("rank").cast("long").alias("rank")) for name, run in methods.items()]
    return reduce(DataFrame.unionByName, made)


def recall_by_group(ranked: DataFrame, truths: DataFrame, hits: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Y-11, Y-14: ``method, sensor, k, recall, n``: the share of a group's queries with a hit among the first ``k``.

    ``truths``: a row ``q, sensor`` for each query that has a true match; ``hits``: the pairs ``q, c`` that are true.  A query that a method
    found nothing for counts as missed; a method without any candidates at all is not in the table.
    """
    first = ranked.join(hits.select("q", "c").distinct(), ["q", "c"], "left_semi").groupBy("method", "q").agg(F.min("rank").alias("first"))
    methods = ranked.groupBy().agg(F.sort_array(F.collect_set("method")).alias("methods")).scalar()  # a name a method
    every = truths.select("q", "sensor").distinct().withColumn("method", F.explode(methods))
    met = every.join(first, ["method", "q"], "left")
    cut = F.explode(F.array(*[F.lit(k) for k in ks]))
    return met.withColumn("k", cut).groupBy("method", "sensor", "k").agg(F.avg(F.when(F.col("first") <= F.col("k"), 1.0).otherwise(0.0)).alias("recall"), F.count(F.lit(1)).alias("n"))
