"""Inference of small learned parts with given weights, as array expressions.

Weights are plain nested lists with rows by output; they become literals, so that the work stays in the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dense:
    """A linear layer; ``gain`` and ``shift`` of a layer norm after it, if any."""

    weight: list[list[float]]
    bias: list[float]
    gain: list[float] = field(default_factory=list)
    shift: list[float] = field(default_factory=list)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _literal(values: list) -> Column:
    return F.array(*[_literal(v) if isinstance(v, list) else F.lit(float(v)) for v in values])


def dense(x: Column, layer: Dense, eps: float = 1e-5) -> Column:
    """``weight @ x + bias``, then the layer norm."""
    rows = F.transform(_literal(layer.weight), lambda w: _sum(F.zip_with(w, x, lambda a, b: a * b)))
    out = F.zip_with(rows, _literal(layer.bias), lambda a, b: a + b)
    if not layer.gain:
        return out

    def normed(v: Column) -> Column:
        n = float(len(layer.gain))
        scaled = _let(_sum(v) / n, lambda m: _let(_sum(F.transform(v, lambda a: (a - m) * (a - m))) / n, lambda var: F.transform(v, lambda a: (a - m) / F.sqrt(var + eps))))
        return F.zip_with(F.zip_with(scaled, _literal(layer.gain), lambda a, g: a * g), _literal(layer.shift), lambda a, b: a + b)

    return _let(out, normed)


def relu(x: Column) -> Column:
    return F.transform(x, lambda a: F.greatest(a, F.lit(0.0)))


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function, within 8e-8 (Abramowitz and Stegun 26.2.17)."""
    t = 1.0 / (1.0 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2.0) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


def gelu(x: Column) -> Column:
    return F.transform(x, lambda a: a * normal_cdf(a))


def sinusoidal(x: Column, dim: int) -> Column:
    """N-01: sines, then cosines, of ``x`` at ``dim / 2`` frequencies falling from 1 to about 1 / 10000."""
    steps = [10_000.0 ** (-k / dim) for k in range(0, dim, 2)]
    return F.array(*[F.sin(x * f) for f in steps], *[F.cos(x * f) for f in steps])


def edge_gate(features: Column, etype: Column, hidden: Dense, last: Dense, bound: float = 3.0) -> Column:
    """N-03: logit in ``-bound`` to ``bound`` that shifts an edge's attention; 0 on temporal edges (type 0)."""
    logit = F.get(dense(relu(dense(features, hidden)), last), F.lit(0))
    return F.when(etype == 0, 0.0).otherwise(bound * F.tanh(logit))


@dataclass(frozen=True)
class Reranker:
    """N-10: weights of the correction and of its gate; without them the score is the closed form alone."""

    phase_weight: float = 10.0
    cosine_weight: float = 1.0
    layers: tuple[Dense, ...] = ()
    gate: tuple[Dense, ...] = ()
    scale: float = 1.0


def curve_statistics(curve: Column) -> Column:
    """``peak, mean, std (n - 1), margin`` of a shift curve."""

    def of(c: Column) -> Column:
        n = F.size(c).cast("double")
        order = F.sort_array(c, asc=False)
        mean = _sum(c) / n
        var = _let(mean, lambda m: _sum(F.transform(c, lambda x: (x - m) * (x - m)))) / F.greatest(n - 1, F.lit(1.0))
        margin = F.get(order, F.lit(0)) - F.coalesce(F.get(order, F.lit(1)), F.get(order, F.lit(0)))
        return F.struct(F.get(order, F.lit(0)).alias("peak"), mean.alias("mean"), F.sqrt(var).alias("std"), margin.alias("margin"))

    return _let(curve, of)


def rerank(candidates: DataFrame, model: Reranker = Reranker(), query: str = "q", curve: str = "curve", similarity: str = "sim") -> DataFrame:
    """N-10, R-05: candidates with ``score`` and ``rank``; a query's candidates are a bounded list."""
    s = candidates.withColumn("_s", curve_statistics(F.col(curve)))
    sim = F.col(similarity)
    s = s.withColumn("score", model.phase_weight * F.col("_s.peak") + model.cosine_weight * sim)
    if model.layers:
        x = F.concat(F.col(curve), F.array(sim, *[F.col(f"_s.{c}") for c in ("peak", "mean", "std", "margin")]))
        for layer in model.layers[:-1]:
            x = gelu(dense(x, layer))
        residual = model.scale * F.get(dense(x, model.layers[-1]), F.lit(0))
        if model.gate:
            best = Window.partitionBy(query)
            s = s.withColumn("_top", F.slice(F.sort_array(F.collect_list("score").over(best), asc=False), 1, 2))
            first = F.get("_top", F.lit(0))
            second = F.coalesce(F.get("_top", F.lit(1)), F.lit(0.0))
            apart = F.when(F.size("_top") > 1, first - second).otherwise(0.0)
            g = F.get(dense(gelu(dense(F.array(first, second, apart), model.gate[0])), model.gate[1]), F.lit(0))
            residual = residual / (1.0 + F.exp(-g))
        s = s.withColumn("score", F.col("score") + residual)
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "c"))
    return s.withColumn("rank", rank).drop("_s", "_top")
