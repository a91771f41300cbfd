"""Fitted statistics, Bayesian tests, sampling and evaluation roll-ups.

Fitted parameters are one-row DataFrames; they meet other rows as scalar subqueries, so plans stay lazy.  Exact quantiles take a few rounds of
counting, which run when they are asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from trailmark.operators.tables import written


def column_stats(rows: DataFrame, vector: str, floor: float = 1e-8) -> DataFrame:
    """A-12: one row ``mean, std`` (arrays), the deviation (population) with a floor; one small row a dimension is gathered."""
    flat = rows.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"), F.greatest(F.stddev_pop("x"), F.lit(floor)).alias("s"))
    held = flat.agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("a"))
    return held.select(F.transform("a", lambda x: x["m"]).alias("mean"), F.transform("a", lambda x: x["s"]).alias("std"))


def standardize(rows: DataFrame, vector: str, fitted: DataFrame) -> DataFrame:
    """PF-09: ``vector`` less the mean over the deviation, by column."""
    both = fitted.select(F.arrays_zip(F.col("mean"), F.col("std"))).scalar()
    held = rows.withColumn("_f", both)
    return held.withColumn(vector, F.zip_with(vector, "_f", lambda x, f: (x - f["mean"]) / f["std"])).drop("_f")


def fisher(cosine: Column) -> Column:
    """F-02: ``atanh`` with a clip."""
    return F.atanh(F.least(F.greatest(cosine, F.lit(-0.9999)), F.lit(0.9999)))


def fit_places(pairs: DataFrame, obs: Column, d: str, near: float = 5.0, far: float = 10.0, least: int = 10) -> DataFrame:
    """A-13, ST-01: one row of Gaussians for pairs of the same (closer than ``near``) and of different places.

    Deviations have a floor; with fewer than ``least`` pairs of either kind ``fitted`` is false and the rest null.
    """
    same, diff = F.col(d) < near, F.col(d) > far
    marked = pairs.withColumn("_o", obs)
    facts = marked.agg(
        F.count(F.when(same, 1)).alias("n_same"),
        F.count(F.when(diff, 1)).alias("n_diff"),
        *[f(F.when(of, F.col("_o"))).alias(name) for of, kind in ((same, "same"), (diff, "diff")) for f, name in ((F.avg, f"mu_{kind}"), (F.stddev_pop, f"sigma_{kind}"))],
    )
    enough = (F.col("n_same") >= least) & (F.col("n_diff") >= least)
    names = ("mu_same", "sigma_same", "mu_diff", "sigma_diff")
    floored = [F.when(enough, F.greatest(c, F.lit(1e-6)) if c.startswith("sigma") else F.col(c)).alias(c) for c in names]
    return facts.select("n_same", "n_diff", enough.alias("fitted"), *floored)


def gaussian(x: Column, mu: Column, sigma: Column) -> Column:
    """F-03."""
    z = (x - mu) / sigma
    return F.exp(-0.5 * z * z) / (sigma * math.sqrt(2 * math.pi))


def posterior(cosine: Column, prior: Column, model: DataFrame) -> Column:
    """ST-02: chance of a same place given a cosine, under the one-row model of ``fit_places`` on Fisher-transformed cosines."""
    m = model.select(F.struct("mu_same", "sigma_same", "mu_diff", "sigma_diff")).scalar()
    z = fisher(cosine)
    same = gaussian(z, m["mu_same"], m["sigma_same"]) * prior
    return same / F.greatest(same + gaussian(z, m["mu_diff"], m["sigma_diff"]) * (1 - prior), F.lit(1e-30))


def confidence_threshold(model: Row, confidence: float, prior: float = 0.01, steps: int = 80) -> float:
    """ST-03: least cosine whose posterior reaches ``confidence``, by bisection on the four fitted numbers.

    Searched between the mean of different places and five deviations above the same; beyond, the bound.
    """

    def of(z: float) -> float:
        p, q = (math.exp(-0.5 * ((z - model[f"mu_{k}"]) / model[f"sigma_{k}"]) ** 2) / model[f"sigma_{k}"] for k in ("same", "diff"))
        return p * prior / max(p * prior + q * (1 - prior), 1e-30) - confidence

    low, high = model["mu_diff"], model["mu_same"] + 5 * model["sigma_same"]
    if of(low) >= 0:
        return math.tanh(low)
    if of(high) <= 0:
        return math.tanh(high)
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if of(middle) >= 0 else (middle, high)
    return math.tanh(high)


def sigmoid(x: Column) -> Column:
    """F-04: the form that doesn't overflow."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


ACCURACY = 10_000  # of the sketch that bounds a place: one of so many parts of the rows
FEW = 4096  # values that are sorted on the driver at last


def _at_rank(values: DataFrame, place: int, accuracy: int, few: int) -> float:
    """The value at a place from 0 among finite ``x``.

    Each round bounds it by a mergeable sketch, counts exactly what is below, at, and between the bounds, and goes on between them,
    where about ``4 / accuracy`` of the rows are left.
    """
    held, margin = values, 2.0
    while True:
        n = held.count()
        if n <= few:
            return sorted(r[0] for r in held.collect())[place]
        share = place / max(n - 1, 1)
        low, high = held.agg(F.percentile_approx("x", [max(0.0, share - margin / accuracy), min(1.0, share + margin / accuracy)], accuracy)).first()[0]
        x = F.col("x")
        below, at_low, between, at_high = held.agg(F.count_if(x < low), F.count_if(x == low), F.count_if((x > low) & (x < high)), F.count_if(x == high)).first()
        if below <= place < below + at_low:
            return low
        if below + at_low <= place < below + at_low + between:
            held, place = held.where((x > low) & (x < high)), place - below - at_low
        elif low < high and below + at_low + between <= place < below + at_low + between + at_high:
            return high
        else:  # the sketch missed it
            margin *= 2


def exact_quantiles(rows: DataFrame, value: str, shares: list[float], accuracy: int = ACCURACY, few: int = FEW) -> list[float | None]:
    """F-16, W-14: what ``percentile`` gives, between neighbours by linear interpolation, without a buffer of all distinct values.

    Nulls don't count; infinities stand at their ends, and NaN after them; of nothing all quantiles are None.
    """
    values = written(rows.select(F.col(value).cast("double").alias("x")).where("x is not null"), "values")
    inf = float("inf")
    lows, finite, highs, odd = values.agg(F.count_if(F.col("x") == -inf), F.count_if(F.abs("x") < inf), F.count_if(F.col("x") == inf), F.count_if(F.isnan("x"))).first()
    plain, known = values.where(F.abs("x") < inf), {}

    def at(place: int) -> float:
        if place < lows:
            return -inf
        if place >= lows + finite:
            return inf if place < lows + finite + highs else float("nan")
        if place not in known:
            known[place] = _at_rank(plain, place - lows, accuracy, few)
        return known[place]

    out: list[float | None] = []
    for share in shares:
        place = share * (lows + finite + highs + odd - 1)
        first, last = math.floor(place), math.ceil(place)
        if place < 0:
            out.append(None)
        elif first == last or at(first) == at(last):
            out.append(at(first))
        else:
            out.append((last - place) * at(first) + (place - first) * at(last))
    return out


def _prior(rows: DataFrame, signal: str, base: float, beta: float) -> DataFrame:
    (middle,) = exact_quantiles(rows, signal, [0.5])
    return rows.withColumn("prior", base * sigmoid(beta * (F.col(signal) - F.lit(middle))))


def density_prior(rows: DataFrame, signal: str, base: float = 0.01, beta: float = 10.0) -> DataFrame:
    """W-14: the denser above the median, the smaller the prior."""
    return _prior(rows, signal, base, -beta)


def entropy_prior(rows: DataFrame, signal: str, base: float = 0.01, beta: float = 10.0) -> DataFrame:
    """W-14: the higher the entropy above the median, the larger the prior."""
    return _prior(rows, signal, base, beta)


def sample_pairs(nodes: DataFrame, n_pairs: int) -> DataFrame:
    """J-13: fixed pairs of rows of one sequence, with replacement: ``k, i, j``; pairs of a row with itself are dropped.

    Sequences take turns; the places come from the pair's number alone, so that any engine draws the same pairs.  Rows of a
    sequence are numbered without gaps.
    """
    sizes = nodes.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))
    every = sizes.agg(F.count(F.lit(1))).scalar()
    # a row a sequence
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy("seq_id")).cast("long") - 1)
    k = F.col("id")
    made = nodes.sparkSession.range(n_pairs).withColumn("place", F.col("id") % every).join(placed, "place")
    n, first = F.col("n"), F.col("first")
    return made.select(k.alias("k"), (first + (k * 7919 + 13) % n).alias("i"), (first + (k * 104729 + F.floor(k / 97) * 31 + 7) % n).alias("j")).where("i <> j")


def with_ends(pairs: DataFrame, nodes: DataFrame, *cols: str) -> DataFrame:
    """Node columns for both ends of ``i, j``, as ``i_*`` and ``j_*``."""
    for end in ("i", "j"):
        pairs = pairs.join(nodes.select(F.col("idx").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in cols]), end)
    return pairs


def alias_rate(pairs: DataFrame, eps: float, gamma: float) -> DataFrame:
    """A-20: of the pairs ``geo, desc, turn`` at least ``gamma`` apart, the share whose descriptors lie within ``eps``; NaN without such pairs."""
    far = F.col("geo") >= gamma
    near = F.col("desc") <= eps
    out = []
    for name, of in (("all", far), ("forward", far & (F.col("turn") <= 30)), ("reverse", far & (F.col("turn") > 90))):
        n, hit = F.count(F.when(of, 1)), F.count(F.when(of & near, 1))
        out += [F.when(n > 0, hit / n).otherwise(float("nan")).alias(f"rate_{name}"), n.alias(f"n_{name}"), hit.alias(f"hits_{name}")]
    return pairs.agg(*out)


def yaw_bin(turn: Column) -> Column:
    """A-18: forward up to 30 degrees, oblique up to 90, else reverse."""
    return F.when(turn <= 30, "forward").when(turn <= 90, "oblique").otherwise("reverse")


def by_yaw(records: DataFrame) -> DataFrame:
    """A-18: success and number of records ``turn, hit`` per bin, and of all."""
    rolled = records.select(yaw_bin(F.col("turn")).alias("bin"), F.col("hit").cast("double").alias("hit")).rollup("bin").agg(F.avg("hit").alias("r1"), F.count(F.lit(1)).alias("n"))
    return rolled.select(F.coalesce("bin", F.lit("all")).alias("bin"), "r1", "n")


def failure_breakdown(records: DataFrame) -> DataFrame:
    """A-19: where the true match ranks (``place`` from 0, -1 if absent), and how far and similar the first candidate is."""
    place = F.col("place")
    records = written(records, "records")
    p50, p90 = exact_quantiles(records, "d", [0.5, 0.9])

    def share(c: Column) -> Column:
        return F.avg(F.when(c, 1.0).otherwise(0.0))

    return records.agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col("hit")).alias("recall_at_1"),
        share(place == 0).alias("top1"),
        share((place >= 0) & (place < 5)).alias("top5"),
        share((place >= 0) & (place < 10)).alias("top10"),
        share(place == -1).alias("never"),
        F.avg("score").alias("score_mean"),
        F.stddev_pop("score").alias("score_std"),
        F.lit(p50).cast("double").alias("d_p50"),
        F.lit(p90).cast("double").alias("d_p90"),
    )


def macro_average(records: DataFrame, sequence: str, sensor: str, value: str) -> DataFrame:
    """A-17: mean over queries, over sequences, and over sensors (means of means), with the spread and minimum of the sensors."""
    per_sequence = records.groupBy(sensor, sequence).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"))
    per_sensor = per_sequence.groupBy(sensor).agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("m").alias("ms"), F.count(F.lit(1)).alias("k"), F.avg("m").alias("m"))
    return per_sensor.agg(
        (F.sum("s") / F.sum("n")).alias("r_query"), (F.sum("ms") / F.sum("k")).alias("r_sequence"), F.avg("m").alias("r_sensor"), F.stddev_pop("m").alias("sigma_sensor"), F.min("m").alias("r_min")
    )


def sweep(scored: DataFrame, truths: DataFrame, thresholds: list[float]) -> DataFrame:
    """A-21: edges ``score, hit`` at or above each threshold: precision, recall against ``truths`` (one row a true pair), and F1.

    Edges are counted once per step between thresholds, and the counts summed; a threshold without edges has zeros.
    """
    levels = sorted(thresholds)
    grid = F.array(*[F.lit(t) for t in levels])
    step = F.size(F.filter(grid, lambda t: F.col("score") >= t))
    counts = scored.select(step.alias("step"), F.col("hit")).groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("hit"), 1)).alias("good"))
    reached = counts.select(F.explode(F.slice(grid, F.lit(1), F.col("step"))).alias("threshold"), "n", "good")
    every = scored.sparkSession.range(1).select(F.explode(grid).alias("threshold"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("good"))
    return rated(reached.unionByName(every).groupBy("threshold").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), truths)


def rated(counts: DataFrame, truths: DataFrame) -> DataFrame:
    """A-21: precision, recall and F1 of ``threshold, n, good`` against the number of ``truths``, which may be counted already (``n``)."""
    total = truths.agg(F.coalesce(F.sum("n"), F.lit(0)) if "n" in truths.columns else F.count(F.lit(1))).scalar()
    summed = counts.select("threshold", F.col("n").alias("n_edges"), F.col("good").alias("n_true")).withColumn("total", total)
    p = F.when(F.col("n_edges") > 0, F.col("n_true") / F.col("n_edges")).otherwise(0.0)
    r = F.when(F.col("total") > 0, F.col("n_true") / F.col("total")).otherwise(0.0)
    both = F.col("precision") + F.col("recall")
    return summed.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)).drop("total")


#: Shares of the Poisson law with mean 1 up to each count, beyond which less than one draw of the generator is left.
POISSON = tuple(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(12))
PRIME = 2147483647


def draws(p: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How often row ``p`` is in resample ``b``: by the Poisson law with mean 1, from a fixed mixture of both numbers."""
    h = (p[:, None] % PRIME * 48271 + b[None, :] * 69621 + 1) % PRIME
    for _ in range(3):
        h = (h * h + p[:, None] % PRIME + b[None, :]) % PRIME
    return np.searchsorted(np.floor(np.array(POISSON) * PRIME), h, side="right")


def bootstrap_interval(values: DataFrame, value: str, order: str, resamples: int = 10_000, level: float = 0.95, block: int = 512) -> DataFrame:
    """A-23: percentile interval of the mean over resamples, in one pass.

    Each row is in each resample as often as ``draws`` says for its number ``order`` (a long); a task multiplies its rows by a block of
    these counts and gives a sum a resample, so that no row is written out per resample and none meets another.  A resample without rows
    has no mean.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros(resamples), np.zeros(resamples)
        for batch in batches:
            p, x = batch["p"].to_numpy(np.int64), batch["x"].to_numpy(float)
            for r in range(0, len(p), 4096):
                for b in range(0, resamples, block):
                    counts = draws(p[r : r + 4096], np.arange(b, min(b + block, resamples)))
                    n[b : b + block] += counts.sum(axis=0)
                    total[b : b + block] += x[r : r + 4096] @ counts
        yield pd.DataFrame({"b": np.arange(resamples), "n": n, "total": total})

    numbered = values.where(F.col(value).isNotNull()).select(F.col(order).cast("long").alias("p"), F.col(value).cast("double").alias("x"))
    sums = numbered.mapInPandas(run, "b long, n double, total double").groupBy("b").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    means = sums.where("n > 0").select((F.col("total") / F.col("n")).alias("m"))  # a row a resample
    tail = (1 - level) / 2
    return means.agg(F.percentile(F.col("m"), tail).alias("low"), F.percentile(F.col("m"), 1 - tail).alias("high"))
