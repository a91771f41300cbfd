"""Exact quantiles, resampling in one pass, and sweeps over shifts, against direct computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import encoder, stats

INF, NAN = float("inf"), float("nan")
LISTS = {
    "spread": np.random.default_rng(1).normal(size=3000).tolist(),
    "ties": [1.0] * 900 + [2.0] * 50 + [-3.0] * 900,
    "wide": (np.random.default_rng(2).normal(size=500) * 10.0 ** np.random.default_rng(3).integers(-300, 300, 500)).tolist() + [1.7e308, -1.7e308],
    "ends": [INF, -INF, 0.0, 1.0, 2.0, INF],
    "one": [4.0],
    "nulls": [None, 1.0, None, 3.0],
}


@pytest.mark.parametrize("name", sorted(LISTS))
def test_quantiles_same_as_percentile(spark, name):
    rows = spark.createDataFrame([(x,) for x in LISTS[name]], "v double")
    shares = [0.0, 0.1, 0.5, 0.999]
    want = [rows.agg(F.percentile("v", s)).first()[0] for s in shares]
    got = stats.exact_quantiles(rows, "v", shares, accuracy=20, few=20)
    assert [None if x is None else float(x) for x in got] == pytest.approx(want, rel=1e-12, nan_ok=True)


def test_quantiles_of_nothing_and_of_odd_numbers(spark):
    assert stats.exact_quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == [None]
    got = stats.exact_quantiles(spark.createDataFrame([(1.0,), (NAN,), (2.0,)], "v double"), "v", [0.0, 0.5, 1.0])
    assert got[:2] == [1.0, 2.0] and np.isnan(got[2])


def test_resampling_in_one_pass(spark):
    x = np.random.default_rng(4).normal(3.0, 2.0, 5000)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double").repartition(5)
    got = stats.bootstrap_interval(rows, "v", "i", 400, block=64).first()
    counts = stats.draws(np.arange(5000), np.arange(400))
    means = (x @ counts) / counts.sum(axis=0)
    assert (got["low"], got["high"]) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), rel=1e-9)
    # as wide as the mean's own spread says, and as often as the law says
    assert got["high"] - got["low"] == pytest.approx(2 * 1.96 * x.std() / np.sqrt(5000), rel=0.15) and got["low"] < x.mean() < got["high"]
    shares = np.bincount(counts.ravel(), minlength=4)[:4] / counts.size
    assert shares == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.002)
    assert np.abs(np.corrcoef(counts[:200])[np.triu_indices(200, 1)]).max() < 0.3


def by_trying(a, b):
    """Every shift of one pair."""
    if not (np.linalg.norm(a, axis=0) > 1e-8).any():
        return 1.0
    found = []
    for s in range(a.shape[1]):
        c = np.roll(b, s, axis=1)
        n, m = np.linalg.norm(a, axis=0), np.linalg.norm(c, axis=0)
        good = (n > 1e-8) & (m > 1e-8)
        found.append(np.where(good, 1 - (a * c).sum(axis=0) / (n * m + 1e-8), 0).sum() / max(good.sum(), 1))
    return min(found)


def test_shift_sweep_same_as_trying():
    dice = np.random.default_rng(5)
    a = dice.random((40, 5, 12)) * (dice.random((40, 1, 12)) > 0.4)
    b = dice.random((40, 5, 12)) * (dice.random((40, 1, 12)) > 0.4)
    b[:10] = np.roll(a[:10], 5, axis=2)
    a[10], b[11], a[12], b[12] = 0, 0, 0, 0
    a[13] *= 1e-5
    b[14] *= 1e-4
    assert np.allclose(encoder.shift_distances(a, b), [by_trying(x, y) for x, y in zip(a, b)], atol=1e-12)


def test_near_rows_are_counted_without_a_row_a_pair(spark, monkeypatch):
    """Counts by cells are those of listing every pair, over laps with noise, stops and a sequence of one row."""

    from trailmark.operators import trajectory as tr

    dice = np.random.default_rng(3)
    rows = []
    for s in (0, 1):
        for i in range(300):
            t = 2 * np.pi * min(i, 250) / 60
            x, y, z = np.array([20 * np.cos(t), 20 * np.sin(t), 0.0]) + (dice.normal(size=3) * 0.5 if s else 0)
            rows.append((s, i, float(x), float(y), float(z)))
    rows.append((2, 0, 0.0, 0.0, 0.0))
    poses = spark.createDataFrame(rows, "seq_id int, idx long, x double, y double, z double").coalesce(2).cache()

    def near(closed, radius):
        for s, i, *a in rows:
            js = [j for r, j, *b in rows if r == s and abs(i - j) >= 7 and float(np.sqrt(sum((p - q) ** 2 for p, q in zip(a, b, strict=True)))) < radius + (1e-12 if closed else 0)]
            yield s, i, js

    listed = tr.near_pairs
    monkeypatch.setattr(tr, "near_pairs", lambda a, b, *x, **k: listed(a, b.where("seq_id >= 0") if b is not poses else pytest.fail("all pairs are listed"), *x, **k))
    want = sorted((s, i, len(js), min(js), max(js)) for s, i, js in near(True, 5.0) if js)
    assert sorted(map(tuple, tr.positive_counts(poses, 5.0, 7).select("seq_id", "i", "n", "first_j", "last_j").collect())) == want
    size = {0: 300, 1: 300, 2: 1}
    far = sorted((s, i, sum(abs(i - j) >= 7 for j in range(size[s])) - len(js)) for s, i, js in near(False, 10.0))
    assert sorted(map(tuple, tr.negative_counts(poses, 10.0, 7).collect())) == far
