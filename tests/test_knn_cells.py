"""Searches in cells give what comparing all pairs gives, and compare few pairs where rows have clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import knn


def rows_of(spark, n, seed, clusters=0, dims=6, sequences=2):
    dice = np.random.default_rng(seed)
    v = dice.normal(size=(n, dims))
    if clusters:
        v = dice.normal(size=(clusters, dims))[dice.integers(0, clusters, n)] * 10 + 0.1 * v
    place = dice.uniform(0, 30, (n, 3))
    rows = [(i % sequences, i, v[i].tolist(), *place[i].tolist()) for i in range(n)]
    rows += [(0, n + i, v[0].tolist(), *place[i].tolist()) for i in range(5)] + [(9, n + 7, v[1].tolist(), 0.0, 0.0, 0.0)]
    return spark.createDataFrame(rows, "seq_id int, idx long, v array<double>, x double, y double, z double").coalesce(2)


def got(df):
    return sorted((r["seq_id"], r["q"], r["c"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("metric, clusters", [("cosine", 0), ("l2", 12), ("l1", 12)])
def test_nearest(spark, metric, clusters):
    rows = rows_of(spark, 400, 1, clusters).cache()
    for how in ({"gap": 30, "past_only": True}, {"gap": 5, "exclusive": True, "at_least": 10.0}):
        want = got(knn.nearest(rows, rows, 5, metric, **how))
        assert got(knn.nearest(rows, rows, 5, metric, cell_rows=50, **how)) == want and want


def test_nearest_of_other_queries_and_many_neighbours(spark):
    base, asked = rows_of(spark, 300, 2, 8), rows_of(spark, 90, 3, 8).withColumn("idx", F.col("idx") + 10_000)
    for k in (1, 500):
        assert got(knn.nearest(asked, base, k, "l2", cell_rows=20)) == got(knn.nearest(asked, base, k, "l2"))


@pytest.mark.parametrize("clusters", [12])
def test_above_and_level_counts(spark, clusters):
    rows = rows_of(spark, 300, 4, clusters).cache()
    assert got(knn.above(rows, rows, 0.9, gap=3, cell_rows=40)) == got(knn.above(rows, rows, 0.9, gap=3))
    counts = [sorted(map(tuple, knn.level_counts(rows, [0.5, 0.9, 0.99], 8.0, 3, True, cell_rows=r).collect())) for r in (40, knn.CELL_ROWS)]
    assert counts[0] == counts[1]


def pairs_compared(spark, n):
    """Clusters grow in number with the rows, as places do along a road."""
    rows = rows_of(spark, n, 5, clusters=n // 20, sequences=1)
    cells = knn.Cells(rows, "l2", (), 50)
    asked = rows.select("seq_id", "idx", "v")
    near, _, further = knn.cell_visits(cells, asked, 5, knn._best(5, None, False), None, False, False)
    return sum(cells.compared(v).first()["pairs"] for v in (near, further))


def test_pairs_grow_far_slower_than_the_square(spark):
    few, many = pairs_compared(spark, 1_000), pairs_compared(spark, 4_000)
    assert many < 0.15 * 4_000**2 and many / few < 9, (few, many)  # the square would be 16 times


def test_open_cells_are_counted_before_they_are_listed(spark, monkeypatch):
    """Rows without clusters leave most cells open, whose list would repeat each query's vector for every cell."""
    rows = rows_of(spark, 600, 6, dims=32, sequences=1).cache()
    want = got(knn.nearest(rows, rows, 5, "l2", 30))
    steps, write = [], knn.written
    monkeypatch.setattr(knn, "written", lambda df, label: steps.append(label) or write(df, label))
    assert got(knn.nearest(rows, rows, 5, "l2", 30, cell_rows=50)) == want
    assert steps.count("visits") == 1, steps


def test_queries_visit_no_cell_where_some_of_them_find_most_open(spark, monkeypatch):
    """Only a few queries meet the rows of cells before blocks are compared, and what they say changes no result."""
    rows = rows_of(spark, 600, 7, dims=32, sequences=1).cache()
    want = got(knn.nearest(rows, rows, 5, "l2", 30, past_only=True))
    seen, write = {}, knn.written
    monkeypatch.setattr(knn, "written", lambda df, label: seen.setdefault(label, write(df, label)))
    monkeypatch.setattr(knn, "PROBES", 40)
    assert got(knn.nearest(rows, rows, 5, "l2", 30, past_only=True, cell_rows=50)) == want
    assert 0 < seen["visits"].select("idx").distinct().count() < 150


def test_partitions_follow_the_bytes_and_not_the_session(spark, monkeypatch):
    """With few shuffle partitions a task would sort far more than it compares; the blocks and their best are dealt out by their size."""
    rows = rows_of(spark, 600, 8, dims=32, sequences=1).cache()
    want = got(knn.nearest(rows, rows, 5, "l2", 30, past_only=True))
    asked, ranked, block, rank = [], [], knn.blocked, knn._ranked
    monkeypatch.setattr(knn, "blocked", lambda *a, **kw: asked.append((kw.get("parts"), made := block(*a, **kw))[0]) or made)
    monkeypatch.setattr(knn, "_ranked", lambda found, k, parts=None: ranked.append(parts) or rank(found, k, parts))
    monkeypatch.setattr(knn, "PART_BYTES", 1 << 14)
    assert got(knn.nearest(rows, rows, 5, "l2", 30, past_only=True, cell_rows=50)) == want
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert asked[0] > few and asked[-1] > few and ranked[-1] > few


@pytest.mark.parametrize("far", [0.0, 1e5])
@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_single_precision_only_sorts_out(spark, metric, far):
    """Copies, near copies and vectors far from the origin: the best are those of sorting all scores in double precision."""
    dice = np.random.default_rng(9)
    v = dice.normal(size=(300, 8)) + far
    v[100:200] = v[0]
    v[200:] = v[1] + 1e-7 * dice.normal(size=(100, 8))
    rows = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(v)], "seq_id int, idx long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    squares = (v * v).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * v @ v.T
    score = np.round(u @ u.T if metric == "cosine" else -np.sqrt(np.maximum(squares, 0)), 9)
    found = knn.nearest(rows, rows, 7, metric).toPandas().sort_values(["q", "rank"]).reset_index()
    for q, one in found.groupby("q"):
        others = np.delete(np.arange(300), q)
        best = np.sort(score[q, others])[::-1][:7]
        assert len(one) == 7
        if metric == "l2":  # squares differ in their last digits
            assert np.allclose(one["score"] ** 2, best**2, atol=1e-12 * (1 + far**2), rtol=1e-9)
        else:
            assert np.allclose(one["score"], best, atol=2e-9, rtol=0) and np.allclose(score[q, one["c"]], best, atol=2e-9, rtol=0)
