"""Hand-computed cases of the reference operators."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from trailmark.operators import graph, grids, knn, network, retrieval, spectral, stats, trajectory


def poses(spark, rows):
    return spark.createDataFrame([(0, i, float(t), float(x), 0.0, 0.0, math.radians(yaw)) for i, (t, x, yaw) in enumerate(rows)], "seq_id long, idx long, ts double, x double, y double, z double, yaw double")


def test_keyframes_by_distance_turn_and_time(spark):
    df = poses(spark, [(0, 0, 0), (0.1, 0.1, 0), (0.2, 2.2, 0), (0.3, 2.3, 25), (10.4, 2.3, 25)])
    got = trajectory.select_keyframes(df, 2.0, 15.0, 5.0).orderBy("idx").collect()
    assert [r["selected"] for r in got] == [True, False, True, True, True]


def test_nearest_in_time_prefers_the_later_on_a_tie(spark):
    left = spark.createDataFrame([(0, 1, 100.0), (0, 2, 96.0)], "k int, id int, ts double")
    right = spark.createDataFrame([(0, "a", 90.0), (0, "b", 110.0)], "k int, gt string, ts double")
    got = {r["id"]: r["match"] for r in trajectory.nearest_in_time(left, right, "k", "ts", "gt").collect()}
    assert got == {1: "b", 2: "a"}


def test_bev_cells(spark):
    pts = spark.createDataFrame([(1, 3.0, 0.0, 0.0), (1, 12.0, 0.0, 0.0), (1, 7.0, 0.0, 0.5)], "scan_id int, x double, y double, z double")
    got = grids.max_height(grids.polar_cells(pts, 4, 4, 10.0, 5.0)).collect()
    assert [(r["row"], r["val"]) for r in got] == [(1, 0.5)]


def test_gap_fill_is_circular_and_linear(spark):
    grid = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 5, 2.0)], "scan_id int, row int, col int, val double")
    got = {r["col"]: r["val"] for r in grids.fill_gaps(grid, 10).collect()}
    assert len(got) == 10 and got[2] == pytest.approx(1.4) and got[7] == pytest.approx(1.6)


def test_row_fill_looks_up_first_and_keeps_others(spark):
    got = grids.fill_rows(spark.createDataFrame([(1, [[1.0], [0.0], [3.0], [0.0]])], "scan_id int, grid array<array<double>>"), 4).first()["grid"]
    assert got == [[1.0], [1.0], [3.0], [3.0]]


def test_octave_edges():
    assert spectral.octave_edges(181) == [0, 1, 2, 4, 8, 16, 32, 64, 128, 181]


def test_shift_leaves_magnitudes(spark):
    row = [float((i * 7) % 5) for i in range(16)]
    df = spark.createDataFrame([(row,), (row[5:] + row[:5],)], "v array<double>")
    a, b = (r["m"] for r in df.select(spectral.magnitudes(spectral.rfft(F.col("v"), 1, 0, 8)).alias("m")).collect())
    assert a == pytest.approx(b)


def test_wasserstein(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "p array<double>, q array<double>")
    assert [r[0] for r in df.select(retrieval.wasserstein(F.col("p"), F.col("q"))).collect()] == [0.0, 1.0, 2.0]


def test_nearest_in_blocks_is_exact(spark):
    df = spark.range(60).select(F.lit(0).cast("long").alias("seq_id"), F.col("id").alias("idx"), F.array(F.cos("id"), F.sin("id")).alias("v"))
    key = lambda rows: sorted((r["q"], r["c"], r["rank"]) for r in rows)
    assert key(knn.nearest(df, df, 3, query_block=7, base_block=11).collect()) == key(knn.nearest(df, df, 3).collect())


def test_min_max_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0)], "q int, x double")
    assert sorted(r[0] for r in df.select(retrieval.min_max(F.col("x"))).collect()) == [0.0, 0.0, 0.0, 1.0]


def test_accept_fills_up_with_relaxed(spark):
    df = spark.createDataFrame([(0, 1, c, c, s) for c, s in ((1, 0.9), (2, 0.4), (3, 0.3), (4, 0.2))], "seq_id int, q int, c int, rank int, score double")
    good = F.col("score") >= 0.5
    assert sorted(r["c"] for r in graph.accept(df, good, ~good, 5, 3).collect()) == [1, 2, 3]
    assert sorted(r["c"] for r in graph.accept(df, good, ~good, 5, 0).collect()) == [1]


def test_equal_nodes_attend_to_nothing(spark):
    nodes = spark.createDataFrame([(0, i, [1.0, 2.0]) for i in range(5)], "seq_id long, idx long, v array<double>")
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(4)], "seq_id long, src long, dst long")
    assert {r["val"] for r in graph.attended(graph.difference_attention(edges, nodes)).collect()} == {0.0}


def test_alias_rate(spark):
    df = spark.createDataFrame([(30.0, 0.0, 0.0), (60.0, 1.41, 0.0), (30.0, 1.41, 0.0), (1.0, 1.41, 0.0)], "geo double, desc double, turn double")
    got = stats.alias_rate(df, 0.1, 25.0).first()
    assert (got["n_all"], got["hits_all"], got["rate_all"]) == (3, 1, pytest.approx(1 / 3)) and math.isnan(got["rate_reverse"])


def test_posterior_and_threshold(spark):
    row = Row(mu_same=1.5, sigma_same=0.3, mu_diff=0.2, sigma_diff=0.4)
    model = spark.createDataFrame([row])
    z = math.atanh(0.92)
    p, q = (math.exp(-0.5 * ((z - m) / s) ** 2) / s for m, s in ((1.5, 0.3), (0.2, 0.4)))
    df = spark.createDataFrame([(0.92,)], "s double")
    got = df.select(stats.posterior(F.col("s"), F.lit(0.05), model)).first()[0]
    assert got == pytest.approx(p * 0.05 / (p * 0.05 + q * 0.95), abs=1e-12)
    t = stats.confidence_threshold(row, 0.9, 0.05)
    at = spark.createDataFrame([(t,)], "s double").select(stats.posterior(F.col("s"), F.lit(0.05), model)).first()[0]
    assert at == pytest.approx(0.9, abs=1e-6)


def test_recall_counts_queries_without_candidates(spark):
    ranks = spark.createDataFrame([(1, 1, False), (1, 2, True)], "q int, rank int, hit boolean")
    got = retrieval.recall(ranks, spark.createDataFrame([(1,), (2,)], "q int"), (1, 2)).first()
    assert (got["r1"], got["r2"], got["n_queries"]) == (0.0, 0.5, 2)


def test_empty_tables(spark):
    none = poses(spark, [(0, 0, 0)]).limit(0)
    assert trajectory.select_keyframes(none, 1, 1, 1).count() == 0
    assert trajectory.revisit_queries(none).count() == 0
    assert retrieval.recall(none.select(F.col("idx").alias("q"), F.lit(1).alias("rank"), F.lit(True).alias("hit")), none.select(F.col("idx").alias("q")), (1,)).first()["r1"] == 0.0


def test_attention_is_dealt_out_by_its_edges(spark, monkeypatch):
    """Each edge carries two vectors, which a few shuffle partitions would sort at once."""
    nodes = spark.createDataFrame([(0, i, [float(i % 3), i / 7]) for i in range(40)], "seq_id int, idx long, v array<double>")
    pairs = [(0, i, j) for i in range(40) for j in range(40) if 0 < abs(i - j) <= 3]
    edges = graph.temporal(spark.createDataFrame(pairs, "seq_id int, src long, dst long"))

    def shares(made):
        return sorted((r["src"], r["dst"], round(r["attn"], 9)) for r in made.collect())

    want = shares(graph.difference_attention(edges, nodes))
    monkeypatch.setattr(graph, "EDGE_ROWS", 16)
    made = graph.difference_attention(edges, nodes)
    assert made.rdd.getNumPartitions() == -(-len(pairs) // 16) and shares(made) == want


def test_similar_edges_are_dealt_out_by_their_number(spark, monkeypatch):
    """Accepted candidates meet the vectors of both ends, which a few shuffle partitions would sort at once."""
    nodes = spark.createDataFrame([(0, i, [float(i % 3) + 0.1, i / 7, 1.0]) for i in range(40)], "seq_id int, idx long, v array<double>")

    def edges(made):
        return sorted((r["src"], r["dst"], round(r["cos"], 9), round(r["l2"], 9), r["post"]) for r in made.collect())

    want = edges(graph.cosine_edges(nodes, 0.3, 6, 3, 3))
    monkeypatch.setattr(graph, "EDGE_ROWS", 16)
    made = graph.cosine_edges(nodes, 0.3, 6, 3, 3)
    assert made.rdd.getNumPartitions() == -(-len(want) // 16) and edges(made) == want


def test_attention_layers_are_dealt_out_by_their_edges(spark, monkeypatch):
    """Each edge carries keys, queries and values of its ends, which a few shuffle partitions would sort at once; no joins run beside Python workers."""
    one = network.Linear([[1.0, 0.0], [0.5, 1.0]])
    layer = network.Attention(one, one, one, 2)
    nodes = spark.createDataFrame([(0, i, [float(i % 3), i / 7]) for i in range(40)], "seq_id int, idx long, h array<double>")
    edges = spark.createDataFrame([(0, i, j) for i in range(40) for j in range(40) if 0 < abs(i - j) <= 3], "seq_id int, src long, dst long")

    def rows(made):
        return sorted((r["idx"], *[round(x, 9) for x in r["h"]]) for r in made.collect())

    want = rows(network.attention_layer(nodes, edges, layer))
    monkeypatch.setattr(graph, "EDGE_ROWS", 16)
    seen, ends = [], graph.ends
    monkeypatch.setattr(graph, "ends", lambda *a, **kw: seen.append((kw.get("parts"), made := ends(*a, **kw))[0]) or made)
    made = network.attention_layer(nodes, edges, layer)
    assert rows(made) == want and seen == [-(-edges.count() // 16)]
    assert "MapInPandas" not in made._jdf.queryExecution().executedPlan().toString()
