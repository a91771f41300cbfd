"""Searches over blocks in files give what comparing blocks through a shuffle gives, and write rows once however many blocks they meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import diagnostics as dg, graph, knn, mining, stored, trajectory as tr


@pytest.fixture
def small(monkeypatch):
    """Blocks of few rows, and files from the first byte on."""
    monkeypatch.setattr(stored, "BLOCK_ROWS", 60)
    monkeypatch.setattr(knn, "STORED_BYTES", -1)
    monkeypatch.setattr(knn, "STORED_STRIP", 1 << 11)


def rows_of(spark, n, seed, dims=32, sequences=2, lattice=0):
    dice = np.random.default_rng(seed)
    v = np.round(dice.normal(size=(n, dims)), lattice) if lattice else dice.normal(size=(n, dims))
    place = dice.integers(0, 6, (n, 3)) * 5.0
    rows = [(i % sequences, i, v[i].tolist(), *place[i].tolist()) for i in range(n)] + [(9, n + 7, v[1].tolist(), 0.0, 0.0, 0.0)]
    return spark.createDataFrame(rows, "seq_id int, idx long, v array<double>, x double, y double, z double").coalesce(2).cache()


def got(df):
    return sorted((r["seq_id"], r["q"], r["rank"], r["c"], round(r["score"], 8) + 0.0) for r in df.collect())


def in_files(monkeypatch):
    """How often blocks in files are met from now on."""
    calls, own = [], knn.met
    monkeypatch.setattr(knn, "met", lambda *a, **kw: calls.append(1) or own(*a, **kw))
    return calls


@pytest.mark.parametrize("metric", ["cosine", "l2", "l1"])
def test_nearest_in_files(spark, small, monkeypatch, metric):
    rows = rows_of(spark, 700, 1, dims=33)
    calls = in_files(monkeypatch)
    for how in ({"gap": 30, "past_only": True}, {"gap": 5, "exclusive": True, "at_least": 10.0}, {"gap": 30, "at_least": 10.0, "strict": True, "sieve": lambda q, c, s: (q - c > 40) | (c - q > 40), "first": 2}):
        want = got(knn.nearest(rows, rows, 5, metric, **how))
        before = len(calls)
        assert got(knn.nearest(rows, rows, 5, metric, cell_rows=50, **how)) == want and want
        assert len(calls) == before + 1


def test_nearest_in_files_with_ties_and_copies(spark, small):
    """Many equal distances: ties go to the smaller number, across blocks too."""
    rows = rows_of(spark, 500, 2, dims=3, lattice=0).withColumn("v", F.transform("v", lambda x: F.round(x)))
    for metric in ("l2", "l1"):
        assert got(knn.nearest(rows, rows, 7, metric, cell_rows=50)) == got(knn.nearest(rows, rows, 7, metric))


def pairs_of(rows, radius, gap, closed=True):
    """By brute force: sequence, both numbers and distance of near pairs."""
    held = [(r["seq_id"], r["idx"], np.array([r["x"], r["y"], r["z"]])) for r in rows.collect()]
    d = {(s, i, j): float(np.sqrt(((p - q) ** 2).sum())) for s, i, p in held for t, j, q in held if s == t and abs(i - j) >= gap}
    return {k: v for k, v in d.items() if (v <= radius if closed else v < radius)}


@pytest.fixture
def crowded(small, monkeypatch):
    monkeypatch.setattr(tr, "DENSE_ROWS", 0)
    monkeypatch.setattr(tr, "near_pairs", None)  # near pairs are never listed
    monkeypatch.setattr(graph, "near_pairs", None)
    monkeypatch.setattr(mining, "near_pairs", None)


def test_poses_that_crowd(spark, crowded):
    """Nearest poses, first positives, lists and counts are those of listing every near pair."""
    rows = rows_of(spark, 300, 3)
    near = pairs_of(rows, 5.0, 10)
    best = {}
    for (s, i, j), d in sorted(near.items(), key=lambda x: (x[0][:2], round(x[1], 9), x[0][2])):
        best.setdefault((s, i), []).append(j)
    edges = graph.pose_edges(rows, 5.0, 10, 4, 3).collect()
    assert sorted((r["seq_id"], r["src"], r["dst"]) for r in edges) == sorted((*k, j) for k, js in best.items() for j in js[:4]) and edges
    mixed = {k: min(js, key=lambda j, i=k[1]: ((i * 7919 + j * 104729) % 1000003, j)) for k, js in best.items()}
    assert {(r["seq_id"], r["a"]): r["p"] for r in mining.anchors(rows, 5.0, 10).collect()} == mixed
    pools = {(r["seq_id"], r["a"]): r["positives"] for r in mining.pools(rows, 3, 5.0, 10.0, 10).collect()}
    assert pools and all(v == sorted(best[k]) for k, v in pools.items())
    open_ = pairs_of(rows, 5.0, 10, closed=False)
    assert tr.earlier_near(rows, 5.0, 10).agg(F.sum("n")).first()[0] == sum(j < i for _, i, j in open_)


@pytest.mark.parametrize("how", ["random", "semihard"])
def test_triplets_in_files(spark, small, how):
    rows = rows_of(spark, 300, 4)
    knn.STORED_BYTES, least = 1 << 60, knn.STORED_BYTES
    want = sorted(map(tuple, mining.triplets(rows, how, gap=10).collect()))
    knn.STORED_BYTES = least
    assert sorted(map(tuple, mining.triplets(rows, how, gap=10).collect())) == want and want


def test_sums_over_all_pairs_in_files(spark, small, monkeypatch):
    rows = rows_of(spark, 400, 5)
    monkeypatch.setattr(knn, "long_sequences", lambda base, metric, cell_rows: True)
    monkeypatch.setattr(knn.Cells, "worth", lambda *a, **kw: False)
    made = []
    for least in (1 << 60, -1):
        monkeypatch.setattr(knn, "STORED_BYTES", least)
        made.append([sorted(map(tuple, knn.distance_summary(rows, "l1", 20, past).collect())) for past in (True, False)])
        made[-1].append(sorted(map(tuple, knn.level_counts(rows, [0.1, 0.3], 8.0, 3, True).collect())))
        made[-1].append(sorted((len(r["kind"]), r["row"], r["similarity"], r["n"]) for r in dg.row_aliasing(rows, 0.2, 3, 5.0, 12.0, 2, 16).collect()))
    for want, got_ in zip(*made, strict=True):
        assert want and np.allclose(want, got_, rtol=0, atol=3e-9)


def test_edges_meet_vectors_in_files(spark, small):
    rows = rows_of(spark, 200, 6)
    edges = rows.select("seq_id", F.col("idx").alias("src"), (F.col("idx") + 2).alias("dst"), F.lit(0.5).alias("post"))
    got_ = {(r["src"], r["dst"]): (r["cos"], r["l2"]) for r in graph.pair_facts(edges, rows).collect()}
    v = {r["idx"]: (r["seq_id"], np.array(r["v"])) for r in rows.collect()}
    want = {(i, i + 2): (v[i][1], v[i + 2][1]) for i in v if i + 2 in v and v[i][0] == v[i + 2][0]}
    assert got_.keys() == want.keys()
    for k, (a, b) in want.items():
        assert np.allclose(got_[k], (a @ b / np.linalg.norm(a) / np.linalg.norm(b), np.linalg.norm(a - b)))


def test_what_a_step_shuffled_goes_with_it(spark, tmp_path):
    """The setting under which a written step deletes its shuffle files is the session's own again afterwards; that they go is not looked at."""
    from trailmark.operators import tables

    before = spark.conf.get(tables.CLEANUP, None)
    made = tables.written(spark.range(1000).repartition(3, "id").groupBy("id").count(), "step")
    assert made.count() == 1000 and spark.conf.get(tables.CLEANUP, None) == before
