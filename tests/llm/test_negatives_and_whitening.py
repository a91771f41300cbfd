"""Hard negatives and whitening against brute force, on whole tables and on odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import negatives, queries, whitening
from trailmark.llm.common import table

SMALL = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def test_negatives_same_as_sql(same_as_sql):
    same_as_sql(queries.op12_hard_negatives, queries.oracle_sql()["op12_hard_negatives"])


def mined(rows, anchor, scale=256, n_pos=5, n_neg=5, low=80, high=100):
    """By plain loops, rows as ``(id, v, label)``."""
    taking = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v, lab) in enumerate(taking):
        if i is None or not anchor(i):
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, other) for k, (j, w, other) in enumerate(taking) if k != at]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for score, j, _ in [s for s in scored if s[2] == lab][:n_pos]:
            found = [s for s in scored if s[2] != lab and low * score <= 100 * s[0] <= high * score][:n_neg]
            out += [(i, j, rank, s[1], score, s[0]) for rank, s in enumerate(found, 1)]
    return sorted(out, key=str)


def held(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>, label int, row long, x string, i int")


@pytest.mark.parametrize("blocks", [(512, 4096, 32), (3, 5, 2), (1, 7, 1)])
@pytest.mark.parametrize("limit", [0, 20_000])
def test_negatives_same_as_loops(spark, blocks, limit):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(round(x, 1)) for x in rng.normal(size=5)], int(i % 3)) for i in range(40)]
    rows += [(7, rows[7][1], 1), (7, rows[7][1], 1), (20, rows[3][1], 0), (None, rows[3][1], 0), (None, rows[5][1], 2), (50, [1.0, 2.0], 0), (51, [], 1)]
    rows += [(60, None, 0), (61, [1.0, None], 0), (62, [NAN, 0.0], 1), (63, [INF], 1), (64, [1.0], None), (70, [-0.0, 0.0, 1e-310, 0.5, 0.5], 1)]
    a, r, d = blocks
    got = negatives.hard_negatives(held(spark, [(*x, 1, "y", 2) for x in rows]), "id", "v", "label", F.col("id") % 10 == 0, anchor_block=a, row_block=r, dim_chunk=d, broadcast_anchors=limit)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=str) == mined(rows, lambda i: i % 10 == 0)


def test_negatives_of_copies_and_hot_labels(spark):
    """Many equal scores: ids alone settle the order."""
    rows = [(i, [1.0, 0.5] if i % 2 else [0.9, 0.6], 0 if i % 3 else 1) for i in range(300)]
    got = negatives.hard_negatives(held(spark, [(*x, 1, "y", 2) for x in rows]), "id", "v", "label", F.col("id") % 50 == 0, anchor_block=2, row_block=37, dim_chunk=1)
    assert sorted(map(tuple, got.collect()), key=str) == mined(rows, lambda i: i % 50 == 0)


def test_negatives_of_nothing(spark):
    none = held(spark, [])
    assert negatives.hard_negatives(none, "id", "v", "label", F.col("id") % 10 == 0).count() == 0
    alone = held(spark, [(0, [1.0], 1, 1, "y", 2), (10, [1.0], 2, 1, "y", 2)])
    assert negatives.hard_negatives(alone, "id", "v", "label", F.col("id") % 10 == 0).count() == 0


def test_products_of_great_numbers_are_exact():
    a, b = np.array([[3_037_000_499, 1]]), np.array([[3_037_000_499, -5], [2, 2]])
    assert negatives.product(a, b).tolist() == [[3_037_000_499**2 - 5, 6_074_001_000]]
    for tile in (np.array([[-128, 127]]), np.array([[-129, 5]]), np.array([[1 << 40]]), np.zeros((2, 0), np.int64)):
        data, width = negatives.packed(tile)
        assert negatives.unpacked(data, width, len(tile)).tolist() == tile.tolist()


def direct(vectors):
    """Integers, deviations, eigenvalues and eigenvectors by the covariance."""
    dims = max(map(len, vectors))
    x = np.array([[math.floor(1024 * c) + 100_000 for c in [*v, *[0.0] * (dims - len(v))]] for v in vectors], object)
    d = len(x) * x - x.sum(axis=0)
    c = d.astype(float) / len(x)
    values, axes = np.linalg.eigh(c.T @ c / len(x))
    return (d**2).sum(axis=1).tolist(), c, values[::-1], axes[:, ::-1]


def test_whitening_same_as_eigenvectors(spark):
    source = {r["vec_id"]: r["embedding"] for r in table(spark, SMALL, "embeddings").collect()}
    ids = sorted(source)
    dev, c, values, axes = direct([source[i] for i in ids])
    rows = queries.op13_whitening(spark, SMALL).collect()
    assert len(rows) == 8 * len(ids) and {r["n"] for r in rows} == {len(ids)}
    got = np.zeros((len(ids), 8))
    for r in rows:
        at = ids.index(r["vec_id"])
        got[at, r["component"] - 1] = r["whitened"]
        assert r["deviation"] == dev[at] and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
    want = c @ axes[:, :8] / np.sqrt(values[:8])
    assert np.allclose(got, want * np.sign((got * want).sum(axis=0)), atol=1e-9)


def whitened(spark, vectors, parts=1, **how):
    df = spark.createDataFrame([(i, v, 5) for i, v in enumerate(vectors)], "id long, v array<double>, w int").repartition(parts)
    return whitening.whitened_components(df, "id", "v", **how).collect()


@pytest.mark.parametrize("fan", [2, 16])
def test_factors_of_many_tasks(spark, monkeypatch, fan):
    monkeypatch.setattr(whitening, "FAN", fan)
    monkeypatch.setattr(whitening, "_BLOCK_VALUES", 12)
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(200, 5)) * [9, 1, 1e-1, 3e-2, 1]).tolist()
    dev, c, values, axes = direct(vectors)
    rows = whitened(spark, vectors, parts=9)
    got = np.zeros((200, 5))
    for r in rows:
        got[r["id"], r["component"] - 1] = r["whitened"]
    want = c @ axes / np.sqrt(values)
    assert np.allclose(got, want * np.sign((got * want).sum(axis=0)), atol=1e-7)
    assert [r["deviation"] for r in sorted(rows, key=lambda r: (r["component"], r["id"]))[:200]] == dev


def test_odd_vectors(spark):
    vectors = [[1.0, 2.0, 0.0], [2.0], [], [1.0, 2.0, 0.0], [3.0, -1.0, 0.0]]
    dev, c, values, axes = direct(vectors)
    rows = whitened(spark, [*vectors, None, [NAN], [1.0, None], [INF, 1.0]])
    assert {r["id"] for r in rows} == set(range(5)) and {r["n"] for r in rows} == {5}
    assert [r["deviation"] for r in sorted(rows, key=lambda r: r["id"]) if r["component"] == 1] == dev
    third = [r["whitened"] for r in rows if r["component"] == 3]  # no variance
    assert third == [None] * 5 and all(r["identity_error"] < 1e-9 for r in rows)


def test_no_rows_one_row_and_great_numbers(spark):
    assert whitened(spark, []) == [] and whitened(spark, [[], []]) == []
    one = whitened(spark, [[1.0, 2.0]])
    assert [(r["whitened"], r["identity_error"], r["deviation"], r["explained"]) for r in one] == [(None, None, 0, 0.0)] * 2
    great = whitened(spark, [[1e300, 0.0], [-1e300, 1.0], [0.0, 0.5]])
    assert {r["deviation"] for r in great} == {None, max(r["deviation"] or 0 for r in great)} and all(math.isfinite(r["whitened"]) for r in great if r["whitened"] is not None)
    with pytest.raises(ValueError, match="longer than"):
        whitened(spark, [[0.0] * (whitening.MAX_DIMS + 1)])


def test_small_deviations_keep_their_digits():
    """A covariance would lose the small one: its square is below the rounding of the great one's."""
    rng = np.random.default_rng(4)
    u, _ = np.linalg.qr(rng.normal(size=(50, 4)))
    v, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    wanted = np.array([1.0, 1e-3, 1e-6, 1e-9])
    values, axes = whitening.jacobi((u * wanted) @ v.T)
    assert values == pytest.approx(wanted, rel=1e-6) and np.allclose(np.abs(axes.T @ v), np.eye(4), atol=1e-5)
    assert np.allclose(axes.T @ axes, np.eye(4), atol=1e-14)


def test_every_two_columns_meet_once():
    for d in (1, 2, 5, 8):
        met = [(p, q) for ps, qs in whitening._rounds(d) for p, q in zip(ps.tolist(), qs.tolist())]
        assert sorted(met) == [(p, q) for p in range(d) for q in range(p + 1, d)]
