import json
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import baselines, learned
from trailmark.sources import results
from trailmark.streaming.graph import stream_graph


def dense(spark, rows):
    return spark.createDataFrame([(i, list(range(len(x))), x) for i, x in rows], "scan_id long, at array<int>, val array<double>")


def folder():
    return tempfile.mkdtemp(prefix="spark-")


def test_log_polar_operator_keeps_constants_and_samples_the_centre():
    m = baselines.log_polar_operator(20, 60, 20, 60)
    assert np.allclose(m.sum(axis=1), 1)
    x = np.arange(1200.0).reshape(20, 60)
    assert np.allclose((m @ x.ravel())[:60], x[9:11, 29:31].mean())


def test_spectral_signature_ignores_rotation(spark):
    rng = np.random.default_rng(1)
    x = rng.random((20, 60))
    rows = [(0, x.ravel().tolist()), (1, np.roll(x, 7, axis=1).ravel().tolist())]
    a, b = (np.array(r["descriptor"]) for r in baselines.spectral_signature(dense(spark, rows)).orderBy("scan_id").collect())
    assert len(a) == 620 and np.allclose(a, b) and abs(np.linalg.norm(a) - 1) < 1e-9


def test_templates_find_the_rotation(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (8, 72)).astype(float)
    df = dense(spark, [(0, x.ravel().tolist()), (1, np.roll(x, 5, axis=1).ravel().tolist()), (2, rng.integers(0, 256, 576).astype(float).tolist())])
    made = baselines.iris_templates(df, 8, 72)
    t = {r["scan_id"]: bytes(r["template"]) for r in made.collect()}
    assert baselines.template_distances([t[0]], [t[1]], 72, 10)[0] < 0.01 < 0.2 < baselines.template_distances([t[0]], [t[2]], 72, 10)[0]
    bits = np.frombuffer(t[0], np.uint8).reshape(-1, 72)
    shifts = [np.abs(bits.astype(int) - np.roll(np.frombuffer(t[2], np.uint8).reshape(-1, 72), s, axis=1)).mean() for s in range(-10, 11)]
    pairs = made.where("scan_id = 0").select(F.lit(0).alias("q"), F.col("template").alias("a")).crossJoin(made.where("scan_id = 2").select(F.lit(2).alias("c"), F.col("template").alias("b")))
    assert abs(baselines.template_pairs(pairs, 72, 10).first()["distance"] - min(shifts)) < 1e-12
    coarse = made.where("scan_id = 0").select(baselines.coarse_signature(F.col("template"), 72).alias("s")).first()["s"]
    assert np.allclose(coarse, bits.mean(axis=1))


def test_plane_projection_ignores_rotation(spark):
    rng = np.random.default_rng(3)
    p = rng.gamma(2.0, 4.0, (500, 3)) * [3, 2, 1] * np.sign(rng.random((500, 3)) - 0.3)
    c, s = np.cos(0.7), np.sin(0.7)
    turned = p @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])
    assert np.allclose(baselines.plane_signature(p), baselines.plane_signature(turned), atol=1e-6)
    df = spark.createDataFrame([(0, *map(float, r)) for r in p] + [(1, 1.0, 2.0, 3.0)], "scan_id long, x double, y double, z double")
    got = {r["scan_id"]: np.array(r["descriptor"]) for r in baselines.plane_projection(df).collect()}
    assert abs(np.linalg.norm(got[0]) - 1) < 1e-9 and len(got[0]) == 192 and not got[1].any()


def test_principal_tokens_same_as_svd(spark):
    x = np.random.default_rng(4).normal(size=(60, 6)) * [5, 4, 3, 2, 1, 0.5]
    f = np.sign(x) * np.log1p(np.abs(x))
    z = (f - f.mean(0)) / f.std(0)
    want = z @ np.linalg.svd(z, full_matrices=False)[2][:3].T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "idx long, v array<double>")
    got = np.array([r["token"] for r in baselines.principal_tokens(df, "v", 3).orderBy("idx").collect()])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)


def test_rerank_with_correction_and_gate(spark):
    rng = np.random.default_rng(5)
    w1, w2, w3, g1, g2 = rng.normal(size=(4, 9)), rng.normal(size=(3, 4)), rng.normal(size=(1, 3)), rng.normal(size=(2, 3)), rng.normal(size=(1, 2))
    d = lambda w, norm=False: learned.Dense(w.tolist(), [0.1] * len(w), [1.5] * len(w) if norm else [], [0.2] * len(w) if norm else [])
    model = learned.Reranker(layers=(d(w1, True), d(w2), d(w3)), gate=(d(g1), d(g2)))
    curves, sims = rng.random((5, 4)), rng.random(5)
    from math import erf

    gelu = lambda v: np.array([a * (1 + erf(a / 2**0.5)) / 2 for a in v])
    base = 10 * curves.max(1) + sims
    top = np.sort(base)[::-1]
    gate = 1 / (1 + np.exp(-(g2 @ gelu(g1 @ [top[0], top[1], top[0] - top[1]] + 0.1) + 0.1)[0]))
    want = []
    for c, s, b in zip(curves, sims, base, strict=True):
        o = np.sort(c)[::-1]
        h = w1 @ np.concatenate((c, [s, o[0], c.mean(), c.std(ddof=1), o[0] - o[1]])) + 0.1
        h = gelu((h - h.mean()) / np.sqrt(h.var() + 1e-5) * 1.5 + 0.2)
        want.append(b + gate * (w3 @ gelu(w2 @ h + 0.1) + 0.1)[0])
    df = spark.createDataFrame([(0, i, c.tolist(), float(s)) for i, (c, s) in enumerate(zip(curves, sims, strict=True))], "q long, c long, curve array<double>, sim double")
    got = learned.rerank(df, model).orderBy("c").collect()
    assert np.allclose([r["score"] for r in got], want, atol=1e-5)
    assert [r["c"] for r in sorted(got, key=lambda r: r["rank"])] == list(np.argsort(-np.array(want)))


def test_best_block_of_a_log(spark):
    at = folder()
    line = "s-1 | R@1: {} (raw: 0)\ns-2 | R@1: 0.5 (raw: 0)\nAVERAGE | R@1: {}\n"
    with open(f"{at}/a.log", "w") as f:
        f.write("".join(line.format(a, b) for a, b in (("0.1", "0.3"), ("0.7", "0.6"), ("0.9", "0.6"))))
    open(f"{at}/b.log", "w").close()
    got = {r["sequence"]: (r["average"], r["recall"]) for r in results.read_best_block(spark, at).collect()}
    assert got == {"s-1": (0.6, 0.7), "s-2": (0.6, 0.5)}


def test_result_files(spark):
    at = folder()
    tree = {"00": {"x": [{"deep": {"recall@1": 0.25}}], "sketch": {"a": {"R@1": 0.5}, "b": {"R@1": 0.75}, "_c": {"R@1": 1}}}, "_average": {"R@1": 1}, "05": {}}
    for name, text in (("a", json.dumps(tree)), ("b", "no json")):
        with open(f"{at}/{name}.json", "w") as f:
            f.write(text)
    assert [tuple(r)[1:] for r in results.read_results(spark, at).collect()] == [("00", "", 0.25)]
    assert [tuple(r)[1:] for r in results.read_results(spark, at, ("sketch",)).collect()] == [("00", "sketch.b", 0.75)]


def test_caches_and_sinks(spark):
    assert results.cache_key({"a": 1, "b": [2]}) == results.cache_key({"b": [2], "a": 1}) != results.cache_key({"a": 1, "b": [3]})
    rows = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.25)], "seq_id long, idx long, recall_at_1 double")
    path = results.write_keyframes(rows, folder(), {"a": 1})
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        results.write_keyframes(rows, path.rsplit("/", 1)[0], {"a": 1})
    results.write_table(rows, to := folder() + "/t")
    assert {r["value"] for r in spark.read.text(to).collect()} == {"seq_id,idx,recall_at_1", "0,1,0.5000", "1,2,0.2500"}
    results.write_records(rows, to := folder() + "/r", "seq_id")
    assert spark.read.json(to).count() == 2
    extra = spark.createDataFrame([(1, "a"), (2, "b")], "idx long, e string")
    assert results.attach(rows, extra, ["idx"]).count() == 2
    with pytest.raises(Exception, match="no partner"):
        results.attach(rows, extra.where("idx = 1"), ["idx"]).collect()


def test_graph_on_a_stream(spark):
    at = folder()
    spark.createDataFrame([(0, i) for i in range(5)], "seq_id long, idx long").write.parquet(f"{at}/in")
    stream = spark.readStream.schema("seq_id long, idx long").parquet(f"{at}/in")
    run = stream_graph(stream, 2, 3).writeStream.format("memory").queryName("graph_events").option("checkpointLocation", f"{at}/c").outputMode("append").trigger(availableNow=True).start()
    assert run.awaitTermination(90)
    got = [tuple(r) for r in spark.table("graph_events").collect()]
    assert sorted(r[2] for r in got if r[1] == "frozen") == [0, 1]
    assert {(r[2], r[3]) for r in got if r[1] == "edge"} == {(i, j) for i in range(5) for j in range(5) if 0 < abs(i - j) <= 2}


def test_matrix_of_results(spark):
    rows = spark.createDataFrame([("m", "a", 0.9), ("m", "b", 0.5), ("n", "a", 0.8), ("n", "b", 0.5)], "method string, dataset string, recall_at_1 double")
    got = {r["method"]: (r["a"], r["b"], r["mean_rank"]) for r in results.matrix(rows).collect()}
    assert got == {"m": (0.9, 0.5, 1.0), "n": (0.8, 0.5, 1.5)}
