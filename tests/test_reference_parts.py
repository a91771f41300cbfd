"""Encoder, rigid motions, network, registration, store, registry and stored fits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import encoder, grids, knn, network as nw, poses as se, registration, registry, sensors, spectral, trajectory as tr
from trailmark.sources import models
from trailmark.streaming.store import DescriptorStore

SPEC = encoder.Spec(rows=8, cols=36, out_rows=4, e_min=-30.0, e_max=30.0, cross=3, layout_cols=12)


def scan(seed: int, n: int = 400):
    """Points at the middle of azimuth cells, so that a turn by whole cells keeps every point's cell."""
    dice = np.random.default_rng(seed)
    az = (dice.integers(0, 36, n) + 0.5) * math.tau / 36 - math.pi
    r, z = dice.uniform(3, 60, n), dice.uniform(-4, 4, n)
    return [(seed, float(a * math.cos(t)), float(a * math.sin(t)), float(h), 0.5) for a, t, h in zip(r, az, z, strict=True)]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(scan(1) + scan(2), "scan_id long, x double, y double, z double, intensity double")


def test_descriptor_does_not_change_with_the_heading(spark, points):
    turns = [k * math.tau / 36 for k in (0, 5, 17)]
    spread = {r["scan_id"]: r["spread"] for r in encoder.rotation_probe(points, SPEC, turns).collect()}
    assert set(spread) == {1, 2} and max(spread.values()) < 1e-6
    a, b = (r["descriptor"] for r in encoder.encode_points(points, SPEC).orderBy("scan_id").collect())
    assert np.abs(np.array(a) - np.array(b)).max() > 1e-2


@pytest.mark.parametrize("spec", [SPEC, encoder.Spec(**{**vars(SPEC), "cross": 0, "inter": (), "statistics": ("sum",), "normalize": "sum"}), encoder.Spec(**{**vars(SPEC), "zero_center": True, "log_magnitude": True, "normalize": "none", "inter": ("diff",), "statistics": ("max", "min", "mean")}), encoder.Spec(**{**vars(SPEC), "inter": ("ratio",)})])
def test_encoder_same_as_direct_computation(spark, points, spec):
    made = encoder.encode_points(points, spec, keep=True).orderBy("scan_id").collect()
    for r in made:
        image = np.array(r["image"]).reshape(spec.out_rows, spec.cols)
        signal = image - image.mean(axis=1, keepdims=True) if spec.zero_center else image
        z = np.fft.rfft(signal, axis=1)
        m = np.abs(z)
        assert r["entropy"] == pytest.approx(np.mean([-(p * np.log(p + 1e-8)).sum() for p in (m**2 / ((m**2).sum(axis=1, keepdims=True) + 1e-8))]), rel=1e-6)
        m = np.log(m + 1e-8) if spec.log_magnitude else m
        edges = spec.bins
        at = np.clip(np.searchsorted(edges, np.arange(m.shape[1]), side="right") - 1, 0, len(edges) - 2)
        f = {"sum": np.sum, "mean": np.mean, "max": np.max, "min": np.min, "std": lambda x: np.sqrt(np.var(x) + 1e-8)}
        own = [np.array([[f[s](row[at == b]) for b in range(len(edges) - 1)] for row in m]) for s in spec.statistics]
        between = [(np.log(c[:, 1:] + 1e-8) - np.log(c[:, :-1] + 1e-8) if kind == "ratio" else np.diff(c, axis=1)) for kind in spec.inter for c in own]
        channels = [c.ravel() for c in own + between]
        if spec.cross:
            low = z[:, 1 : spec.cross + 1]
            c = low[:-1] * np.conj(low[1:]) / (np.abs(low[:-1]) * np.abs(low[1:]) + 1e-8)
            channels.append(np.stack((c.real, c.imag), axis=-1).ravel())
        if spec.normalize == "channels":
            channels = [c / max(np.linalg.norm(c), 1e-12) for c in channels]
        want = np.concatenate(channels)
        if spec.normalize == "sum":
            want = want / (want.sum() + 1e-8)
        assert np.nan_to_num(np.array(r["descriptor"])) == pytest.approx(np.nan_to_num(want), abs=1e-4)
        assert np.array(r["layout"]).reshape(spec.out_rows, 12) == pytest.approx(image.reshape(spec.out_rows, 12, 3).mean(axis=2), abs=1e-9)


def test_operating_table_holds_selected_scans_only(spark, points):
    keys = spark.createDataFrame([(0, 7, 2, 1.0)], "seq_id long, idx long, scan_id long, x double")
    row = encoder.operating_table(points, keys, SPEC, 4).collect()
    assert [(r["scan_id"], r["idx"], len(r["layout"]), len(r["sketch"]["re"])) for r in row] == [(2, 7, 48, 16)]


def test_rigid_motions(spark):
    dice = np.random.default_rng(3)
    angles = dice.uniform(-3, 3, (12, 3)).tolist() + [[0, 0, 0], [math.pi, 0, 0], [0, math.pi, 0], [0, 0, math.pi], [0, 0, math.pi / 2]]
    rows = [(i, *map(float, dice.normal(size=3)), *map(float, a)) for i, a in enumerate(angles)]
    df = spark.createDataFrame(rows, "i int, x double, y double, z double, roll double, pitch double, yaw double").select("i", se.from_angles(*[F.col(c) for c in ("x", "y", "z", "roll", "pitch", "yaw")]).alias("m"))
    one = F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])
    facts = df.select(
        "m", se.compose(F.col("m"), se.inverse(F.col("m"))).alias("unit"), se.from_seven(se.to_seven(F.col("m"))).alias("back"), se.is_valid(F.col("m")).alias("valid"), se.relative(F.col("m"), F.col("m")).alias("same"),
        se.rotation_angle(F.col("m"), F.col("m")).alias("turn"), se.distance(F.col("m"), F.col("m")).alias("d"), se.to_seven(F.col("m")).alias("s"), se.interpolate(one, F.col("m"), F.lit(0.0)).alias("start"), se.interpolate(one, F.col("m"), F.lit(1.0)).alias("end"),
        se.rotation_angle(one, se.interpolate(one, F.col("m"), F.lit(0.5))).alias("half"), se.rotation_angle(one, F.col("m")).alias("whole"),
    ).collect()
    for r in facts:
        m = np.array(r["m"]).reshape(4, 4)
        assert m[:3, :3] @ m[:3, :3].T == pytest.approx(np.eye(3), abs=1e-9) and r["valid"]
        for name in ("unit", "same", "start"):
            assert r[name] == pytest.approx(np.eye(4).ravel(), abs=1e-9)
        assert r["back"] == pytest.approx(r["m"], abs=1e-9) and r["end"] == pytest.approx(r["m"], abs=1e-7)
        assert (r["turn"], r["d"]) == pytest.approx((0, 0), abs=1e-6) and r["s"][3] >= 0 and np.linalg.norm(r["s"][3:]) == pytest.approx(1)
        assert r["half"] == pytest.approx(r["whole"] / 2, abs=1e-6)
    bad = spark.range(1).select(*[se.is_valid(c).alias(n) for n, c in (("short", F.array(F.lit(1.0))), ("none", F.lit(None).cast("array<double>")), ("mirror", F.transform(one, lambda x, i: F.when(i == 0, -1.0).otherwise(x))), ("bottom", F.transform(one, lambda x, i: F.when(i == 12, 1.0).otherwise(x))))]).first()
    assert not any(bad)
    round_trip = spark.createDataFrame([(10.0, 5.0, 3.0), (-2.0, 7.0, -1.0), (0.0, 0.0, 0.0)], "x double, y double, z double").select("*", se.cartesian(se.spherical(F.col("x"), F.col("y"), F.col("z"))).alias("c")).collect()
    assert all((r["c"]["x"], r["c"]["y"], r["c"]["z"]) == pytest.approx((r["x"], r["y"], r["z"]), abs=1e-10) for r in round_trip)


def small_graph(spark):
    dice = np.random.default_rng(8)
    nodes = [(0, i, dice.normal(size=6).tolist()) for i in range(7)]
    edges = [(0, int(a), int(b), k % 2, *map(float, dice.normal(size=2))) for k, (a, b) in enumerate([(0, 1), (1, 0), (2, 1), (3, 1), (4, 3), (5, 3), (6, 5)])]
    return nodes, edges, spark.createDataFrame(nodes, "seq_id long, idx long, v array<double>"), spark.createDataFrame(edges, "seq_id long, src long, dst long, etype int, e0 double, e1 double").select("seq_id", "src", "dst", "etype", F.array("e0", "e1").alias("embed"))


def test_network_same_as_dense_computation(spark):
    """Two layers, two heads, an absolute branch, edge biases, residual, gate with a cap, and phase tokens, against matrices."""
    dice = np.random.default_rng(1)
    w = lambda *shape: dice.normal(size=shape) / 2
    layers = [nw.Attention(nw.Linear(w(4, 4)), nw.Linear(w(4, 4)), nw.Linear(w(4, 4)), 2, nw.Linear(w(4, 4)) if i else None, nw.Chain((nw.Linear(w(2, 2), w(2)),))) for i in range(2)]
    norms = [nw.Norm(w(4), w(4), w(4), np.abs(w(4)) + 0.5) for _ in range(2)]
    first, last, gate, phase = nw.Chain((nw.Linear(w(4, 6), w(4)), nw.Norm(w(4), w(4)), nw.relu)), nw.Linear(w(3, 4), w(3)), nw.Chain((nw.Linear(w(1, 4), w(1)),)), nw.Chain((nw.Norm(w(6), w(6)), nw.Linear(w(5, 6), w(5)), nw.gelu, nw.Linear(w(2, 5), w(2))))
    net = nw.Network(first, tuple(zip(layers, norms, strict=True)), last, gate=gate, phase=phase, phase_alpha=0.25)
    nodes, edges, ndf, edf = small_graph(spark)
    edf = edf.withColumns({"logit": F.when(F.col("etype") == 1, 0.5).otherwise(-0.25), "gate": F.lit(1.5)})
    got = nw.forward(ndf.withColumns({"phase": F.col("v"), "cap": F.lit(0.5)}), edf, net, "cap").orderBy("idx").collect()
    x = np.array([v for _, _, v in nodes])
    h = first(x)
    for i, (layer, norm) in enumerate(zip(layers, norms, strict=True)):
        out = np.zeros_like(h)
        for t in range(len(h)):
            mine = [e for e in edges if e[2] == t]
            if not mine:
                continue
            diff = np.array([h[e[1]] - h[t] for e in mine])
            q, k = layer.query(h[t : t + 1]).reshape(2, 2), layer.key(diff).reshape(-1, 2, 2)
            s = np.einsum("hd,ehd->eh", q, k) / math.sqrt(2) + layer.bias(np.array([e[4:] for e in mine])) + np.array([[0.5 if e[3] else -0.25] for e in mine])
            a = np.exp(s - s.max(axis=0))
            a /= a.sum(axis=0)
            v = layer.value(diff) + (layer.absolute(np.array([h[e[1]] for e in mine])) if layer.absolute else 0)
            out[t] = (a[:, :, None] * v.reshape(-1, 2, 2) * 1.5).sum(axis=0).ravel()
        out = norm(out)
        h = h + (np.maximum(out, 0) if i == 0 else out)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    want = np.hstack((unit(x), unit(last(h)) * 0.5 / (1 + np.exp(-gate(h))), 0.25 * unit(phase(x))))
    assert np.array([r["embedding"] for r in got]) == pytest.approx(want, abs=1e-9)


def test_policies_same_as_loops(spark):
    """Filter bank, convolution, attention, gate and soft bins over two images of three rows and nine frequencies."""
    dice = np.random.default_rng(2)
    w = lambda *shape: dice.normal(size=shape)
    x = np.abs(w(2, 3, 9))
    norm = nw.Norm(w(12), w(12))
    normed = lambda v: (v - v.mean()) / np.sqrt(v.var() + 1e-5) * norm.gain + norm.shift
    banks = [nw.Linear(w(4, 9), w(4)) for _ in range(3)]
    kernels, bias, project = w(3, 2, 5), w(3, 2), nw.Linear(w(12, 12), w(12))
    q, key, value, out = w(2, 4), nw.Linear(w(4, 5), w(4)), nw.Linear(w(4, 5), w(4)), nw.Linear(w(4, 8), w(4))
    first, last, wide = nw.Linear(w(6, 3), w(6)), nw.Linear(w(9, 6), w(9)), nw.Linear(w(12, 9), w(12))

    def convolved(m):
        padded = np.pad(m, ((0, 0), (2, 2)))
        h = np.array([[[max(0, (padded[r, f : f + 5] * kernels[r, c]).sum() + bias[r, c]) for f in range(9)] for c in range(2)] for r in range(3)])
        return np.concatenate([[h[r, c, 0:5].mean(), h[r, c, 4:9].mean()] for r in range(3) for c in range(2)])

    def attended(m):
        rows = []
        for row in m:
            code = np.array([[v for k in (0, 2) for v in (math.sin(f / 10_000 ** (k / 4)), math.cos(f / 10_000 ** (k / 4)))] for f in range(9)])
            seen = np.hstack((row[:, None], code))
            k, v, parts = key(seen), value(seen), []
            for one in q:
                for h in (slice(0, 2), slice(2, 4)):
                    e = np.exp(k[:, h] @ one[h] / math.sqrt(2))
                    parts.append((e / e.sum()) @ v[:, h])
            rows.append(out(np.concatenate(parts)[None, :])[0])
        return np.concatenate(rows)

    def gated(m):
        facts = lambda y: [y.mean(axis=1), y.std(axis=1, ddof=1), y.max(axis=1)]
        g = 1 / (1 + np.exp(-last(np.maximum(first(np.stack(facts(m), axis=1)), 0))))
        return wide(np.concatenate(facts(m * g))[None, :])[0]

    soft = np.array(spectral.soft_bins(9, [0.0, 2.0, 9.0]))
    cases = {
        "linear": (registry.POLICIES["linear"](3, tuple(banks), norm), lambda m: normed(np.concatenate([banks[r](m[r : r + 1])[0] for r in range(3)]))),
        "conv1d": (registry.POLICIES["conv1d"](3, kernels, bias, 2, project, norm), lambda m: normed(project(convolved(m)[None, :])[0])),
        "attention": (registry.POLICIES["attention"](3, q, key, value, out, 2, 4, norm=norm), lambda m: normed(attended(m))),
        "gated": (registry.POLICIES["gated"](3, first, last, wide, norm), lambda m: normed(gated(m))),
        "soft_binning": (registry.POLICIES["soft_binning"](3, 9, [0.0, 2.0, 9.0]), lambda m: (m @ soft.T).ravel()),
    }
    df = spark.createDataFrame([(i, m.ravel().tolist()) for i, m in enumerate(x)], "i int, m array<double>")
    got = nw.applied(df, {name: ("m", of) for name, (of, _) in cases.items()}).orderBy("i").collect()
    for r in got:
        for name, (_, want) in cases.items():
            assert r[name] == pytest.approx(want(x[r["i"]]), abs=1e-9), name


def test_dual_stream_mixes_both_contexts(spark):
    dice = np.random.default_rng(4)
    w = lambda *shape: dice.normal(size=shape) / 2
    nodes, edges, ndf, edf = small_graph(spark)
    net = lambda n: nw.Network(nw.Chain((nw.Linear(w(4, n), w(4)),)), ((nw.Attention(nw.Linear(w(4, 4)), nw.Linear(w(4, 4)), nw.Linear(w(4, 4)), 2), nw.Norm(np.ones(4), np.zeros(4), np.zeros(4), np.ones(4))),), nw.Linear(w(3, 4)), gate=nw.Chain((nw.Linear(w(1, 4)),)))
    main, phase = net(6), net(5)
    both = ndf.withColumn("phase", F.slice("v", 1, 5))
    a = {r["idx"]: r for r in nw.forward(both, edf, main).collect()}
    b = {r["idx"]: r for r in nw.forward(both.select("seq_id", "idx", F.col("phase").alias("v")), edf, phase).collect()}
    gate = nw.Chain((nw.Linear(w(1, 6), w(1)),))
    for fuse in (0.25, gate):
        for r in nw.dual_stream(both, edf, main, phase, fuse).collect():
            x, y = np.array(a[r["idx"]]["embedding"]), np.array(b[r["idx"]]["embedding"])[5:8] * a[r["idx"]]["alpha"]
            share = fuse if isinstance(fuse, float) else 1 / (1 + np.exp(-gate(np.concatenate((x[6:9], y))[None, :])[0, 0]))
            assert r["fused"] == pytest.approx(share) and r["embedding"] == pytest.approx([*x[:6], *((1 - share) * x[6:9] + share * y)], abs=1e-9)


def test_registration_finds_planted_motions(spark):
    dice = np.random.default_rng(5)
    cloud = dice.uniform(-10, 10, (500, 3))
    t, shift = 0.06, np.array([0.3, -0.2, 0.1])
    turn = np.array([[math.cos(t), -math.sin(t), 0], [math.sin(t), math.cos(t), 0], [0, 0, 1]])
    sets = {1: cloud, 2: cloud @ turn.T + shift, 3: dice.uniform(100, 120, (500, 3)), 4: cloud[:2]}
    rows = [(i, *map(float, p)) for i, ps in sets.items() for p in ps]
    clouds = registration.voxel_means(spark.createDataFrame(rows, "scan_id long, x double, y double, z double"), 1e-3)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (9, 1)], "q long, c long")
    got = {(r["q"], r["c"]): r for r in registration.verify(pairs, clouds).collect()}
    assert {k: r["verified"] for k, r in got.items()} == {(1, 2): True, (1, 3): False, (1, 4): False, (9, 1): False}
    m = np.array(got[1, 2]["motion"]).reshape(4, 4)
    assert m[:3, :3] == pytest.approx(turn, abs=1e-6) and m[:3, 3] == pytest.approx(shift, abs=1e-6)
    assert got[1, 2]["information"] == pytest.approx([100.0] * 3 + [1000.0] * 3) and got[1, 3]["motion"] is None


def test_store_on_a_stream_answers_as_a_batch_would(spark, tmp_path):
    dice = np.random.default_rng(6)
    rows = [(0, i, dice.normal(size=4).tolist()) for i in range(40)]
    schema = "seq_id long, idx long, v array<double>"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    store = DescriptorStore(spark, str(tmp_path / "store"), schema)
    assert store.rows().count() == 0
    for k in range(0, 40, 8):
        spark.createDataFrame(rows[k : k + 8], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    store.follow(stream, out, 10, 3, 5).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert store.rows().count() == 40
    got = {(r["q"], r["rank"]): r["c"] for r in spark.read.parquet(out).collect()}
    whole = spark.createDataFrame(rows, schema)
    asked = whole.where("idx % 10 = 0 and idx > 0")
    want = {(r["q"], r["rank"]): r["c"] for r in knn.nearest(asked, whole, 3, gap=5, past_only=True).collect()}
    assert got == want
    store.clear()
    store.add(whole.limit(3))
    assert store.rows().count() == 3


def test_ranks_across_blocks(spark):
    """Blocks of any size give the same neighbours, pairs, counts and ranks."""
    dice = np.random.default_rng(7)
    rows = [(s, i, dice.normal(size=5).round(1).tolist(), *map(float, dice.uniform(0, 20, 3))) for s in ("a", "b") for i in range(60)]
    df = spark.createDataFrame(rows, "seq_id string, idx long, v array<double>, x double, y double, z double")
    whole, cut = (sorted(map(tuple, knn.nearest(df, df, 4, "l2", 3, query_block=q, base_block=b).collect())) for q, b in ((2048, 16384), (7, 11)))
    assert whole == cut and len(whole) == 480
    got = {(r["seq_id"], r["q"]): r["c"] for r in knn.by_rank(df, df, lambda n: F.floor(n / 2), "l2", 3, 5.0, True, bins=8).collect()}
    for s in ("a", "b"):
        v, p = (np.array([r[k] if k == 2 else r[3:] for r in rows if r[0] == s]) for k in (2, 3))
        for i in range(60):
            d = [(round(float(np.sqrt(((v[i] - v[j]) ** 2).sum())), 9), j) for j in range(60) if abs(i - j) >= 3 and np.linalg.norm(p[i] - p[j]) > 5]
            assert got[s, i] == sorted(d)[len(d) // 2][1]
    counted = {r["threshold"]: r["n"] for r in knn.level_counts(df, [-1.0, 0.5], 5.0, 3).collect()}
    assert counted[0.5] == knn.above(df, df, 0.5, gap=3).count() and counted[-1.0] == 2 * sum(abs(i - j) >= 3 for i in range(60) for j in range(60))


@pytest.mark.parametrize("lattice", [1, 3])
def test_revisits_same_as_all_pairs(spark, lattice):
    """Laps, a random walk, rows on a lattice (so that distances tie with the radius), and two sequences."""
    dice = np.random.default_rng(lattice)
    laps = [(0, i, 20 * math.cos(i / 9), 20 * math.sin(i / 9), 0.0) for i in range(300)]
    walk = [(1, i, *map(float, p)) for i, p in enumerate(np.cumsum(dice.integers(-1, 2, (300, 3)), axis=0) * lattice)]
    rows = laps + walk
    got = {(r["seq_id"], r["i"]): r["match"] for r in tr.revisit_queries(spark.createDataFrame(rows, "seq_id long, idx long, x double, y double, z double"), 5.0, 30).collect()}
    want = {}
    for s, i, *p in rows:
        found = [j for t, j, *o in rows if t == s and j <= i - 30 and math.dist(p, o) < 5.0]
        if found:
            want[s, i] = min(found)
    assert got == want


def test_registry_loaders_and_stored_fits(spark, points, tmp_path):
    assert set(registry.METHODS) == {"spectral", "scan_context", "log_polar", "planes"}
    for name in ("scan_context", "log_polar", "planes"):
        made = registry.METHODS[name]
        assert {len(r["v"]) for r in made.encode(points).collect()} == {made.dim}
    with pytest.raises(ValueError):
        registry.register(registry.METHODS["planes"])
    assert set(registry.POLICIES) == {"linear", "conv1d", "attention", "soft_binning", "gated"}
    fitted = spark.createDataFrame([(0.5, 0.1)], "mu double, sigma double")
    models.save_fitted(fitted, f"{tmp_path}/fit", "places")
    assert models.load_fitted(spark, f"{tmp_path}/fit", "places", ("mu", "sigma")).first() == fitted.first()
    with pytest.raises(ValueError, match="lacks tau"):
        models.load_fitted(spark, f"{tmp_path}/fit", "places", ("tau",))
    with pytest.raises(Exception, match="holds places"):
        models.load_fitted(spark, f"{tmp_path}/fit", "other", ("mu",)).collect()
    with pytest.raises(ValueError, match="none of"):
        models.load_sequence(spark, "unknown", "", "")
    rows = spark.createDataFrame([("KITTI_00",), ("oxford_1",), ("x",)], "name string")
    got = {r["name"]: (r["sensor_id"], r["k"]) for r in sensors.with_sensor(rows, "name", sensors.dimension(spark, {"k": {"kitti": 3, "default": 7}})).collect()}
    assert got == {"KITTI_00": (0, 3.0), "oxford_1": (4, 7.0), "x": (4, 7.0)}
    assert [r[0] for r in spark.createDataFrame([(" Yes",), ("on",), ("0",), (None,)], "t string").select(sensors.truthy(F.col("t"))).collect()] == [True, True, False, False]
    assert registry.lookup(spark.range(5), "id", 3).collect()[0][0] == 3 and registry.lookup(spark.range(5), "id", 9).count() == 0


def test_full_rows_fills_gaps_then_rows(spark):
    cells = spark.createDataFrame([(1, 2, 0, 4.0), (1, 2, 2, 8.0), (1, 4, 1, 1.0)], "scan_id long, row int, col int, val double")
    grid = encoder.full_rows(cells, 6, 4).first()["grid"]
    a, b = [4.0, 6.0, 8.0, 6.0], [1.0] * 4
    assert grid == [a, a, a, a, b, b]
    assert grids.adaptive_windows(6, 4) == [(0, 2), (1, 3), (3, 5), (4, 6)]
