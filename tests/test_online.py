"""The linked stream equals a replay and plain loops; a loop that fails between its steps goes on to the same answers."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import knn
from trailmark.streaming import online
from trailmark.streaming.store import DescriptorStore

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RULES = online.Rules(distance=1.5, degrees=400.0, seconds=1e9, half=2, most_active=6, threshold=0.5, most_links=2)


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def events(seqs=(0, 1), n=30, changes=True):
    dice, rows = np.random.default_rng(3), []
    for q in seqs:
        for i in range(n):
            rows.append((q, 2 * i, "scan", i, float(i), float(i) if i % 3 else float(i) - 0.9, 0.0, 0.0, 0.0, dice.normal(size=3).tolist()))
            if changes and i > 3:
                rows.append((q, 2 * i + 1, "update", i - 3, *[None] * 5, dice.normal(size=3).tolist()))
        if changes and q:
            rows.append((q, 2 * n, "reset", *[None] * 7))
            rows.append((q, 2 * n + 2, "scan", n + 1, 0.0, 0.0, 0.0, 0.0, 0.0, [1.0, 0.0, 0.0]))
    return rows


def plain(rows):
    return sorted(str(tuple(r)) for r in rows)


def feed(spark, rows, folder, parts):
    for k in range(parts):
        spark.createDataFrame([r for r in rows if r[1] * parts // 70 == k], online.INPUT).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(online.INPUT).option("maxFilesPerTrigger", 1).parquet(folder)


def naive(rows):
    """The same events of one sequence by direct definitions, with no state that is shared with the operator."""
    out, nodes, links, last = [], [], set(), None
    cos = lambda a, b: round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 9)

    def similar(i, at):
        own = [n for n, _ in nodes].index(i)
        scored = sorted((-cos(nodes[own][1], v), n) for p, (n, v) in enumerate(nodes) if abs(p - own) > 2)
        for s, n in [x for x in scored if -x[0] >= 0.5][:2]:
            links.add(frozenset((i, n)))
            out.extend([(at, "similar", i, n, -s), (at, "similar", n, i, -s)])

    for _, at, kind, i, _, x, *_, v in rows:
        if kind == "reset":
            nodes, links, last = [], set(), None
            out.append((at, "reset", None, None, None))
        elif kind == "update":
            if i in [n for n, _ in nodes]:
                nodes = [(n, v if n == i else w) for n, w in nodes]
                for pair in [p for p in links if i in p]:
                    a, b = pair
                    links.discard(pair)
                    out.extend([(at, "unlinked", a, b, None), (at, "unlinked", b, a, None)])
                out.append((at, "updated", i, None, None))
                similar(i, at)
        elif last is None or abs(x - last) > 1.5:
            last = x
            out.append((at, "keyframe", i, None, None))
            for n, _ in nodes[-2:]:
                out.extend([(at, "temporal", n, i, None), (at, "temporal", i, n, None)])
            nodes.append((i, v))
            similar(i, at)
            if len(nodes) > 6:
                gone = nodes.pop(0)[0]
                links = {p for p in links if gone not in p}
                out.append((at, "frozen", gone, None, None))
    return out


def test_replay_same_as_plain_loops(spark):
    rows = events()
    got = online.replay(spark.createDataFrame(rows, online.INPUT), RULES).collect()
    for q in (0, 1):
        want = naive([r for r in rows if r[0] == q])
        assert sorted(map(str, ((r["at"], r["kind"], r["src"], r["dst"], r["score"]) for r in got if r["seq_id"] == q))) == sorted(map(str, want))
    assert {"keyframe", "temporal", "similar", "unlinked", "updated", "frozen", "reset"} == {r["kind"] for r in got}


@pytest.mark.parametrize("parts", [1, 7])
def test_stream_same_as_replay(spark, tmp_path, parts):
    rows = events()
    stream = feed(spark, rows, str(tmp_path / "in"), parts)
    name = f"linked{parts}"
    run = online.link(stream, RULES).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert run.awaitTermination(240)
    assert plain(spark.table(name).collect()) == plain(online.replay(spark.createDataFrame(rows, online.INPUT), RULES).collect())


class Breaks(DescriptorStore):
    """Fails once, between appending and answering, in the third micro-batch."""

    broken = False

    def query(self, *a, **b):
        if not Breaks.broken and len([p for p in self.rows().select("idx").collect()]) > 8:
            Breaks.broken = True
            raise RuntimeError("lost between two steps")
        return super().query(*a, **b)


def test_loop_goes_on_after_a_failure(spark, tmp_path):
    rows = events(changes=False)
    stream = feed(spark, rows, str(tmp_path / "in"), 4)
    store = Breaks(spark, str(tmp_path / "store"), "seq_id long, idx long, v array<double>", 4)

    def start():
        return online.loop(online.link(stream, RULES), store, str(tmp_path / "out"), 5, 3, 4).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="lost between two steps"):
        start().awaitTermination(240)
    assert start().awaitTermination(240) and Breaks.broken
    whole = online.replay(spark.createDataFrame(rows, online.INPUT), RULES)
    assert plain(spark.read.schema(online.OUTPUT).parquet(str(tmp_path / "out/events")).drop("part").collect()) == plain(whole.collect())
    nodes = whole.where("kind = 'keyframe'").select("seq_id", F.col("src").alias("idx"), "v")
    assert store.rows().count() == nodes.count()
    want = knn.nearest(nodes.where("idx % 5 = 0 and idx > 0"), nodes, 3, gap=4, past_only=True).collect()
    got = spark.read.parquet(str(tmp_path / "out/answers")).collect()
    assert sorted((r["seq_id"], r["q"], r["c"], r["rank"]) for r in got) == sorted((r["seq_id"], r["q"], r["c"], r["rank"]) for r in want) and want


def test_idle_sequences_close(spark, tmp_path):
    stream = feed(spark, events((0,), 6, False), str(tmp_path / "in"), 1)
    run = online.link(stream, RULES, idle_ms=1).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 120
        while time.time() < until and not spark.table("idle").where("kind = 'closed'").head(1):
            time.sleep(1)
    finally:
        run.stop()
    got = spark.table("idle").collect()
    kept = sorted(r["src"] for r in got if r["kind"] == "keyframe")
    assert kept and sorted(r["src"] for r in got if r["kind"] == "frozen") == kept and sum(r["kind"] == "closed" for r in got) == 1


def test_two_readers_of_a_store_agree(spark, tmp_path):
    schema = "seq_id long, idx long, v array<double>"
    one, two = (DescriptorStore(spark, str(tmp_path / "s"), schema, 8) for _ in range(2))
    rows = spark.createDataFrame([(q, i, [float(i), 1.0]) for q in range(20) for i in range(5)], schema)
    one.add(rows)
    assert one.rows().count() == two.rows().count() == 100
    one.clear()
    assert one.rows().count() == two.rows().count() == DescriptorStore(spark, str(tmp_path / "s"), schema, 8).rows().count() == 0
    two.add(rows.limit(3), "a")
    two.add(rows.limit(3), "a")
    assert one.rows().count() == 3 and one.version == 1


def files_read(df):
    """Files that the scans of a finished plan opened."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), 0
    leaves = plan.collectLeaves() if "Adaptive" not in plan.getClass().getName() else plan.executedPlan().collectLeaves()
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        found += metrics.apply("numFiles").value() if metrics.contains("numFiles") else 0
    return found


def test_a_question_reads_its_own_buckets(spark, tmp_path):
    schema = "seq_id long, idx long, v array<double>"
    store = DescriptorStore(spark, str(tmp_path / "s"), schema, 16)
    rows = spark.createDataFrame([(q, i, [float(i), 1.0]) for q in range(64) for i in range(3)], schema).coalesce(1)
    store.add(rows)
    bucket = rows.where("seq_id = 5").select(store._bucket().alias("b")).first()["b"]
    used = rows.select(store._bucket()).distinct().count()
    assert used > 8 and files_read(store.rows()) == used and files_read(store.rows([bucket])) == 1
    assert {r["c"] for r in store.query(rows.where("seq_id = 5 and idx = 2"), 2).collect()} == {0, 1}
