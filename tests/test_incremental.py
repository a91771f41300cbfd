"""The cache of encoded scans: what is stored isn't encoded again, and side tables go by scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.sources.incremental import EncodedCache, content_keys


def scans(spark, which, seed=0):
    dice = np.random.default_rng(seed)
    cloud = {i: dice.normal(size=(20 + i, 3)) for i in range(10)}
    return spark.createDataFrame([(i, *map(float, p)) for i in which for p in cloud[i]], "scan_id long, x double, y double, z double")


class Encoder:
    """Counts the scans that it is given."""

    def __init__(self):
        self.seen = []

    def __call__(self, points):
        self.seen.append(sorted(r[0] for r in points.select("scan_id").distinct().collect()))
        return points.groupBy("scan_id").agg(F.array(F.min("x"), F.max("y")).alias("descriptor"))


def test_keys_go_by_content(spark):
    points = scans(spark, range(4))
    keys = {r["scan_id"]: r["key"] for r in content_keys(points, {"a": 1}).collect()}
    again = {r["scan_id"]: r["key"] for r in content_keys(points.orderBy(F.rand(3)).repartition(3), {"a": 1}).collect()}
    assert keys == again and len(set(keys.values())) == 4
    assert not set(keys.values()) & {r["key"] for r in content_keys(points, {"a": 2}).collect()}
    moved = points.withColumn("x", F.when(F.col("scan_id") == 2, F.col("x") + 1e-9).otherwise(F.col("x")))
    assert {i for i, k in {r["scan_id"]: r["key"] for r in content_keys(moved, {"a": 1}).collect()}.items() if k != keys[i]} == {2}


def test_second_run_encodes_nothing(spark, tmp_path):
    cache, encode = EncodedCache(spark, str(tmp_path / "c"), {"bins": 16}), Encoder()
    assert cache.update(scans(spark, range(5)), encode) == 5 and encode.seen == [[0, 1, 2, 3, 4]]
    assert cache.update(scans(spark, range(5)), encode) == 0 and len(encode.seen) == 1
    assert cache.update(scans(spark, range(6)), encode) == 1 and encode.seen[1:] == [[5]]
    changed = scans(spark, range(6)).withColumn("z", F.when(F.col("scan_id") == 3, F.col("z") * 2).otherwise(F.col("z")))
    assert cache.update(changed, encode) == 1 and encode.seen[2:] == [[3]]
    want = {r["scan_id"]: r["descriptor"] for r in Encoder()(changed).collect()}
    assert {r["scan_id"]: r["descriptor"] for r in cache.read(changed).collect()} == want
    other = EncodedCache(spark, str(tmp_path / "c"), {"bins": 8})
    assert other.update(scans(spark, range(2)), encode) == 2


def test_a_stopped_run_goes_on(spark, tmp_path):
    cache, points = EncodedCache(spark, str(tmp_path / "c"), {}), scans(spark, range(10))
    encode, calls = Encoder(), []

    def breaks(rows):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return encode(rows)

    with pytest.raises(RuntimeError, match="stopped"):
        cache.update(points, breaks, parts=3)
    kept = encode.seen[0]
    done = cache.update(points, encode, parts=3)
    assert done == 10 - len(kept) and sorted(sum(encode.seen, [])) == list(range(10))
    assert cache.read(points).count() == 10


def test_side_tables_by_scan(spark, tmp_path):
    cache, points = EncodedCache(spark, str(tmp_path / "c"), {}), scans(spark, range(4))
    cache.update(points, Encoder())
    cache.update(points.where("scan_id < 3"), lambda p: p.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n")), "layout")
    got = {r["scan_id"]: (len(r["descriptor"]), r["n"]) for r in cache.read(points.where("scan_id < 3"), "layout").collect()}
    assert got == {0: (2, 20), 1: (2, 21), 2: (2, 22)}
    with pytest.raises(Exception, match="scan 3 lacks layout"):
        cache.read(points, "layout").collect()
    with pytest.raises(ValueError, match="nothing is stored as other"):
        cache.read(points, "other")
