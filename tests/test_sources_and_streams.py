"""Readers, codecs and the stream."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import codec, trajectory
from trailmark.plans.views import poses
from trailmark.sources import scans
from trailmark.streaming.keyframes import stream_keyframes

SMALL = "/root/testdata/sf0.001"


def test_packed_scans(spark, tmp_path):
    np.array([(20000, 20200, 20400, 51, 0, 7)] * 3, scans.LAYOUTS["packed12"]).tofile(tmp_path / "96.bin")
    got = scans.read_scans(spark, str(tmp_path), "packed12").collect()
    assert [(r["scan"], r["x"], round(r["y"], 6), round(r["z"], 6), round(r["intensity"], 6)) for r in got] == [("96", 0.0, 1.0, 2.0, 0.2)] * 3


def test_broken_scan():
    with pytest.raises(ValueError, match="whole number"):
        scans.decode(b"123", "float4")
    assert len(scans.decode(b"", "packed22")) == 0
    assert len(scans.decode(struct.pack("<8f", 1, 2, 3, 4, 500, 0, 0, 0), "float4")) == 1


def test_poses_skip_bad_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,x,y,z,roll,pitch,yaw\n1,2,3,4,0,0,0.5\n2,nan,0,0,0,0,0\n3,1\n")
    assert [(r["ts"], r["x"], r["yaw"]) for r in scans.read_csv_poses(spark, str(tmp_path / "a.csv")).collect()] == [(1.0, 2.0, 0.5)]
    (tmp_path / "b.txt").write_text(" ".join(map(str, range(12))) + "\n1 2 3\n")
    assert [r["m"] for r in scans.read_matrix_poses(spark, str(tmp_path / "b.txt")).collect()] == [[float(i) for i in range(12)]]
    (tmp_path / "c.txt").write_text("5 1 2 3 0 0 0 1\n5 1\n")
    assert [(r["ts"], r["qw"]) for r in scans.read_quaternion_poses(spark, str(tmp_path / "c.txt")).collect()] == [(5.0, 1.0)]


def test_histogram_sums_to_the_top(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0],), ([0.0, 0.0, 0.0],)], "h array<double>")
    got = df.select(codec.quantize(F.col("h")).alias("q")).select("q", codec.dequantize(F.col("q")).alias("d")).collect()
    assert sum(got[0]["q"]) == 65535 and got[0]["d"] == pytest.approx([1 / 7, 2 / 7, 4 / 7], abs=1e-4)
    assert got[1]["q"] == [0, 0, 0] and got[1]["d"] == pytest.approx([1 / 3] * 3)


def test_record_round_trip(spark):
    df = spark.createDataFrame([([*range(16)], [0.5] * 7, 9.25, 3, b"d" * 20)], "h array<long>, p array<double>, t double, n long, d binary")
    row = df.select(codec.pack(*[F.col(c) for c in "hptnd"]).alias("r")).select("r", codec.unpack(F.col("r")).alias("u")).first()
    assert len(row["r"]) == 152
    assert (row["u"]["bins"], row["u"]["pose"], row["u"]["ts"], row["u"]["number"], bytes(row["u"]["digest"])) == ([*range(16)], [0.5] * 7, 9.25, 3, b"d" * 20)


def test_stream_equals_batch(spark, tmp_path):
    rows = poses(spark, SMALL).cache()
    for k, part in enumerate(("idx < 30", "idx >= 30")):
        rows.where(part).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    asked = stream_keyframes(stream, 2.0, 15.0, 60.0).writeStream.format("memory").queryName("keyframes").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert asked.awaitTermination(120)
    got = {(r["seq_id"], r["idx"]): r["selected"] for r in spark.table("keyframes").collect()}
    want = {(r["seq_id"], r["idx"]): r["selected"] for r in trajectory.select_keyframes(rows, 2.0, 15.0, 60.0).collect()}
    assert got == want
