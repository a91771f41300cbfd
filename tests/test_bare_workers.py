"""Queries with Python workers run where workers have no copy of the package, as executors of a cluster do."""

import os
import subprocess
import sys
from pathlib import Path


ROOT = Path(__file__).resolve().parent.parent
NAMES = (
    "keyframe_select", "cosine_topk", "dft_magnitude", "encode_points", "edge_embeddings", "attention_with_weights", "network_forward", "phase_edge_bias", "alignment_bias", "soft_binning_octave", "log_polar_spectrum", "plane_projection", "quantize_u16",
    "bootstrap_ci", "verified_candidates",
)
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import tempfile
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    .config("spark.driver.memory", "4g").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate())
def absent(batches):
    import importlib.util
    for b in batches:
        yield b.assign(id=int(importlib.util.find_spec("trailmark") is None))
assert spark.range(1).mapInPandas(absent, "id long").first()[0] == 1, "workers see the package"
import __spark_entry__
queries = __spark_entry__.queries()
for name in {names!r}:
    queries[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("ran", name, flush=True)
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    made = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT), names=NAMES)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900, check=False)
    ran = [line.split()[1] for line in made.stdout.splitlines() if line.startswith("ran ")]
    assert ran == list(NAMES), (ran[-1:], made.stderr[-2000:])
