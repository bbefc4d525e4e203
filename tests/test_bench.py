"""bench.py prints exactly one JSON line with a time per registered query."""

import json
import os
import subprocess
import sys

from meterwise.plans.catalog import REGISTERED

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2", BENCH_REPEAT="1",
               BENCH_WARMUP="0", BENCH_SERVED="0", BENCH_TRAINING="0", METERWISE_DRIVER_MEMORY="2g")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, cwd="/tmp",
                         capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [line for line in out.stdout.splitlines() if line.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and d["sf"] == 0.001 and set(d["queries"]) == set(REGISTERED)
    assert abs(d["value"] - sum(d["queries"].values())) < 1e-6
