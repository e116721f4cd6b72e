"""Times the headline queries and prints one line of JSON. BENCH_SF_DIR: the tables; BENCH_CPUS: threads."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

import numpy as np

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
sys.path.insert(0, f"{ROOT}/tests")
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TABLES = ("wave_ymax", "wave_value_at", "wave_cross_second_rising", "wave_deriv", "wave_integ", "wave_bandwidth_low", "complex_db20", "complex_square", "long_unpivot", "noise_top_k", "noise_share", "corner_report", "time_bucket_mean", "align_whole", "describe_runs")


def noise_file(path: str, devices: int = 20_000, points: int = 101) -> None:
    """Row records: a struct of five doubles for each device, the last the total."""
    import writers as W

    members = [(m, "float64") for m in ("rn", "fn", "id", "ig", "total")]
    types = W.type_decl(1, "sweep", "float64") + W.type_decl(2, "device", members)
    traces = b"".join(W.trace(10 + i, f"x{i // 1000}.d{i % 1000}", 2) for i in range(devices))
    record = np.dtype([("c", ">u4"), ("i", ">u4"), ("x", ">f8"), ("d", [("c", ">u4"), ("i", ">u4"), ("v", ">f8", 5)], devices)])
    rows = np.zeros(points, record)
    rows["c"], rows["i"], rows["x"] = 0x10, 1, np.logspace(0, 9, points)
    rows["d"]["c"], rows["d"]["i"] = 0x10, np.arange(10, 10 + devices)
    rows["d"]["v"] = np.random.default_rng(1).random((points, devices, 5))
    with open(path, "wb") as f:
        f.write(W.binary(0x300, {"analysis name": "noise"}, types, W.trace(1, "freq", 1), traces, rows.tobytes()))


def transient_file(path: str, signals: int = 200, points: int = 500_000, window: int = 4096) -> None:
    """Windows of doubles."""
    import writers as W

    types = W.type_decl(1, "sweep", "float64") + W.type_decl(2, "V", "float64")
    traces = b"".join(W.trace(10 + i, f"n{i}", 2) for i in range(signals))
    per = window // 8
    windows = points // per
    block = np.zeros(windows, np.dtype([("c", ">u4"), ("k", ">u4"), ("x", ">f8", per), ("v", ">f8", (signals, per))]))
    block["c"], block["k"] = 0x10, per
    block["x"] = np.arange(windows * per).reshape(windows, per) * 1e-9
    block["v"] = np.random.default_rng(2).random((signals, per))
    head = W.binary(0x400, {"analysis name": "tran1", "PSF window size": window, "PSF sweep points": windows * per}, types, W.trace(1, "time", 1), traces, block.tobytes(), table=False)
    with open(path, "wb") as f:
        f.write(head)


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from wavemill.plans.catalog import QUERIES
    from wavemill.sources.dataset import Dataset

    took = {}

    def timed(name, make, runs: int = 3):
        best = None
        for _ in range(runs):
            t = time.time()
            make().write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - t)
        took[name] = round(best, 3)

    for name in TABLES:
        timed(name, lambda name=name: QUERIES[name](spark, SF))
    with tempfile.TemporaryDirectory() as at:
        noise_file(f"{at}/noise.noise")
        d = Dataset(spark, f"{at}/noise.noise")
        timed("file_noise_sum_by_freq", lambda: d.scan_long(field="total").groupBy("freq").agg(F.sum("value").alias("total")))
        timed("file_noise_one_block", lambda: d.scan_long(field="total").filter(F.col("signal").startswith("x3.")).groupBy("freq").agg(F.sum("value").alias("total")))
        transient_file(f"{at}/tran1.tran.tran")
        t = Dataset(spark, f"{at}/tran1.tran.tran")
        for n in (1, 10, 200):
            timed(f"file_transient_{n}_of_200", lambda n=n: t.scan_long(only=[f"n{i}" for i in range(n)]).groupBy("signal").agg(F.sum("value").alias("s")))
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF}))


if __name__ == "__main__":
    main()
