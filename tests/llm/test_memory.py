"""Memory of executors that run in processes of their own."""

import os
import pathlib
import subprocess
import sys

import pyspark

REPO = pathlib.Path(__file__).parents[2]

PROGRAM = """
import sys
from pyspark.sql import SparkSession
import corpus_pipeline
from wavemill.llm import common

at = sys.argv[1]
spark = (
    SparkSession.builder.master("local-cluster[2,1,900]").config("spark.executor.memory", "600m").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
    .config("spark.executor.extraJavaOptions", f"-Xlog:gc:file={at}/gc-%p.log").config("spark.checkpoint.dir", f"file://{at}/shared").config("spark.sql.shuffle.partitions", "2").getOrCreate()
)
docs = spark.createDataFrame([(i, f"w{i} " * 40) for i in range(8)], "doc_id bigint, text string")
spark.range(0, 8, 1, 8).count()
corpus_pipeline.repeated_passages(spark, docs, "").count()
spark.stop()
"""


def test_executors_collect_between_steps(tmp_path):
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in pathlib.Path(pyspark.__file__).parent.iterdir():  # the executors' logs go to work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"PYTHONPATH": str(REPO), "PYSPARK_PYTHON": sys.executable, "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    run = subprocess.run([sys.executable, "-c", PROGRAM, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    logs = [p.read_text().count("Pause Full (System.gc())") for p in tmp_path.glob("gc-*.log")]
    assert len(logs) == 2 and min(logs) >= 3, logs
