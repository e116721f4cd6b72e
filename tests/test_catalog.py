"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import wavemill.plans.files  # noqa: F401
from wavemill.plans.catalog import ORACLES, QUERIES


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, int | float):
        return "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 9) + 0.0
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = QUERIES[name](spark, sf)
    answer = con.execute(ORACLES[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in answer.fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=str) == want


def test_entry(spark, sf):
    assert entry.entry(spark).count() == 5
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_filters_reach_the_scan(spark, sf):
    plan = QUERIES["semi_join"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,100000.0)" in plan and "o_orderpriority" not in plan


def test_spectrum_of_whole_curves(spark, tmp_path):
    rng = np.random.default_rng(5)
    values = {"a": rng.normal(size=301), "b": rng.normal(size=200), "c": rng.normal(size=7), "d": np.array([2.5])}
    rows = [(k, i * 3 + 1, float(v)) for k, y in values.items() for i, v in enumerate(y)]
    rng.shuffle(rows)
    spark.createDataFrame([(k, int(i), float(v)) for k, i, v in rows], "event_type string, event_id bigint, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {}
    for r in QUERIES["wave_dft"](spark, str(tmp_path)).collect():
        got.setdefault(r["event_type"], {})[r["freq"]] = r["value"]
    assert set(got) == set(values)
    for k, y in values.items():
        want = np.abs(np.fft.rfft(y)) / len(y)
        want[1 : (len(y) + 1) // 2] *= 2
        np.testing.assert_allclose(sorted(got[k]), np.fft.rfftfreq(len(y)), atol=1e-12)
        np.testing.assert_allclose([got[k][f] for f in sorted(got[k])], want, atol=1e-6)
