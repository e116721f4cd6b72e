"""Waveforms combined with waveforms: repeated samples, null parameters, zeros and ties of the rounding."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from wavemill.operators.waveform import Waveform
from wavemill.plans.catalog import ORACLES, QUERIES

ODD = {
    "repeated": [("a", 1, 4.0), ("a", 1, 4.0), ("a", 1, 8.0), ("a", 2, 3.0), ("b", 1, 5.0)],
    "beyond 2^53": [("a", 2**53, 4.0), ("a", 2**53 + 1, 5.0), ("b", 2**53, 6.0)],
    "null keys": [(None, 1, 4.0), (None, 2, 3.0), ("a", None, 2.0), ("a", None, 7.0), (None, None, 5.0), ("a", 1, 9.0)],
    "zeros": [("a", 1, 0.0), ("a", 2, -0.0), ("a", 3, -0.5), ("b", 1, 1e-320)],
    "no number": [("a", 1, None), ("a", 2, math.nan), ("a", 3, math.inf), ("a", 4, -math.inf), ("a", 5, 1.7e308)],
    "ties": [("a", i, v) for i, v in enumerate((5.12, 25.6, 128.0, 640.0, 3200.0, 16000.0, -16000.0, 80000.0))],
    "no rows": [],
}


def told(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("kind", ODD)
def test_odd_events_as_in_sql(spark, tmp_path, kind):
    spark.createDataFrame(ODD[kind], "event_type string, event_id bigint, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"select event_type, x, y from ({ORACLES['wave_binop_aligned']})").fetchall()
    got = QUERIES["wave_binop_aligned"](spark, str(tmp_path)).select("event_type", "x", "y").collect()
    assert Counter(tuple(map(told, r)) for r in got) == Counter(tuple(map(told, r)) for r in want)


def test_one_root_needs_no_join(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 4.0), (None, 1.0, 8.0)], "g string, x double, y double")
    w = Waveform(df, "y", ["g", "x"])
    both = (w * 2 + 1) / w - (-w).renamed("z") * (w + w)
    assert sorted(r[both.yname] for r in both.df.collect()) == [(2 * y + 1) / y + y * 2 * y for y in (2.0, 4.0, 8.0)]
    plan = both.df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    np.testing.assert_array_equal((both - both).leaf(g="a").to_numpy(), [0.0, 0.0])


def test_other_roots_pair_by_index(spark):
    schema = "g string, x double, y double"
    a = Waveform(spark.createDataFrame([(None, 1.0, 2.0), ("a", 1.0, None), ("a", math.nan, 3.0)], schema), "y", ["g", "x"])
    b = Waveform(spark.createDataFrame([("a", math.nan, 4.0), (None, 1.0, 5.0), ("a", 1.0, 6.0)], schema), "y", ["g", "x"])
    assert Counter(r[2] for r in (a * b).df.collect()) == Counter([10.0, None, 12.0])
    c = a.filter(a._y.isNotNull())
    for other in (c, Waveform(a.df.union(a.df), "y", ["g", "x"])):
        with pytest.raises(ValueError, match="different axes"):
            b - other
    twice = Waveform(b.df.union(b.df), "y", ["g", "x"])
    with pytest.raises(ValueError, match="repeat"):
        twice - Waveform(a.df.union(a.df), "y", ["g", "x"])
    assert (twice - twice).df.count() == 6
