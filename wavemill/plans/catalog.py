"""Queries over the driver's tables, each with the same query in plain SQL.

`events` serves as a family of waveforms: a curve for each event_type over event_id; `lineitem` gives complex numbers
(quantity + i discount) and a long table of contributions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import complexes as cx
from ..functions.scalars import bucket, equal, round_scaled, round_sig_figs
from ..functions.scalars import horizontal_sum as added
from ..operators import relational as R
from ..operators.waveform import Waveform

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def curves(spark, sf_dir) -> Waveform:
    """value over event_id, a curve for each event_type."""
    df = table(spark, sf_dir, "events").select("event_type", F.col("event_id").cast("double").alias("x"), "value")
    return Waveform(df, "value", ["event_type", "x"], {"x": "s", "value": "V"})


def transfer(spark, sf_dir) -> Waveform:
    """Complex curves, one for each line number, over the order: quantity turned by the discount, falling with the order."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("n"), F.col("l_orderkey").cast("double").alias("x"), cx.complex_("l_quantity", "l_discount").alias("h"))
    return Waveform(df, "h", ["n", "x"], {"x": "Hz", "h": "V"})


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


E = "(SELECT event_type, CAST(event_id AS DOUBLE) AS x, value FROM events)"
PAIRS = f"(SELECT event_type, x AS x1, value AS y1, lag(x) OVER w AS x0, lag(value) OVER w AS y0 FROM {E} WINDOW w AS (PARTITION BY event_type ORDER BY x))"
CROSS = "x0 + (100.0 - y0) / (y1 - y0) * (x1 - x0)"


@query(f"SELECT event_type, max(value) AS ymax FROM {E} GROUP BY event_type")
def wave_ymax(spark, d):
    return curves(spark, d).ymax()


@query(f"SELECT event_type, min(value) AS ymin FROM {E} GROUP BY event_type")
def wave_ymin(spark, d):
    return curves(spark, d).ymin()


@query(f"SELECT event_type, x AS xmax FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, x) AS r FROM {E}) WHERE r = 1")
def wave_xmax(spark, d):
    return curves(spark, d).xmax()


@query(f"SELECT event_type, x AS xmin FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, x) AS r FROM {E}) WHERE r = 1")
def wave_xmin(spark, d):
    return curves(spark, d).xmin()


@query(f"""SELECT event_type, round(CASE WHEN xa > xb THEN yb + (ya - yb) * (777.5 - xb) / (xa - xb) ELSE coalesce(yb, ya) END, 6) AS value FROM (
SELECT event_type, max(x) FILTER (x <= 777.5) AS xb, arg_max(value, x) FILTER (x <= 777.5) AS yb, min(x) FILTER (x >= 777.5) AS xa, arg_min(value, x) FILTER (x >= 777.5) AS ya FROM {E} GROUP BY event_type)""")
def wave_value_at(spark, d):
    return rounded(curves(spark, d).value(777.5), "value")


@query(f"SELECT event_type, round(x, 6) AS \"cross\" FROM (SELECT event_type, {CROSS} AS x, row_number() OVER (PARTITION BY event_type ORDER BY x1) AS r FROM {PAIRS} WHERE y0 < 100 AND y1 >= 100) WHERE r = 2")
def wave_cross_second_rising(spark, d):
    return rounded(curves(spark, d).cross(100.0, 2, "rising"), "cross")


@query(f"SELECT event_type, round(x, 6) AS \"cross\" FROM (SELECT event_type, {CROSS} AS x, row_number() OVER (PARTITION BY event_type ORDER BY x1 DESC) AS r FROM {PAIRS} WHERE y0 > 100 AND y1 <= 100) WHERE r = 1")
def wave_cross_last_falling(spark, d):
    return rounded(curves(spark, d).cross(100.0, -1, "falling"), "cross")


@query(f"SELECT event_type, round({CROSS}, 6) AS x, y0 < 100 AS rising FROM {PAIRS} WHERE y0 < 100 AND y1 >= 100 OR y0 > 100 AND y1 <= 100")
def wave_crossings(spark, d):
    return rounded(curves(spark, d).crossings(100.0), "x")


@query(f"SELECT event_type, x0 AS x, round((y1 - y0) / (x1 - x0), 6) AS value FROM {PAIRS} WHERE x0 IS NOT NULL")
def wave_deriv(spark, d):
    return rounded(curves(spark, d).deriv().df, "value")


@query(f"SELECT event_type, x1 AS x, round(sum(coalesce((x1 - x0) * (y1 + y0) / 2, 0)) OVER (PARTITION BY event_type ORDER BY x1), 3) AS value FROM {PAIRS}")
def wave_integ(spark, d):
    return rounded(curves(spark, d).integ().df, "value", digits=3)


@query("SELECT x1 AS x, round(sum(coalesce((x1 - x0) * (y1 + y0) / 2, 0)) OVER (ORDER BY x1), 3) AS value FROM (SELECT x AS x1, value AS y1, lag(x) OVER (ORDER BY x) AS x0, lag(value) OVER (ORDER BY x) AS y0 FROM (SELECT CAST(event_id AS DOUBLE) AS x, value FROM events))")
def wave_integ_single_curve(spark, d):
    c = curves(spark, d)
    return rounded(Waveform(c.df.select("x", "value"), "value", ["x"]).integ().df, "value", digits=3)


@query(f"SELECT event_type, round(sum((x1 - x0) * (y1 + y0) / 2), 3) AS integral FROM {PAIRS} WHERE x0 IS NOT NULL GROUP BY event_type")
def wave_integral(spark, d):
    return rounded(curves(spark, d).integral(), "integral", digits=3)


@query(f"SELECT event_type, round(avg(value), 6) AS mean FROM {E} GROUP BY event_type")
def wave_mean(spark, d):
    return rounded(curves(spark, d).mean(), "mean")


@query(f"SELECT event_type, round(sum((x1 - x0) * (y1 + y0) / 2) / sum(x1 - x0), 6) AS mean FROM {PAIRS} WHERE x0 IS NOT NULL GROUP BY event_type")
def wave_mean_weighted(spark, d):
    return rounded(curves(spark, d).mean(weighted=True), "mean")


@query(f"SELECT event_type, round(sqrt(avg(value * value)), 6) AS rms FROM {E} GROUP BY event_type")
def wave_rms(spark, d):
    return rounded(curves(spark, d).rms(), "rms")


@query(f"SELECT event_type, x, round(value - avg(value) OVER (PARTITION BY event_type), 6) AS value FROM {E}")
def wave_center(spark, d):
    c = curves(spark, d)
    return rounded((c - c.mean()).df, "value")


@query(f"SELECT x, value FROM {E} WHERE event_type = 'click' AND x BETWEEN 100 AND 900")
def wave_clip_leaf(spark, d):
    return curves(spark, d).leaf(event_type="click").clip(100, 900).df


@query(f"SELECT event_type, x, round((value * 2 + 1) / value, 6) AS y FROM {E}")
def wave_binop_aligned(spark, d):
    c = curves(spark, d)
    return ((c * 2 + 1) / c).renamed("y").df.withColumn("y", round_scaled(F.col("y"), 6))


@query(f"SELECT event_type, round(b.x - a.x, 6) AS delay FROM (SELECT event_type, min({CROSS}) AS x FROM {PAIRS} WHERE y0 < 100 AND y1 >= 100 GROUP BY 1) a JOIN (SELECT event_type, min(x0 + (50.0 - y0) / (y1 - y0) * (x1 - x0)) AS x FROM (SELECT event_type, x0, x1, y0 / 2 AS y0, y1 / 2 AS y1 FROM {PAIRS}) WHERE y0 < 50 AND y1 >= 50 GROUP BY 1) b USING (event_type)")
def wave_delay(spark, d):
    c = curves(spark, d)
    return rounded(c.delay(c / 2, 100.0, 50.0), "delay")


@query(f"""WITH p AS {PAIRS}, r AS (SELECT event_type, arg_min(value, x) * pow(10, -3.0 / 20) AS t FROM {E} GROUP BY event_type)
SELECT event_type, coalesce(round(min(x0 + (t - y0) / (y1 - y0) * (x1 - x0)) FILTER (y0 >= t AND y1 < t), 6), CAST('nan' AS DOUBLE)) AS bandwidth FROM p JOIN r USING (event_type) GROUP BY event_type""")
def wave_bandwidth_low(spark, d):
    return rounded(curves(spark, d).bandwidth(), "bandwidth")


@query(f"SELECT event_type, round(min(x0 + (1 - y0) / (y1 - y0) * (x1 - x0)), 6) AS unity_gain_frequency FROM (SELECT event_type, x0, x1, y0 / 10 AS y0, y1 / 10 AS y1 FROM {PAIRS}) WHERE y0 > 1 AND y1 <= 1 GROUP BY event_type")
def wave_unity_gain(spark, d):
    return rounded((curves(spark, d) / 10).unity_gain_frequency(), "unity_gain_frequency")


@query(f"""WITH l AS (SELECT event_type, (max(value) + min(value)) / 2 AS level FROM {E} GROUP BY event_type),
c AS (SELECT event_type, x0 + (level - y0) / (y1 - y0) * (x1 - x0) AS x FROM {PAIRS} JOIN l USING (event_type) WHERE y0 < level AND y1 >= level)
SELECT event_type, round((count(*) - 1) / (max(x) - min(x)), 6) AS frequency FROM c GROUP BY event_type HAVING count(*) > 1""")
def wave_frequency(spark, d):
    return rounded(curves(spark, d).frequency(), "frequency")


ENDS = f"(SELECT event_type, arg_min(value, x) AS a, arg_max(value, x) AS b, max(value) AS hi, min(value) AS lo, min(x) AS xa FROM {E} GROUP BY event_type)"


@query(f"SELECT event_type, round(100 * (CASE WHEN b >= a THEN hi - b ELSE b - lo END) / abs(b - a), 4) AS overshoot FROM {ENDS}")
def wave_overshoot(spark, d):
    return rounded(curves(spark, d).overshoot(), "overshoot", digits=4)


@query(f"SELECT event_type, coalesce(max(x) FILTER (abs(value - b) > 0.01 * abs(b - a)), min(x)) - min(x) AS settling_time FROM {E} JOIN {ENDS} USING (event_type) GROUP BY event_type")
def wave_settling_time(spark, d):
    return curves(spark, d).settling_time()


@query(f"""WITH p AS (SELECT p.*, a + 0.1 * (b - a) AS lo, a + 0.9 * (b - a) AS hi, b > a AS up FROM {PAIRS} p JOIN (SELECT event_type, a, b FROM {ENDS}) e USING (event_type) WHERE x0 IS NOT NULL)
SELECT event_type, round(min(x0 + (hi - y0) / (y1 - y0) * (x1 - x0)) FILTER (CASE WHEN up THEN y0 < hi AND y1 >= hi ELSE y0 > hi AND y1 <= hi END)
- min(x0 + (lo - y0) / (y1 - y0) * (x1 - x0)) FILTER (CASE WHEN up THEN y0 < lo AND y1 >= lo ELSE y0 > lo AND y1 <= lo END), 6) AS rise_time FROM p GROUP BY event_type""")
def wave_rise_time(spark, d):
    return rounded(curves(spark, d).rise_time(), "rise_time")


@query("SELECT l_linenumber AS n, CAST(l_orderkey AS DOUBLE) AS x, round(20 * log10(sqrt(l_quantity * l_quantity + l_discount * l_discount)), 6) AS h FROM lineitem")
def complex_db20(spark, d):
    return rounded(transfer(spark, d).db20().df, "h")


@query("SELECT l_linenumber AS n, CAST(l_orderkey AS DOUBLE) AS x, round(degrees(atan2(l_discount, l_quantity)), 6) AS h FROM lineitem")
def complex_phase(spark, d):
    return rounded(transfer(spark, d).phase().df, "h")


@query("SELECT l_linenumber AS n, CAST(l_orderkey AS DOUBLE) AS x, round(l_quantity * l_quantity - l_discount * l_discount, 6) AS re, round(2 * l_quantity * l_discount, 6) AS im FROM lineitem")
def complex_square(spark, d):
    w = transfer(spark, d) ** 2
    return rounded(w.df.select("n", "x", cx.re(F.col("h")).alias("re"), cx.im(F.col("h")).alias("im")), "re", "im")


@query("SELECT l_linenumber AS n, CAST(l_orderkey AS DOUBLE) AS x, round(l_quantity / (l_quantity * l_quantity + l_discount * l_discount), 6) AS re, round(-l_discount / (l_quantity * l_quantity + l_discount * l_discount), 6) AS im FROM lineitem")
def complex_reciprocal(spark, d):
    w = 1 / transfer(spark, d)
    return rounded(w.df.select("n", "x", cx.re(F.col("h")).alias("re"), cx.im(F.col("h")).alias("im")), "re", "im")


@query("SELECT l_linenumber AS n, CAST(l_orderkey AS DOUBLE) AS x, l_quantity AS re, -l_discount AS im, round(sqrt(l_quantity * l_quantity + l_discount * l_discount), 6) AS m FROM lineitem")
def complex_conjugate(spark, d):
    w = transfer(spark, d).conj()
    return rounded(w.df.select("n", "x", cx.re(F.col("h")).alias("re"), cx.im(F.col("h")).alias("im"), cx.mag(F.col("h")).alias("m")), "m")


@query("SELECT o_orderkey, signal, value FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, 'l_quantity' AS signal, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem)")
def long_unpivot(spark, d):
    return R.unpivot(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", "l_tax"), ["o_orderkey"], ["l_quantity", "l_tax"])


@query("SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 4) AS F, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 4) AS O FROM lineitem GROUP BY l_returnflag")
def wide_pivot(spark, d):
    return rounded(R.pivot(table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity", ["F", "O"], F.sum), "F", "O", digits=4)


@query("SELECT p_brand, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand ORDER BY total DESC, p_brand LIMIT 10")
def noise_top_k(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_brand").agg(F.round(F.sum("l_extendedprice"), 2).alias("total")).orderBy(F.desc("total"), "p_brand").limit(10)


@query("SELECT p_brand, round(t / sum(t) OVER (), 8) AS share FROM (SELECT p_brand, sum(l_extendedprice) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand)")
def noise_share(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sums = joined.groupBy("p_brand").agg(F.sum("l_extendedprice").alias("t"))
    return R.share_of_total(sums, "t").select("p_brand", F.round("share", 8).alias("share"))


@query("SELECT block, p_type, round(t / sum(t) OVER (PARTITION BY block), 8) AS share FROM (SELECT CAST(regexp_extract(p_brand, '#(\\d)', 1) AS INTEGER) AS block, p_type, sum(p_retailprice) AS t FROM part GROUP BY 1, 2)")
def noise_block_share(spark, d):
    sums = table(spark, d, "part").withColumn("block", F.regexp_extract("p_brand", r"#(\d)", 1).cast("int")).groupBy("block", "p_type").agg(F.sum("p_retailprice").alias("t"))
    return R.share_of_total(sums, "t", ["block"]).select("block", "p_type", F.round("share", 8).alias("share"))


@query(f"""SELECT event_type, ymax, xmax, round(c, 6) AS first_cross, ymax > 360 AS pass FROM (SELECT event_type, max(value) AS ymax FROM {E} GROUP BY 1)
JOIN (SELECT event_type, x AS xmax FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, x) AS r FROM {E}) WHERE r = 1) USING (event_type)
JOIN (SELECT event_type, min({CROSS}) AS c FROM {PAIRS} WHERE y0 < 100 AND y1 >= 100 GROUP BY 1) USING (event_type)""")
def corner_report(spark, d):
    c = curves(spark, d)
    crossing = c.cross(100.0, 1, "rising").withColumnRenamed("cross", "first_cross")
    return rounded(c.ymax().join(c.xmax(), "event_type").join(crossing, "event_type"), "first_cross").withColumn("pass", F.col("ymax") > 360)


@query(f"SELECT event_type, ymax FROM (SELECT event_type, max(value) AS ymax FROM {E} GROUP BY event_type) ORDER BY ymax DESC, event_type LIMIT 2")
def corner_worst(spark, d):
    return curves(spark, d).ymax().orderBy(F.desc("ymax"), "event_type").limit(2)


@query("SELECT event_type, floor(event_id / 250.0) * 250.0 AS t, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def time_bucket_mean(spark, d):
    return rounded(curves(spark, d).df.groupBy("event_type", bucket(F.col("x"), 250.0).alias("t")).agg(F.avg("value").alias("mean")), "mean")


@query(f"SELECT event_type, round(sum(value * cos(2 * pi() * 0.001 * x) * dx), 2) AS re, round(sum(-value * sin(2 * pi() * 0.001 * x) * dx), 2) AS im FROM (SELECT *, coalesce(x - lag(x) OVER (PARTITION BY event_type ORDER BY x), 0) AS dx FROM {E}) GROUP BY event_type")
def phasor(spark, d):
    return rounded(R.phasor(curves(spark, d).df, ["event_type"], "x", "value", 0.001), "re", "im", digits=2)


@query("SELECT r_name, p_type FROM region CROSS JOIN (SELECT DISTINCT p_type FROM part) WHERE r_name = 'ASIA' AND p_type LIKE 'E%' OR r_name = 'EUROPE' AND p_type = 'STANDARD'")
def leaf_cross_prune(spark, d):
    some = (F.col("r_name") == "ASIA") & F.col("p_type").startswith("E") | (F.col("r_name") == "EUROPE") & (F.col("p_type") == "STANDARD")
    return R.leaf_signal_pairs(table(spark, d, "region").select("r_name"), table(spark, d, "part").select("p_type").distinct(), some)


@query("SELECT custkey, n, s FROM (SELECT c_custkey AS custkey, c_acctbal AS n FROM customer) FULL JOIN (SELECT o_custkey AS custkey, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1) USING (custkey)")
def align_whole(spark, d):
    """Every customer beside the sum of their orders; either may be without the other."""
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("n"))
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("s"))
    return R.align([a, b], ["custkey"])


@query(f"SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max FROM {E} GROUP BY event_type")
def describe_runs(spark, d):
    return rounded(curves(spark, d).describe(), "mean", "std", "q25", "median", "q75")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_corners(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT (l_returnflag, l_linestatus)) AS corners, count(*) AS n FROM lineitem")
def count_distinct_struct(spark, d):
    return table(spark, d, "lineitem").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_returnflag", "l_linestatus").alias("corners"), F.count("*").alias("n"))


@query("SELECT 'customer' AS kind, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2")
def union_concat(spark, d):
    parts = [table(spark, d, t).groupBy(F.col(f"{t[0]}_nationkey").alias("nation")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(t)) for t in ("customer", "supplier")]
    return R.concat(parts).select("kind", "nation", "n")


@query("SELECT p_partkey, p_retailprice FROM part WHERE abs(p_retailprice - 900.1) <= 1e-5 * 900.1")
def tolerant_match(spark, d):
    return table(spark, d, "part").filter(equal(F.col("p_retailprice"), 900.1)).select("p_partkey", "p_retailprice")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def nested_field(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def semi_join(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 100000")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_totals(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("q"))


@query("SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def set_intersect(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")).intersect(table(spark, d, "customer").select("c_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).exceptAll(table(spark, d, "orders").select("o_custkey")).distinct()


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_by_key(spark, d):
    return R.first_by(table(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderkey"), ["o_custkey"], ["o_totalprice", "o_orderkey"])


@query("SELECT l_orderkey, array_to_string(list(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) ORDER BY l_linenumber, l_quantity), ',') AS curve FROM lineitem GROUP BY l_orderkey")
def ordered_lists(spark, d):
    lists = R.ordered_list(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_quantity")
    return lists.select("l_orderkey", F.array_join(F.transform("curve", lambda v: v["y"].cast("int").cast("string")), ",").alias("curve"))


@query("SELECT p_partkey, substr(p_brand, 7) AS number, p_name LIKE 'small%' AS small, regexp_matches(p_name, 'r(ing|od)') AS round_ish, CASE WHEN p_size > 30 THEN 'large' WHEN p_size > 10 THEN 'middle' ELSE 'small' END AS size FROM part")
def string_functions(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.substring("p_brand", 7, 100).alias("number"), F.col("p_name").startswith("small").alias("small"), F.col("p_name").rlike("r(ing|od)").alias("round_ish"), F.when(F.col("p_size") > 30, "large").when(F.col("p_size") > 10, "middle").otherwise("small").alias("size"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice = 0 THEN 0.0 ELSE round(round(l_extendedprice / pow(10, floor(log10(l_extendedprice)) - 2)) * pow(10, floor(log10(l_extendedprice)) - 2), 4) END AS price FROM lineitem")
def significant_figures(spark, d):
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", round_sig_figs(F.col("l_extendedprice"), 3).alias("price")), "price", digits=4)


@query("SELECT event_type, x, round(value - prev, 6) AS diff, nxt FROM (SELECT event_type, CAST(event_id AS DOUBLE) AS x, value, lag(value) OVER w AS prev, lead(value) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id))")
def window_diff_shift(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("event_type").orderBy("x")
    return rounded(curves(spark, d).df.select("event_type", "x", (F.col("value") - F.lag("value").over(w)).alias("diff"), F.lead("value").over(w).alias("nxt")), "diff")


@query(None)
def wave_dft(spark, d):
    """Spectrum of each event_type's whole curve, on an even axis: the samples' places."""
    from pyspark.sql.window import Window

    e = table(spark, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")))
    return rounded(Waveform(e.select("event_type", (F.col("n") * 1.0).alias("t"), "value"), "value", ["event_type", "t"], {"t": "s"}).dft().df, "value")


def _urgent(spark, d) -> DataFrame:
    return table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("k"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_join_rows(spark, d):
    return table(spark, d, "customer").join(_urgent(spark, d), F.col("c_custkey") == F.col("k"), "left_anti").select("c_custkey")


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def set_except_rows(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(_urgent(spark, d))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, CAST(grouping(l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_totals(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("q"), F.grouping("l_linestatus").cast("long").alias("level"))


@query("SELECT l_returnflag, l_shipmode, count(*) AS n FROM (SELECT l_returnflag, CAST(l_linenumber AS VARCHAR) AS l_shipmode FROM lineitem) GROUP BY GROUPING SETS ((l_returnflag), (l_shipmode))")
def grouping_sets(spark, d):
    lines = table(spark, d, "lineitem").select("l_returnflag", F.col("l_linenumber").cast("string").alias("l_shipmode"))
    both = [F.col("l_returnflag"), F.col("l_shipmode")]
    return lines.groupingSets([both[:1], both[1:]], *both).agg(F.count("*").alias("n"))


@query("SELECT n_name, count(*) AS larger FROM nation JOIN region ON n_regionkey < r_regionkey GROUP BY n_name")
def theta_join(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(F.broadcast(r), F.col("n_regionkey") < F.col("r_regionkey")).groupBy("n_name").agg(F.count("*").alias("larger"))


@query("""SELECT p_partkey, c.low FROM part JOIN (SELECT CAST(250.0 * i AS DOUBLE) AS low, CAST(250.0 * i + 400.0 AS DOUBLE) AS high FROM range(0, 12) t(i)) c ON p_retailprice >= c.low AND p_retailprice < c.high""")
def range_join(spark, d):
    """Prices and the overlapping bands that hold them."""
    bands = spark.range(12).select((F.col("id") * 250.0).alias("low"), (F.col("id") * 250.0 + 400.0).alias("high"))
    return R.within(table(spark, d, "part").select("p_partkey", "p_retailprice"), bands, "p_retailprice", "low", "high", 100.0).select("p_partkey", "low")


@query("SELECT s_suppkey, round(s_acctbal, 1) AS s_acctbal FROM supplier")
def column_selectors(spark, d):
    """The floating-point columns, rounded, beside the key."""
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", *[F.round(c, 1).alias(c) for c in R.of_type(s, "double", "float")])


@query("SELECT c_custkey, round(c_acctbal + c_nationkey * 2.0, 4) AS total FROM customer")
def horizontal_sum(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.round(added([F.col("c_acctbal"), F.col("c_nationkey") * 2.0]), 4).alias("total"))


@query("SELECT l_orderkey, CAST(list(l_quantity ORDER BY l_linenumber, l_quantity)[1] AS DOUBLE) AS first, CAST(list(l_quantity ORDER BY l_linenumber, l_quantity)[-1] AS DOUBLE) AS last, CAST(list(l_quantity ORDER BY l_linenumber, l_quantity)[3] AS DOUBLE) AS third FROM lineitem GROUP BY l_orderkey")
def list_items(spark, d):
    lists = R.ordered_list(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_quantity")
    y = F.transform("curve", lambda v: v["y"])
    return lists.select("l_orderkey", F.get(y, F.lit(0)).alias("first"), F.element_at(y, -1).alias("last"), F.get(y, F.lit(2)).alias("third"))


@query(f"""WITH p AS {PAIRS}, r AS (SELECT event_type, arg_max(value, x) * pow(10, -3.0 / 20) AS t FROM {E} GROUP BY event_type)
SELECT event_type, coalesce(round(max(x0 + (t - y0) / (y1 - y0) * (x1 - x0)) FILTER (y0 < t AND y1 >= t), 6), CAST('nan' AS DOUBLE)) AS bandwidth FROM p JOIN r USING (event_type) GROUP BY event_type""")
def wave_bandwidth_high(spark, d):
    return rounded(curves(spark, d).bandwidth(type="high"), "bandwidth")


@query(f"""WITH p AS {PAIRS}, r AS (SELECT event_type, max(value) * pow(10, -3.0 / 20) AS t, arg_max(x, (value, -x)) AS peak FROM {E} GROUP BY event_type)
SELECT event_type, coalesce(round(min(x0 + (t - y0) / (y1 - y0) * (x1 - x0)) FILTER (y0 >= t AND y1 < t AND x1 > peak) - max(x0 + (t - y0) / (y1 - y0) * (x1 - x0)) FILTER (y0 < t AND y1 >= t AND x0 < peak), 6), CAST('nan' AS DOUBLE)) AS bandwidth FROM p JOIN r USING (event_type) GROUP BY event_type""")
def wave_bandwidth_band(spark, d):
    return rounded(curves(spark, d).bandwidth(type="band"), "bandwidth")


@query(f"""WITH p AS (SELECT p.*, a + 0.1 * (b - a) AS lo, a + 0.9 * (b - a) AS hi, b > a AS up FROM {PAIRS} p JOIN {ENDS} e USING (event_type) WHERE x0 IS NOT NULL)
SELECT event_type, round((max(hi - lo)) / nullif(min(x0 + (hi - y0) / (y1 - y0) * (x1 - x0)) FILTER (CASE WHEN up THEN y0 < hi AND y1 >= hi ELSE y0 > hi AND y1 <= hi END)
- min(x0 + (lo - y0) / (y1 - y0) * (x1 - x0)) FILTER (CASE WHEN up THEN y0 < lo AND y1 >= lo ELSE y0 > lo AND y1 <= lo END), 0), 6) AS slew_rate FROM p GROUP BY event_type""")
def wave_slew_rate(spark, d):
    return rounded(curves(spark, d).slew_rate(), "slew_rate")


@query(f"""SELECT a.event_type, round(500.0 + (a.v - b.v) / 2, 6) AS iip3 FROM (SELECT event_type, value AS v FROM {E} WHERE x = (SELECT 500.0)) a JOIN (SELECT event_type, value * 3 AS v FROM {E} WHERE x = 500.0) b USING (event_type)""")
def wave_iip3_at_sample(spark, d):
    """Of the curve that has a sample at 500; the third-order product is three times the curve."""
    c = curves(spark, d)
    has = c.df.filter("x = 500").select("event_type")
    one = Waveform(c.df.join(F.broadcast(has), "event_type", "left_semi"), "value", c.index)
    return rounded(one.iip3(one * 3, 500.0), "iip3")
