"""Queries over tables: the filter language, statistics, set and string operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import times
from skyloom.functions.expr import compile_filter, compile_value
from skyloom.operators import calibration, tabular
from skyloom.queries.registry import micros, query, r6, table


@query("table_filter", "SELECT event_id, user_id, event_type, value FROM events WHERE value > 50 AND event_type <> 'error'")
def table_filter(spark, sf):
    return tabular.filter_rows(table(spark, sf, "events"), "(value > 50) & (event_type != 'error')").select("event_id", "user_id", "event_type", "value")


@query("table_columns", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def table_columns(spark, sf):
    return tabular.keep_columns(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity")


@query("table_stats", """
SELECT 'value' AS "column", count(value) AS n, count(*) - count(value) AS missing, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd,
  min(value) AS min, round(quantile_cont(value, 0.5), 6) AS median, max(value) AS max FROM events
UNION ALL SELECT 'user_id', count(user_id), count(*) - count(user_id), round(avg(user_id), 6), round(stddev_samp(user_id), 6), min(user_id)::DOUBLE, round(quantile_cont(user_id::DOUBLE, 0.5), 6), max(user_id)::DOUBLE FROM events
""")
def table_stats(spark, sf):
    s = tabular.statistics(table(spark, sf, "events"), ["value", "user_id", "event_type"])
    return s.select("column", "n", "missing", r6(F.col("mean")).alias("mean"), r6(F.col("sd")).alias("sd"), "min", r6(F.col("median")).alias("median"), "max")


def _holes(spark, sf):
    """events with NaN in every seventh value and NULL in every eleventh."""
    v = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value"))
    return table(spark, sf, "events").withColumn("v", v)


_HOLES = "SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN 'null' WHEN event_id % 7 = 0 THEN 'nan' ELSE 'ok' END AS k, value AS v FROM events"


@query("filter_nan_guard", f"SELECT event_id, NOT (k = 'ok' AND v > 50) AS below FROM ({_HOLES}) WHERE k <> 'null'")
def filter_nan_guard(spark, sf):
    df = _holes(spark, sf)
    return df.where(compile_filter(df, "(v > 50) | ~(v > 50)")).select("event_id", compile_value(df, "~(v > 50)").alias("below"))


@query("filter_not_equal_nan", f"SELECT event_id FROM ({_HOLES}) WHERE k = 'nan'")
def filter_not_equal_nan(spark, sf):
    return tabular.filter_rows(_holes(spark, sf), "v != v").select("event_id")


@query("stats_with_holes", f"""SELECT 'v' AS "column", count(*) FILTER (k = 'ok') AS n, count(*) FILTER (k <> 'ok') AS missing, round(avg(v) FILTER (k = 'ok'), 6) AS mean FROM ({_HOLES})""")
def stats_with_holes(spark, sf):
    return tabular.statistics(_holes(spark, sf), ["v"]).select("column", "n", "missing", r6(F.col("mean")).alias("mean"))


@query("filter_arithmetic", """
SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit, l_linenumber - 3 - floor((l_linenumber - 3) / 2.0) * 2 AS odd,
  floor((l_linenumber - 4) / 3.0) AS third, round(sqrt(l_discount), 6) AS root, CASE WHEN l_tax > 0 THEN round(log10(l_tax), 6) ELSE -1e308 END AS lg
FROM lineitem WHERE l_quantity > 0 AND least(l_discount, l_tax) >= 0.02
""")
def filter_arithmetic(spark, sf):
    df = tabular.filter_rows(table(spark, sf, "lineitem"), "minimum(l_discount, l_tax) >= 0.02")
    lg = compile_value(df, "log10(l_tax)")
    return df.select(
        "l_orderkey", "l_linenumber", compile_value(df, "l_extendedprice / l_quantity").alias("unit"), compile_value(df, "(l_linenumber - 3) % 2").alias("odd"),
        compile_value(df, "(l_linenumber - 4) // 3").alias("third"), r6(compile_value(df, "sqrt(l_discount)")).alias("root"),
        F.when(lg == -float("inf"), -1e308).otherwise(r6(lg)).alias("lg"),
    )


@query("in_list_any_case", "SELECT event_id, event_type FROM events WHERE lower(event_type) IN ('view', 'click')")
def in_list(spark, sf):
    return tabular.in_list_any_case(table(spark, sf, "events"), event_type=["View", "CLICK"], absent=["x"]).select("event_id", "event_type")


@query("latest_per_key", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf):
    return tabular.latest_per_key(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts").drop("ts").select("user_id", "event_id", "event_type")


@query("topk_per_group", "SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3")
def topk_per_group(spark, sf):
    from pyspark.sql import Window as W

    order = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf, "documents").select("source", "doc_id", "n_chars").withColumn("k", F.row_number().over(order)).where("k <= 3").drop("k")


@query("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("quantile_higher", "SELECT l_returnflag, min(q) AS quantile, count(*) AS n FROM (SELECT l_returnflag, l_quantity, CASE WHEN row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 = ceil(0.9 * (count(*) OVER (PARTITION BY l_returnflag) - 1)) THEN l_quantity END AS q FROM lineitem) GROUP BY l_returnflag")
def quantile_higher(spark, sf):
    return calibration.higher_quantile(table(spark, sf, "lineitem"), "l_quantity", 0.9, ["l_returnflag"])


@query("rank_correlation", """
WITH r AS (SELECT avg(k1) OVER (PARTITION BY l_quantity) AS a, avg(k2) OVER (PARTITION BY l_extendedprice) AS b FROM
 (SELECT l_quantity, l_extendedprice, row_number() OVER (ORDER BY l_quantity) AS k1, row_number() OVER (ORDER BY l_extendedprice) AS k2 FROM lineitem))
SELECT round(corr(a, b), 6) AS rho FROM r
""")
def rank_correlation(spark, sf):
    return calibration.rank_correlation(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select(r6(F.col("rho")).alias("rho"))


@query("uniform_mass_bins", """
WITH e AS (SELECT unnest(list_distinct([quantile_cont(l_extendedprice, 0.25), quantile_cont(l_extendedprice, 0.5), quantile_cont(l_extendedprice, 0.75)])) AS q FROM lineitem)
SELECT (SELECT count(*) FROM e WHERE e.q < l.l_extendedprice) AS bin, count(*) AS n, round(avg(l_extendedprice), 4) AS mean FROM lineitem l GROUP BY 1
""")
def uniform_mass_bins(spark, sf):
    df = table(spark, sf, "lineitem")
    edges = calibration.uniform_mass_edges(df, "l_extendedprice", 4)[1:-1]
    b = sum((F.col("l_extendedprice") > e).cast("long") for e in edges)
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("l_extendedprice"), 4).alias("mean"))


@query("slope_fit", """
WITH h AS (SELECT floor((l_extendedprice - 1000) / 5000) AS b, count(*) AS n FROM lineitem WHERE l_extendedprice >= 1000 AND l_extendedprice < 71000 GROUP BY 1),
p AS (SELECT 1000 + (b + 0.5) * 5000 AS x, log10(n) AS y, n AS w FROM h)
SELECT round((sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)) * 1e6, 4) AS slope_e6 FROM p
""")
def slope_fit(spark, sf):
    """Slope of the log histogram, weighted by counts: fourteen bins."""
    x = F.col("l_extendedprice")
    h = table(spark, sf, "lineitem").where((x >= 1000) & (x < 71000)).groupBy(F.floor((x - 1000) / 5000).alias("b")).agg(F.count(F.lit(1)).alias("w"))
    p = h.select((1000 + (F.col("b") + 0.5) * 5000).alias("x"), F.log10("w").alias("y"), "w")
    s = lambda e: F.sum(F.expr(e))
    return p.agg(r6((s("w") * s("w*x*y") - s("w*x") * s("w*y")) / (s("w") * s("w*x*x") - s("w*x") * s("w*x")) * 1e6, 4).alias("slope_e6"))


@query("topic_year_counts", """
SELECT o_orderpriority AS topic, count(*) FILTER (year(o_orderdate) = 1995) AS "1995", count(*) FILTER (year(o_orderdate) = 1996) AS "1996",
 round(CASE WHEN count(*) FILTER (year(o_orderdate) = 1995) > 0 THEN (count(*) FILTER (year(o_orderdate) = 1996) - count(*) FILTER (year(o_orderdate) = 1995)) * 100.0 / count(*) FILTER (year(o_orderdate) = 1995) END, 6) AS trend_percent
FROM orders GROUP BY 1
""")
def topic_year_counts(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("topic"), F.year("o_orderdate").alias("year"))
    return tabular.topic_year_counts(df, "topic", "year", [1995, 1996]).withColumn("trend_percent", r6(F.col("trend_percent")))


@query("append_new", "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def append_new(spark, sf):
    old = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return tabular.append_new(old, table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).distinct(), "k")


@query("distinct_union", "SELECT user_id FROM events WHERE event_type = 'error' UNION SELECT user_id FROM events WHERE value > 90")
def distinct_union(spark, sf):
    e = table(spark, sf, "events")
    return e.where("event_type = 'error'").select("user_id").union(e.where("value > 90").select("user_id")).distinct()


@query("nights_intersect", "SELECT CAST(ts AS DATE) AS d FROM events WHERE event_type = 'view' INTERSECT SELECT CAST(ts AS DATE) FROM events WHERE event_type = 'error'")
def nights_intersect(spark, sf):
    e = table(spark, sf, "events")
    return e.where("event_type = 'view'").select(F.to_date("ts").alias("d")).intersect(e.where("event_type = 'error'").select(F.to_date("ts").alias("d")))


@query("slugs", "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'list') AS slug FROM part")
def slugs(spark, sf):
    s = F.btrim(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), F.lit("-"))
    return table(spark, sf, "part").select("p_partkey", F.when(s == "", "list").otherwise(s).alias("slug"))


@query("json_paths", "SELECT event_id, json_extract_string(props, '$.' || (json_keys(props))[1]) AS first_value FROM events")
def json_paths(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.expr("get_json_object(props, concat('$.', get(json_object_keys(props), 0)))").alias("first_value"))


@query("time_scales", """
SELECT event_id, round(epoch_us(ts) / 1e6 / 86400 + 2440587.5, 6) AS jd, round(2000 + (epoch_us(ts) / 1e6 / 86400 + 2440587.5 - 2451545.0) / 365.25, 8) AS year,
 floor(epoch_us(ts) / 1e6 / 86400 + 2440587.5)::BIGINT AS night FROM events
""")
def time_scales(spark, sf):
    jd = micros() / 1e6 / 86400 + times.UNIX_ZERO_JD
    return table(spark, sf, "events").select("event_id", r6(jd).alias("jd"), r6(times.jd_to_year(jd), 8).alias("year"), times.night(jd).alias("night"))


@query("orbital_phase", "SELECT o_orderkey, round((o_totalprice - 100.0) / 227.5687 - floor((o_totalprice - 100.0) / 227.5687), 6) AS phase FROM orders")
def orbital_phase(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", r6(times.phase(F.col("o_totalprice"), 100.0, 227.5687)).alias("phase"))


@query("rollup_actions", "SELECT event_type, user_id % 3 AS survey, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id % 3)")
def rollup_actions(spark, sf):
    return table(spark, sf, "events").withColumn("survey", F.col("user_id") % 3).rollup("event_type", "survey").agg(F.count(F.lit(1)).alias("n"))
