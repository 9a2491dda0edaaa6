"""Queries of survey cuts, dust and dispersion, object names, levels around an event and ranking functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.functions import photometry, sphere
from skyloom.operators import match, merge, tabular, timeseries
from skyloom.queries.registry import query, r6, sky, sql_place, sql_separation, table
from skyloom.queries.series import _PL, _plates

# Nearby galaxies as right ascension, declination and radius in degrees.
NEARBY = [(10.685, 41.269, 3.0), (23.462, 30.660, 1.5), (80.894, -69.756, 10.0), (13.187, -72.829, 5.0)]

_RA, _DEC = sql_place("c_custkey")
_SKY = f"SELECT c_custkey, {_RA} AS ra, {_DEC} AS dec FROM customer"
_LATITUDE = f"(90 - {sql_separation('ra', 'dec', '192.85948::DOUBLE', '27.12825::DOUBLE')})"


@query("outside_cones", f"SELECT c_custkey FROM ({_SKY}) WHERE " + " AND ".join(f"NOT ({sql_separation('ra', 'dec', f'{a}::DOUBLE', f'({d})::DOUBLE')} <= {r})" for a, d, r in NEARBY))
def outside_cones(spark, sf):
    return match.outside_cones(sky(spark, sf, "customer", "c_custkey"), NEARBY).select("c_custkey")


@query("extinction", f"SELECT c_custkey, round(least(greatest(0.05::DOUBLE / sin(radians(least(greatest(abs({_LATITUDE}), 1.0), 85.0))), 0.02), 5.0), 6) AS av FROM ({_SKY})")
def extinction(spark, sf):
    c = sky(spark, sf, "customer", "c_custkey")
    return c.select("c_custkey", r6(photometry.extinction(sphere.latitude_from_pole(F.col("ra"), F.col("dec")))).alias("av"))


@query("separation_arccos", f"SELECT c_custkey, round(degrees(acos(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, sin(radians(dec)) * sin(radians(-30.0::DOUBLE)) + cos(radians(dec)) * cos(radians(-30.0::DOUBLE)) * cos(radians(120.0::DOUBLE - ra)))))), 6) AS separation FROM ({_SKY})")
def separation_arccos(spark, sf):
    c = sky(spark, sf, "customer", "c_custkey")
    return c.select("c_custkey", r6(sphere.separation_arccos(F.col("ra"), F.col("dec"), F.lit(120.0), F.lit(-30.0))).alias("separation"))


@query("dispersion_estimates", """
SELECT p_partkey, round(greatest(pow(10.0::DOUBLE, -3.86 + 0.154 * log10(greatest(dm, 1.0)) + 1.07 * pow(log10(greatest(dm, 1.0)), 2)) / 1000, 1e-4), 6) AS scattering, round(greatest(dm - 60, 0) / 950, 6) AS redshift
FROM (SELECT p_partkey, (p_retailprice::DOUBLE - 900) * 20 AS dm FROM part)
""")
def dispersion_estimates(spark, sf):
    dm = (F.col("p_retailprice").cast("double") - 900) * 20
    return table(spark, sf, "part").select("p_partkey", r6(photometry.scattering_ms(dm)).alias("scattering"), r6(photometry.dispersion_redshift(dm)).alias("redshift"))


@query("proper_motion_cut", "SELECT event_id FROM events WHERE value > 0 AND value / 10 + 8 + 5 * log10((value + user_id % 90) / 1000) + 5 > 15")
def proper_motion_cut(spark, sf):
    h = photometry.reduced_proper_motion(F.col("value") / 10 + 8, F.col("value") + F.col("user_id") % 90)
    return table(spark, sf, "events").where((F.col("value") > 0) & (h > 15)).select("event_id")


@query("object_years", """
WITH a AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Gaia' || lpad((o_custkey % 30)::VARCHAR, 2, '0') || 'abc' WHEN 1 THEN 'Nova Sgr ' || (1840 + o_custkey % 200) WHEN 2 THEN 'ASASSN-' || lpad((o_custkey % 20)::VARCHAR, 2, '0') || 'x' ELSE 'V' || o_custkey || ' Cyg' END AS name FROM orders)
SELECT o_orderkey, coalesce(2000.5 + try_cast(nullif(regexp_extract(name, '^(?:Gaia|ZTF|PGIR|ASASSN-|ATLAS)([0-9]{2})', 1), '') AS DOUBLE), 0.5 + try_cast(nullif(regexp_extract(name, '(18[5-9][0-9]|19[0-9]{2}|20[0-2][0-9])', 1), '') AS DOUBLE)) AS year FROM a
""")
def object_years(spark, sf):
    """Year of discovery in a name: two digits after a survey's name, else a year from 1850 to 2029."""
    kind, k = F.col("o_orderkey") % 4, F.col("o_custkey")
    two = lambda n: F.lpad((k % n).cast("string"), 2, "0")
    name = F.when(kind == 0, F.concat(F.lit("Gaia"), two(30), F.lit("abc"))).when(kind == 1, F.concat(F.lit("Nova Sgr "), (1840 + k % 200).cast("string"))).when(kind == 2, F.concat(F.lit("ASASSN-"), two(20), F.lit("x"))).otherwise(F.concat(F.lit("V"), k.cast("string"), F.lit(" Cyg")))
    own = table(spark, sf, "orders").select("o_orderkey", name.alias("name"))
    return own.select("o_orderkey", tabular.year_in_name(F.col("name")).alias("year"))


@query("leverage", """
WITH a AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN '~' || o_custkey || 'k' WHEN 1 THEN '~1.5M' WHEN 2 THEN 'many' ELSE '1,' || lpad((o_custkey % 1000)::VARCHAR, 3, '0') END AS rows, split_part(o_orderpriority, '-', 1) AS level FROM orders),
b AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN o_custkey * 1e3::DOUBLE WHEN 1 THEN 1.5e6::DOUBLE WHEN 2 THEN 0 ELSE 1000 + o_custkey % 1000 END AS n, CASE level WHEN '2' THEN 3.0 WHEN '3' THEN 2.0 ELSE 1.0 END AS w FROM a)
SELECT o_orderkey, round(CASE WHEN n > 0 THEN w / greatest(log10(n), 1.0) ELSE w END, 6) AS score FROM b
""")
def leverage(spark, sf):
    kind, k = F.col("o_orderkey") % 4, F.col("o_custkey")
    rows = F.when(kind == 0, F.concat(F.lit("~"), k.cast("string"), F.lit("k"))).when(kind == 1, "~1.5M").when(kind == 2, "many").otherwise(F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0")))
    urgent = F.substring("o_orderpriority", 1, 1)
    level = F.when(urgent == "2", "High").when(urgent == "3", " medium").otherwise("low")
    return table(spark, sf, "orders").select("o_orderkey", r6(tabular.leverage(level, rows)).alias("score"))


@query("quiescent", f"WITH p AS ({_PL}) SELECT user_id, round(quantile_disc(CASE WHEN det THEN mag ELSE greatest(mag, 4.0) END, 0.5), 6) AS level FROM p WHERE abs(t - (1 + user_id % 5)) <= 2.5 GROUP BY 1")
def quiescent(spark, sf):
    p = _plates(spark, sf).withColumn("middle", 1 + F.col("user_id") % 5)
    return timeseries.quiescent(p, ["user_id"], "middle", 2.5, 4.0).select("user_id", r6(F.col("level")).alias("level"))


_BEFORE, _AFTER = "t BETWEEN 3 - 900 / 365.25::DOUBLE AND 3 - 5 / 365.25::DOUBLE", "t BETWEEN 4 AND 4 + 900 / 365.25::DOUBLE"


@query("level_step", f"""
WITH p AS ({_PL}) SELECT user_id, CASE WHEN count(*) FILTER ({_BEFORE}) >= 3 AND count(*) FILTER ({_AFTER}) >= 3 THEN round(quantile_cont(mag, 0.5) FILTER ({_AFTER}) - quantile_cont(mag, 0.5) FILTER ({_BEFORE}), 6) END AS step FROM p GROUP BY 1
""")
def level_step(spark, sf):
    p = _plates(spark, sf).withColumn("begin", F.lit(3.0)).withColumn("end", F.lit(4.0))
    return timeseries.level_step(p, ["user_id"], "begin", "end", 900.0).select("user_id", r6(F.col("step")).alias("step"))


@query("running_median", "SELECT event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING), 6) AS running FROM events")
def running_median(spark, sf):
    return timeseries.running_median(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", r6(F.col("running")).alias("running"))


@query("grid_quantiles", """
WITH g AS (SELECT o_custkey % 40 AS k, o_orderkey % 101 AS x, count(*) AS d FROM orders GROUP BY 1, 2), c AS (SELECT *, sum(d) OVER (PARTITION BY k ORDER BY x) AS c, sum(d) OVER (PARTITION BY k) AS s FROM g)
SELECT k, min(x) FILTER (c >= 0.5::DOUBLE * s) AS q50, min(x) FILTER (c >= 0.95::DOUBLE * s) AS q95 FROM c GROUP BY 1
""")
def grid_quantiles(spark, sf):
    g = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 40).alias("k"), (F.col("o_orderkey") % 101).alias("x")).agg(F.count(F.lit(1)).alias("d"))
    return timeseries.grid_quantiles(g, ["k"], "x", "d", [0.5, 0.95])


@query("ranking_functions", """
SELECT o_orderkey, rank() OVER a AS rank, dense_rank() OVER a AS dense, ntile(4) OVER b AS quarter, lead(o_orderkey) OVER b AS next, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
FROM orders WINDOW a AS (PARTITION BY o_custkey ORDER BY o_orderstatus), b AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)
""")
def ranking_functions(spark, sf):
    a, b = W.partitionBy("o_custkey").orderBy("o_orderstatus"), W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    whole = b.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return table(spark, sf, "orders").select("o_orderkey", F.rank().over(a).cast("long").alias("rank"), F.dense_rank().over(a).cast("long").alias("dense"), F.ntile(4).over(b).cast("long").alias("quarter"), F.lead("o_orderkey").over(b).alias("next"), F.nth_value("o_orderkey", 2).over(whole).alias("second"))


@query("merge_duplicates", f"""
WITH a AS (SELECT c_custkey AS k FROM customer), s AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey IN (SELECT k FROM a)), p AS (SELECT p_partkey AS k FROM part WHERE p_partkey IN (SELECT k FROM a)),
r AS (SELECT k, 3 * k AS id, 0 AS pri, 0 AS step, 'Atlas' AS src, 'nova' AS cls FROM a UNION ALL SELECT k, 3 * k + 1, CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END, 1, 'Index', CASE WHEN k % 3 = 0 THEN 'symbiotic' ELSE 'nova' END FROM s
  UNION ALL SELECT k, 3 * k + 2, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END, 2, 'Plates', CASE WHEN k % 5 = 0 THEN 'rn' ELSE 'nova' END FROM p),
g AS (SELECT k, max(id) FILTER (step = 0) AS i0, max(id) FILTER (step = 1) AS i1, max(id) FILTER (step = 2) AS i2, any_value(cls) FILTER (step = 1) AS c1, any_value(cls) FILTER (step = 2) AS c2 FROM r GROUP BY k)
SELECT i0 AS id, CASE WHEN c1 = 'symbiotic' THEN 'nova+symbiotic' ELSE 'nova' END AS cls, CASE WHEN i1 IS NULL THEN 'Atlas' ELSE 'Atlas|Index' END AS src, CASE WHEN i1 IS NULL THEN 1 ELSE 2 END::BIGINT AS n_merged FROM g
UNION ALL SELECT i2, c2, 'Plates', 1 FROM g WHERE i2 IS NOT NULL
""")
def merged_duplicates(spark, sf):
    """The first source takes the second, 3 arcsec away; the third, 6 arcsec from the first, is kept whatever its priority."""
    a = sky(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("k"), "ra", "dec")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")).join(a, "k")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k")).join(a, "k")
    even = F.col("k") % 2 == 0
    north = lambda sec: F.col("dec") + F.when(F.col("dec") > 0, -sec).otherwise(sec) / 3600.0
    rows = a.select((3 * F.col("k")).alias("id"), "ra", "dec", F.lit("Atlas").alias("src"), F.lit("nova").alias("cls"), F.lit(0).alias("pri"))
    rows = rows.unionByName(s.select((3 * F.col("k") + 1).alias("id"), "ra", north(3).alias("dec"), F.lit("Index").alias("src"), F.when(F.col("k") % 3 == 0, "symbiotic").otherwise("nova").alias("cls"), F.when(even, 1).otherwise(2).alias("pri")))
    rows = rows.unionByName(p.select((3 * F.col("k") + 2).alias("id"), "ra", north(6).alias("dec"), F.lit("Plates").alias("src"), F.when(F.col("k") % 5 == 0, "rn").otherwise("nova").alias("cls"), F.when(even, 2).otherwise(1).alias("pri")))
    return merge.merge_duplicates(rows, 5 / 3600, F.col("pri")).select("id", "cls", "src", "n_merged")
