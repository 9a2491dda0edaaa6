"""Queries that match rows in space and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.operators import match
from skyloom.queries.registry import micros, query, r6, sky, sql_place, sql_separation, table

CL, CB = sql_place("c_custkey")
SL, SB = sql_place("(s_suppkey * 7 + 3)")
_PAIRS = f"SELECT c_custkey, s_suppkey, {sql_separation('cl', 'cb', 'sl', 'sb')} AS sep FROM (SELECT c_custkey, {CL} AS cl, {CB} AS cb FROM customer), (SELECT s_suppkey, {SL} AS sl, {SB} AS sb FROM supplier)"


def _sides(spark, sf):
    a = sky(spark, sf, "customer", "c_custkey").select("c_custkey", "ra", "dec")
    b = table(spark, sf, "supplier").withColumn("k", F.col("s_suppkey") * 7 + 3)
    from skyloom.queries.registry import place

    lon, lat = place("k")
    return a, b.select("s_suppkey", lon.alias("ra2"), lat.alias("dec2"))


@query("cone_search", f"SELECT c_custkey, round(sep, 6) AS separation FROM (SELECT c_custkey, {sql_separation(CL, CB, '266.4', '-29.0')} AS sep FROM customer) WHERE sep <= 20")
def cone_search(spark, sf):
    return match.cone_search(sky(spark, sf, "customer", "c_custkey"), 266.4, -29.0, 20.0).select("c_custkey", r6(F.col("separation")).alias("separation"))


@query("cross_match", f"SELECT c_custkey, s_suppkey, round(sep, 6) AS separation FROM ({_PAIRS}) WHERE sep <= 3")
def cross_match(spark, sf):
    a, b = _sides(spark, sf)
    return match.cross_match(a, b, 3.0, ("ra", "dec"), ("ra2", "dec2")).select("c_custkey", "s_suppkey", r6(F.col("separation")).alias("separation"))


@query("nearest_match", f"SELECT c_custkey, s_suppkey, round(sep, 6) AS separation FROM ({_PAIRS}) WHERE sep <= 5 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY sep, s_suppkey) = 1")
def nearest_match(spark, sf):
    a, b = _sides(spark, sf)
    n = match.nearest_match(a, b, 5.0, ("ra", "dec"), ("ra2", "dec2"), "c_custkey", "s_suppkey")
    return n.select("c_custkey", "s_suppkey", r6(F.col("separation")).alias("separation"))


_DAYS = "epoch_us(ts) / 1e6 / 86400"
_ERR = f"(SELECT user_id, {_DAYS} AS e FROM events WHERE event_type = 'error')"


def _days(spark, sf):
    e = table(spark, sf, "events").withColumn("day", micros() / 1e6 / 86400)
    errors = e.where("event_type = 'error'").select("user_id", F.col("day").alias("e"), F.col("event_id").alias("error_id"))
    return e.where("event_type <> 'error'").select("event_id", "user_id", "day"), errors


@query("interval_semi", f"SELECT event_id FROM events v WHERE event_type <> 'error' AND EXISTS (SELECT 1 FROM {_ERR} x WHERE x.user_id = v.user_id AND {_DAYS} > x.e - 0.02 AND {_DAYS} < x.e + 0.5)")
def interval_semi(spark, sf):
    v, x = _days(spark, sf)
    iv = x.select("user_id", (F.col("e") - 0.02).alias("low"), (F.col("e") + 0.5).alias("high"))
    return match.in_intervals(v, iv, "day", "low", "high", ["user_id"], keep=True, open_ends=True).select("event_id")


@query("interval_anti", f"SELECT event_id FROM events v WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM {_ERR} x WHERE x.user_id = v.user_id AND {_DAYS} >= x.e - 0.02 AND {_DAYS} <= x.e + 0.5)")
def interval_anti(spark, sf):
    v, x = _days(spark, sf)
    iv = x.select("user_id", (F.col("e") - 0.02).alias("low"), (F.col("e") + 0.5).alias("high"))
    return match.in_intervals(v, iv, "day", "low", "high", ["user_id"], keep=False).select("event_id")


@query("asof_backward", f"SELECT event_id, round({_DAYS} - (SELECT max(e) FROM {_ERR} x WHERE x.user_id = v.user_id AND x.e <= {_DAYS}), 6) AS since FROM events v WHERE event_type <> 'error'")
def asof_backward(spark, sf):
    v, x = _days(spark, sf)
    return match.asof_backward(v, x, "day", "e", ["user_id"]).select("event_id", r6(F.col("day") - F.col("last_event")).alias("since"))


@query("asof_nearest", f"""
SELECT event_id, error_id, round(d, 6) AS gap FROM (SELECT v.event_id, x.event_id AS error_id, abs(epoch_us(v.ts) / 1e6 / 86400 - epoch_us(x.ts) / 1e6 / 86400) AS d
 FROM events v JOIN events x ON x.user_id = v.user_id AND x.event_type = 'error' WHERE v.event_type <> 'error') WHERE d < 0.5
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY d, error_id) = 1
""")
def asof_nearest(spark, sf):
    v, x = _days(spark, sf)
    return match.asof_nearest(v, x, "day", "e", ["user_id"], 0.5, "event_id", "error_id").select("event_id", "error_id", r6(F.col("gap")).alias("gap"))


@query("colour_curve", f"""
WITH n AS (SELECT floor({_DAYS} + 0.5)::BIGINT AS night, event_type, arg_min(value, {_DAYS}) AS v FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2)
SELECT a.night, a.v AS a, b.v AS b FROM n a JOIN n b ON a.night = b.night AND a.event_type = 'view' AND b.event_type = 'click'
""")
def colour_curve(spark, sf):
    e = table(spark, sf, "events").withColumn("day", micros() / 1e6 / 86400)
    return match.match_nights(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "day", "value")


@query("equi_chain", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def equi_chain(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_P_LON, _P_LAT = sql_place("p_partkey")


@query("coincidences", f"""
WITH a AS (SELECT c_custkey, c_custkey / 200.0::DOUBLE AS mjd, {sql_place('c_custkey')[0]} AS ra, {sql_place('c_custkey')[1]} AS dec, (50 + c_custkey % 400)::DOUBLE AS area FROM customer),
b AS (SELECT p_partkey, p_partkey / 150.0::DOUBLE AS mjd, {_P_LON} AS ra, {_P_LAT} AS dec, (1 + p_partkey % 5)::DOUBLE AS radius FROM part),
p AS (SELECT c_custkey, p_partkey, abs(b.mjd - a.mjd) * 86400 AS dt, {sql_separation('a.ra', 'a.dec', 'b.ra', 'b.dec')} / sqrt(area / pi() + radius * radius) AS apart FROM a JOIN b ON abs(b.mjd - a.mjd) * 86400 <= 500)
SELECT c_custkey, p_partkey, round(0.5 * exp(-0.5 * apart * apart) * (1 - dt / 500), 6) AS score FROM p
""")
def coincidences(spark, sf):
    left = sky(spark, sf, "customer", "c_custkey").select("c_custkey", (F.col("c_custkey") / 200.0).alias("mjd"), "ra", "dec", (50 + F.col("c_custkey") % 400).cast("double").alias("area_90"))
    right = sky(spark, sf, "part", "p_partkey", "nu_ra", "nu_dec").select("p_partkey", (F.col("p_partkey") / 150.0).alias("nu_mjd"), "nu_ra", "nu_dec", (1 + F.col("p_partkey") % 5).cast("double").alias("radius"), F.lit(0.5).alias("p_astro"))
    return match.coincidences(left, right).select("c_custkey", "p_partkey", r6(F.col("score")).alias("score"))
