"""Queries over light curves: events as brightness of their user over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.operators import schedule, timeseries
from skyloom.queries.registry import micros, place, query, r6, table

_JD = "epoch_us(ts) / 1e6 / 86400 + 2440587.5"


def _curve(spark, sf):
    jd = micros() / 1e6 / 86400 + 2440587.5
    return table(spark, sf, "events").select("user_id", "event_id", jd.alias("jd"), (F.col("value") / 10).alias("mag"), F.lit(0.1).alias("err"), "event_type")


@query("nightly_bins", f"""
WITH a AS (SELECT user_id, {_JD} AS jd, value / 10 AS mag, floor({_JD})::BIGINT AS night FROM events),
b AS (SELECT *, quantile_cont(mag, 0.5) OVER (PARTITION BY user_id, night) AS med FROM a), c AS (SELECT *, abs(mag - med) < 0.5 AS near FROM b),
d AS (SELECT *, max(near::INT) OVER (PARTITION BY user_id, night) AS anyone FROM c), e AS (SELECT * FROM d WHERE near OR anyone = 0),
f AS (SELECT *, quantile_cont(mag, 0.5) OVER (PARTITION BY user_id, night) AS m2 FROM e)
SELECT user_id, night, round(avg(jd), 5) AS jd, round(quantile_cont(mag, 0.5), 6) AS mag,
 round(greatest(CASE WHEN count(*) > 2 THEN 1.4826 * quantile_cont(abs(mag - m2), 0.5) ELSE 0 END / sqrt(count(*)), 0.1 / sqrt(count(*)), 0.02), 6) AS err, count(*) AS n
FROM f GROUP BY user_id, night
""")
def nightly_bins(spark, sf):
    b = timeseries.nightly_bins(_curve(spark, sf), ["user_id"])
    return b.select("user_id", "night", r6(F.col("jd"), 5).alias("jd"), r6(F.col("mag")).alias("mag"), r6(F.col("err")).alias("err"), "n")


@query("fixed_bins", f"""
WITH a AS (SELECT user_id, value / 10 AS mag, floor(({_JD} - 2460310.0) / 3.0)::BIGINT AS bin FROM events), b AS (SELECT *, quantile_cont(mag, 0.5) OVER (PARTITION BY user_id, bin) AS m FROM a)
SELECT user_id, bin, round(quantile_cont(mag, 0.5), 6) AS median, round(1.4826 * quantile_cont(abs(mag - m), 0.5) / sqrt(count(*)), 6) AS error, count(*) AS n FROM b GROUP BY 1, 2 HAVING count(*) >= 2
""")
def fixed_bins(spark, sf):
    b = timeseries.fixed_bins(_curve(spark, sf), ["user_id"], "jd", "mag", 2460310.0, 3.0)
    return b.select("user_id", "bin", r6(F.col("median")).alias("median"), r6(F.col("error")).alias("error"), "n")


@query("night_count", f"""
WITH a AS (SELECT user_id, (2000 + ({_JD} - 2451545.0) / 365.25) * 365.25 AS d FROM events), b AS (SELECT *, d - lag(d) OVER (PARTITION BY user_id ORDER BY d) > 0.5 AS new FROM a)
SELECT user_id, 1 + count(*) FILTER (new) AS nights, count(*) AS points FROM b GROUP BY 1
""")
def night_count(spark, sf):
    c = _curve(spark, sf).withColumn("t", 2000 + (F.col("jd") - 2451545.0) / 365.25)
    return timeseries.night_count(c, ["user_id"], "t")


def _plates(spark, sf):
    """Every fifth event is a limit; times are spread so that one day is one hundred."""
    c = _curve(spark, sf)
    det = F.col("event_id") % 5 != 0
    return c.select("user_id", "event_id", ((F.col("jd") - 2460310.0) * 100 / 365.25).alias("t"), F.when(det, F.col("mag")).alias("mag"), det.alias("det"), F.col("mag").alias("lim"))


_PL = f"SELECT user_id, event_id, ({_JD} - 2460310.0) * 100 / 365.25 AS t, event_id % 5 <> 0 AS det, value / 10 AS mag FROM events"
_ENV = f"""
SELECT a.user_id, a.event_id, CASE WHEN (SELECT count(*) FROM p c WHERE c.user_id = a.user_id) < 10 OR count(*) < 5 THEN 4.0 ELSE quantile_cont(CASE WHEN b.det THEN b.mag ELSE greatest(b.mag, 4.0) END, 0.5) END AS envelope
FROM p a JOIN p b ON a.user_id = b.user_id AND b.t >= a.t - 500 * (1 / 365.25::DOUBLE) AND b.t < a.t + 500 * (1 / 365.25::DOUBLE) GROUP BY a.user_id, a.event_id"""


@query("envelope", f"WITH p AS ({_PL}) SELECT event_id, round(envelope, 6) AS envelope FROM ({_ENV})")
def envelope(spark, sf):
    e = timeseries.envelope(_plates(spark, sf), ["user_id"], 4.0)
    return e.select("event_id", r6(F.col("envelope")).alias("envelope"))


@query("eruption_scan", f"""
WITH p AS ({_PL}), e AS ({_ENV}), x AS (SELECT p.user_id, p.t, p.t * 365.25 AS d, p.mag, envelope - mag AS ex FROM p JOIN e USING (event_id) WHERE det AND mag < envelope - 1.0),
c AS (SELECT *, sum(CASE WHEN g > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY d) AS cl FROM (SELECT *, d - lag(d) OVER (PARTITION BY user_id ORDER BY d) AS g FROM x)),
n AS (SELECT *, d - lag(d) OVER (PARTITION BY user_id, cl ORDER BY d) > 0.5 AS new FROM c),
s AS (SELECT user_id, cl, list_sort(list(ex), 'DESC')[2] AS score, min(t) AS t0, 1 + count(*) FILTER (new) AS nights, count(*) AS plates FROM n GROUP BY 1, 2)
SELECT user_id, round(score, 6) AS score, round(t0, 6) AS t0, nights, plates FROM s WHERE nights >= 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, t0) = 1
""")
def eruption_scan(spark, sf):
    e = timeseries.envelope(_plates(spark, sf), ["user_id"], 4.0)
    s = timeseries.eruption_scan(e, ["user_id"])
    return s.select("user_id", r6(F.col("score")).alias("score"), r6(F.col("t0")).alias("t0"), "nights", "plates")


@query("mean_level", f"""
SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(avg(value / 10), 6) END AS mean, CASE WHEN count(*) >= 3 THEN round(stddev_samp(value / 10) / sqrt(count(*)), 6) END AS sem
FROM events WHERE {_JD} >= 2460312.0 AND {_JD} < 2460325.0 GROUP BY 1
""")
def mean_level(spark, sf):
    m = timeseries.mean_level(_curve(spark, sf), ["user_id"], 2460312.0, 2460325.0, "jd", "mag")
    return m.select("user_id", "n", r6(F.col("mean")).alias("mean"), r6(F.col("sem")).alias("sem"))


@query("transit_windows", """
SELECT o_orderkey, k AS epoch, round(o_custkey + k * p, 5) AS mid FROM (SELECT *, 3.0 + o_orderkey % 7 AS p, unnest(range(0, 3)) + ceil((500.0 - o_custkey) / (3.0 + o_orderkey % 7)) AS k FROM orders)
""")
def transit_windows(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("t0"), (3.0 + F.col("o_orderkey") % 7).alias("period"), F.lit(0.2).alias("duration"))
    return timeseries.transit_windows(o, 500.0, 3).select("o_orderkey", F.col("epoch").cast("double").alias("epoch"), "mid")


@query("watch_overlap", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1996-03-31' AND CAST(o_orderdate AS DATE) + (o_orderkey % 30)::INT >= DATE '1996-03-01'")
def watch_overlap(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("start"))
    o = o.withColumn("end", F.date_add("start", (F.col("o_orderkey") % 30).cast("int")))
    return timeseries.upcoming(o, "1996-03-01", "1996-03-31").select("o_orderkey")


@query("greedy_queue")
def greedy_queue(spark, sf):
    lon, lat = place("event_id")
    c = table(spark, sf, "events").select(F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("long").alias("night"), F.concat(F.lit("E"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("source_id"), lon.alias("ra"), lat.alias("dec"), (15 + F.col("value") / 20).alias("phot_g"), (F.col("value") / 100).alias("gain"), F.lit(0.5).alias("vacuity"))
    return schedule.greedy_queue(c)
