"""Queries of the archive dialect, recipes, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.plans import recipes
from skyloom.queries.registry import query, r6, sky, sql_place, sql_separation, table
from skyloom.sources import adql, catalog
from skyloom.streaming import alerts

_RA, _DEC = sql_place("c_custkey")


@query("adql_cone", f"SELECT c_custkey, c_mktsegment FROM customer WHERE {sql_separation(_RA, _DEC, '83.8', '-5.4')} <= 25")
def adql_cone(spark, sf):
    catalog.Archive(spark, "demo").register("sources", sky(spark, sf, "customer", "c_custkey"))
    return adql.run(spark, """SELECT "c_custkey", c_mktsegment FROM demo_sources WHERE 1 = CONTAINS(POINT('ICRS', ra, dec), CIRCLE('ICRS', 83.8, -5.4, 25.0))""")


@query("adql_top", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 AND c_mktsegment LIKE '%BUILD%' ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def adql_top(spark, sf):
    catalog.Archive(spark, "demo").register("customers", table(spark, sf, "customer"))
    return adql.run(spark, "SELECT TOP 10 c_custkey, c_acctbal FROM demo_customers WHERE c_acctbal > :least AND c_mktsegment LIKE '%BUILD%' ORDER BY c_acctbal DESC, c_custkey", least=0)


@query("json_records", "SELECT event_id, event_type AS kind, value FROM events")
def json_records(spark, sf):
    e = table(spark, sf, "events").select(F.to_json(F.struct("event_id", "event_type", "value")).alias("j"))
    schema = T.StructType().add("event_id", T.LongType()).add("event_type", T.StringType()).add("value", T.DoubleType())
    return catalog.records_to_table(e, "j", schema, {"event_type": "kind"})


@query("coordinates_in_text", "SELECT c_custkey, round((c_custkey % 360)::DOUBLE, 6) AS ra, round((c_custkey % 90)::DOUBLE, 6) AS dec FROM customer")
def coordinates_in_text(spark, sf):
    t = F.concat_ws(" ", (F.col("c_custkey") % 360).cast("string"), (F.col("c_custkey") % 90).cast("string"))
    p = table(spark, sf, "customer").select("c_custkey", t.alias("t")).withColumn("p", catalog.parse_coordinates("t"))
    return p.select("c_custkey", r6(F.col("p.ra")).alias("ra"), r6(F.col("p.dec")).alias("dec"))


def _alerts(spark, sf):
    return alerts.simulate(table(spark, sf, "events").select(F.col("event_id").alias("value"), F.col("ts").cast("timestamp").alias("timestamp")))


@query("alert_triage")
def alert_triage(spark, sf):
    return alerts.triage(_alerts(spark, sf), ["Quasar_AGN", "Star", "Galaxy", "Transient"]).select("alert_id", "class", "action", r6(F.col("confidence")).alias("confidence"))


@query("window_counts", """SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type AS action, count(*) AS n FROM events GROUP BY 1, 2""")
def window_counts(spark, sf):
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("action"))
    return alerts.windowed_counts(e, "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "action", "n")


@query("session_counts", """
WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s
""")
def session_counts(spark, sf):
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("timestamp"), "user_id")
    return alerts.sessions(e, "12 hours", "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("recipe_bright", "SELECT c_custkey AS source_id, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey")
def recipe_bright(spark, sf):
    """A recipe over a table, as the archives' samples are taken."""
    rows = sky(spark, sf, "customer", "c_custkey").withColumnRenamed("c_custkey", "source_id")
    return recipes.select(rows, recipes.Recipe("Rich customers", "customer", ("source_id", "c_acctbal"), "c_acctbal > 5000 AND c_mktsegment = 'BUILDING'", "c_acctbal"))


@query("recipe_cone", f"SELECT c_custkey FROM customer WHERE {sql_separation(_RA, _DEC, '266.4', '-29.0')} <= 30")
def recipe_cone(spark, sf):
    return recipes.select(sky(spark, sf, "customer", "c_custkey"), recipes.Recipe("Near the Galactic Centre", "customer", ("c_custkey",), cone=(266.4, -29.0, 30.0)))


@query("latest_days", "SELECT event_id, value FROM events WHERE value BETWEEN 60 AND 80")
def latest_days(spark, sf):
    return recipes.in_days(table(spark, sf, "events"), "value", 80.0, 20.0).select("event_id", "value")
