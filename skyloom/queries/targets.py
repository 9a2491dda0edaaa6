"""Queries of target resolution and feature vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.operators import features, resolve
from skyloom.queries.fits import _ALERT, _AT, _candidates
from skyloom.queries.registry import query, r6, sky, sql_place, sql_separation, table

_RA, _DEC = sql_place("p_partkey")
_EVENT_RA, _EVENT_DEC = sql_place("event_id")


@query("resolve_targets", f"""
WITH c AS (SELECT c_custkey AS k, c_custkey % 7 AS kind FROM customer), o AS (SELECT p_partkey AS k, {_RA} AS ra, {_DEC} AS dec FROM part),
f AS (SELECT c.k, (c.k % 360)::DOUBLE AS ra, (c.k % 90)::DOUBLE AS dec FROM c WHERE kind = 0),
n AS (SELECT f.k, arg_min(o.k, {sql_separation('f.ra', 'f.dec', 'o.ra', 'o.dec')}) AS o FROM f JOIN o ON {sql_separation('f.ra', 'f.dec', 'o.ra', 'o.dec')} <= 1 GROUP BY f.k)
SELECT f.k AS request, CASE WHEN n.o IS NULL THEN 'blank' ELSE 'nearby' END AS kind, n.o AS found, round(f.ra, 6) AS ra, round(f.dec, 6) AS dec, CASE WHEN n.o IS NULL THEN 0.3::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM f LEFT JOIN n ON n.k = f.k
UNION ALL SELECT c.k, 'exact', o.k, round(o.ra, 6), round(o.dec, 6), 1.0 FROM c JOIN o ON o.k = c.k WHERE kind IN (1, 2)
UNION ALL SELECT c.k, 'ephemeris', NULL, 10.0 + c.k % 5, -5.0, 0.95 FROM c WHERE kind = 3 AND c.k % 5 <> 4
UNION ALL SELECT c.k, 'relaxed', o.k, round(o.ra, 6), round(o.dec, 6), 0.5 FROM c JOIN o ON o.k = c.k WHERE kind = 4
""")
def resolve_targets(spark, sf):
    """Customers ask for positions, names in any case, bodies and parts of names; parts are the objects."""
    k, p = F.col("c_custkey"), F.col("p_partkey")
    kind = k % 7
    text = F.when(kind == 0, F.concat_ws(" ", (k % 360).cast("string"), (k % 90).cast("string"))).when(kind == 1, F.concat(F.lit(" Object No "), k)).when(kind == 2, F.concat(F.lit("object no "), k))
    text = text.when(kind == 3, F.concat(F.lit("BODY"), k % 5)).when(kind == 4, F.concat(k, F.lit(" no"))).when(kind == 5, "")
    requests = table(spark, sf, "customer").select(k.alias("request"), text.alias("text"))
    objects = sky(spark, sf, "part", "p_partkey").select(p.alias("name"), F.concat(F.lit("Object No "), p).alias("alias"), F.lit("QSO").alias("otype"), "ra", "dec").withColumn("name", F.col("name").cast("string"))
    bodies = spark.range(5).select(F.concat(F.lit("body"), F.col("id")).alias("name"), F.lit("Solar System").alias("otype"), (10.0 + F.col("id")).alias("ra"), F.when(F.col("id") < 4, -5.0).otherwise(float("nan")).alias("dec"))
    found = resolve.resolve_targets(requests, objects, bodies, 60.0)
    return found.select("request", "kind", F.col("name").try_cast("long").alias("found"), r6(F.col("ra")).alias("ra"), r6(F.col("dec")).alias("dec"), "confidence")


@query("burst_features", """
WITH e AS (SELECT event_id, value * 20 AS dm, value * 18 - 30 AS ne, value * 17 AS ymw, (event_id % 180 - 90)::DOUBLE AS b, CASE WHEN event_id % 6 <> 0 THEN value / 30 END AS scat, value / 25 AS width, value / 40 AS flux, value / 15 AS fluence, value * 1.5 AS snr FROM events),
x AS (SELECT *, greatest(pow(10.0::DOUBLE, -3.86 + 0.154 * log10(greatest(dm, 1.0)) + 1.07 * pow(log10(greatest(dm, 1.0)), 2)) / 1000, 1e-4) AS tau FROM e),
f AS (SELECT event_id, [log10(greatest(dm, 1.0)), log10(greatest(ne, 1.0)), log10(greatest(ymw, 1.0)), abs(greatest(ne, 0) - greatest(ymw, 0)) / greatest(dm, 1.0), sin(radians(abs(b))), CASE WHEN scat IS NOT NULL THEN log10(greatest(scat, 1e-4)) END, log10(greatest(width, 0.05)),
  log10(greatest(flux, 0.01)), log10(greatest(fluence, 0.05)), least(snr, 100.0) / 20, CASE WHEN scat IS NOT NULL THEN least(5, greatest(-5, log10(greatest(scat, 1e-4)) - log10(tau))) END, least(greatest(greatest(ne, 0) - 60, 0) / 950, 4.0)] AS f FROM x)
SELECT event_id, k::INTEGER AS k, round(f[k + 1], 6) AS feature FROM f, (SELECT unnest(range(12)) AS k)
""")
def burst_features(spark, sf):
    v, k = F.col("value"), F.col("event_id")
    e = table(spark, sf, "events").select(
        "event_id", (v * 20).alias("dm"), (v * 18 - 30).alias("dm_ne"), (v * 17).alias("dm_ymw"), (k % 180 - 90).cast("double").alias("glat"), F.when(k % 6 != 0, v / 30).alias("scat_ms"), (v / 25).alias("width_ms"), (v / 40).alias("flux_jy"), (v / 15).alias("fluence_jyms"), (v * 1.5).alias("snr"),
    )
    return features.burst_features(e).select("event_id", F.posexplode("features").alias("k", "feature")).select("event_id", "k", r6(F.col("feature")).alias("feature"))


@query("candidate_features", f"""
WITH e AS (SELECT event_id, {_AT(_EVENT_RA, _EVENT_DEC)} AS density, event_id % 4 <> 0 AS hosted, pow(value - 60, 2) / greatest(15 * 15 + 25, 1) AS chi2, value, abs(90 - {sql_separation(_EVENT_RA, _EVENT_DEC, '192.85948::DOUBLE', '27.12825::DOUBLE')}) AS b FROM events),
x AS (SELECT *, least(greatest(0.05::DOUBLE / sin(radians(least(greatest(b, 1.0), 85.0))), 0.02), 5.0) AS av FROM e),
f AS (SELECT event_id, [log10(greatest(density, 1e-8)), CASE WHEN hosted THEN least(chi2, 50) ELSE 12 END, CASE WHEN hosted THEN 10.5 ELSE 9.5 END, (event_id % 10) / 10.0, value / 100, value / 200, value / 50 - 0.35 * av, 0.05, av, 21 - value / 5, 2.5, 1.0857 / greatest(value / 1000, 0.01)] AS f FROM x)
SELECT event_id, k::INTEGER AS k, round(f[k + 1], 5) AS feature FROM f, (SELECT unnest(range(12)) AS k)
""")
def candidate_features(spark, sf):
    v, k = F.col("host_distance"), F.col("candidate_id")
    c = _candidates(spark, sf).select("*", (k % 10 / 10.0).alias("coincidence"), F.lit(10.5).alias("log_mass"), (v / 100).alias("rate_r"), (v / 200).alias("rate_g"), (v / 50).alias("colour"), F.lit(0.05).alias("colour_rate"), F.lit(21.0).alias("limit"), (v / 5).alias("mag_r"), (v / 1000).alias("mag_err_r"), F.lit(2.5).alias("host_offset"))
    c = c.withColumn("host_distance", F.when(k % 4 != 0, F.col("host_distance")))
    found = features.candidate_features(c, _ALERT)
    return found.select(k.alias("event_id"), F.posexplode("features").alias("k", "feature")).select("event_id", "k", r6(F.col("feature"), 5).alias("feature"))
