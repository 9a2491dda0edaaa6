"""Queries of photographic plates: tidy rows, light curves by position, rows around an epoch, control stars."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.operators import plates
from skyloom.queries.registry import micros, query, r6, sky, sql_place, sql_separation, table
from skyloom.queries.series import _JD


def _any(column: str, names: tuple[str, ...]) -> str:
    """Whether any of the named bits is set, bit by bit."""
    of = plates.BFLAGS if column == "bf" else plates.AFLAGS
    return "(" + " OR ".join(f"({column} // {of[n]}) % 2 = 1" for n in names) + ")"


@query("tidy_plates", f"""
WITH a AS (SELECT event_id, {_JD} AS jd, event_id % 3 AS gsc, event_id % 2 AS sxt, CASE WHEN event_id % 11 <> 0 THEN value / 10 END AS m, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 13 = 0 THEN -1 ELSE value / 40 END AS rms,
  CASE WHEN event_id % 3 <> 0 THEN 3 + value / 10 END AS lim, (event_id * 7919 * 64) % 33554432 AS af, (event_id * 31) % 2048 AS bf FROM events),
b AS (SELECT *, NOT (gsc = 0 AND sxt = 0) AND m IS NOT NULL AS det, least(1.5, greatest(0.08, CASE WHEN rms > 0 THEN rms ELSE 0.25 END)) AS e FROM a),
c AS (SELECT *, det AND {_any('af', ('close_to_limit',))} AS near FROM b)
SELECT event_id, round(2000 + (jd - 2451545.0) / 365.25, 6) AS t, CASE WHEN det THEN round(m, 6) END AS mag, det, near AS near_limit, det AND {_any('bf', ('saturated', 'psf_saturated'))} AS sat,
 round(sqrt(e * e + CASE WHEN near THEN 0.09 ELSE 0 END + CASE WHEN det AND {_any('af', plates.SOFT)} THEN 0.25 ELSE 0 END), 6) AS err,
 CASE WHEN det THEN NOT {_any('af', plates.BAD)} ELSE coalesce(lim > 5, false) AND NOT {_any('af', plates.BAD_LIMIT)} END AS good FROM c
""")
def tidy_plates(spark, sf):
    k, v = F.col("event_id"), F.col("value")
    raw = table(spark, sf, "events").select(
        "event_id", (micros() / 1e6 / 86400 + 2440587.5).alias("date_jd"), (k % 3).alias("gsc_bin_index"), (k % 2).alias("sextractor_number"), F.when(k % 11 != 0, v / 10).otherwise(float("nan")).alias("magcal_magdep"),
        F.when(k % 7 == 0, None).when(k % 13 == 0, -1.0).otherwise(v / 40).alias("magcal_local_rms"), F.when(k % 3 != 0, 3 + v / 10).alias("limiting_mag_local"), (k * 7919 * 64 % 33554432).alias("aflags"), (k * 31 % 2048).alias("bflags"),
    )
    return plates.tidy(raw).select("event_id", r6(F.col("t")).alias("t"), r6(F.col("mag")).alias("mag"), "det", "near_limit", "sat", r6(F.col("err")).alias("err"), "good")


_FIELD = """SELECT event_id AS row, user_id AS target, 100 + user_id * 0.1::DOUBLE AS tra, 10.0::DOUBLE AS tdec, 100 + user_id * 0.1::DOUBLE + (event_id * 7) % 11 * 0.0003::DOUBLE AS ra, 10 + (event_id * 3) % 7 * 0.0003::DOUBLE AS dec,
  CASE WHEN event_id % 5 <> 0 THEN value / 10 END AS mag, event_type AS series, event_id % 20 AS plate, CASE WHEN event_id % 9 = 0 THEN 0 ELSE event_id % 2 END AS solution, event_id % 4 AS owner FROM events"""
_D = "sqrt(pow((ra - {0}) * cos(radians({1})), 2) + pow(dec - {1}, 2)) * 3600"


@query("assemble_curve", f"""
WITH e AS ({_FIELD}), f AS (SELECT *, {_D.format('tra', 'tdec')} AS d, CASE WHEN owner = 1 THEN tra + 0.001::DOUBLE ELSE tra + 0.006::DOUBLE END AS ora FROM e),
u AS (SELECT target, owner, quantile_cont(mag, 0.5) AS med, count(mag) AS n FROM f WHERE owner IN (1, 3) GROUP BY 1, 2),
g AS (SELECT f.*, CASE WHEN owner % 2 = 0 THEN d <= 15 WHEN (ora - tra) * cos(radians(tdec)) * 3600 < 8 THEN d <= 6 AND (n < 3 OR mag <= med - 1) ELSE d <= 6 AND 2 * d < {_D.format('ora', 'tdec')} END AS ok FROM f LEFT JOIN u USING (target, owner)),
k AS (SELECT *, row_number() OVER (PARTITION BY target, series, plate, solution ORDER BY d, CASE WHEN owner % 2 = 0 THEN 0 ELSE owner END, row) AS k FROM g WHERE ok AND mag IS NOT NULL), b AS (SELECT * FROM k WHERE k = 1)
SELECT target, series, plate, solution, round(mag, 6) AS mag, round(d, 5) AS distance, CASE WHEN owner % 2 = 1 THEN owner END AS owner FROM b
UNION ALL SELECT target, series, plate, solution, NULL, round(d, 5), NULL FROM g WHERE owner % 2 = 0 AND mag IS NULL AND NOT EXISTS (SELECT 1 FROM b WHERE b.target = g.target AND b.series = g.series AND b.plate = g.plate AND b.solution = g.solution)
""")
def assemble_curve(spark, sf):
    k = F.col("event_id")
    e = table(spark, sf, "events").select(
        k.alias("row"), F.col("user_id").alias("target"), (100 + F.col("user_id") * 0.1).alias("target_ra"), F.lit(10.0).alias("target_dec"), (100 + F.col("user_id") * 0.1 + k * 7 % 11 * 0.0003).alias("ra_deg"), (10 + k * 3 % 7 * 0.0003).alias("dec_deg"),
        F.when(k % 5 != 0, F.col("value") / 10).alias("mag"), F.col("event_type").alias("series"), (k % 20).alias("plate"), F.when(k % 9 != 0, k % 2).alias("solution"), (k % 4).alias("owner"),
    )
    others = e.where("owner % 2 = 1").withColumn("owner_ra", F.col("target_ra") + F.when(F.col("owner") == 1, 0.001).otherwise(0.006)).withColumn("owner_dec", F.col("target_dec"))
    a = plates.assemble(e.where("owner % 2 = 0").drop("owner"), others, "target")
    return a.select("target", "series", "plate", "solution", r6(F.col("mag")).alias("mag"), r6(F.col("distance"), 5).alias("distance"), "owner")


@query("rows_near_epoch", """
SELECT c.event_id AS centre_id, e.event_id AS id FROM events c JOIN events e ON e.user_id = c.user_id AND epoch_us(e.ts) >= epoch_us(c.ts) - 172800000000 AND epoch_us(e.ts) < epoch_us(c.ts) + 172800000000 WHERE c.event_id % 20 = 0
""")
def rows_near_epoch(spark, sf):
    """Events of the same user within two days of every twentieth event."""
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("id"), micros().cast("double").alias("t"))
    c = e.where("id % 20 = 0").select("user_id", F.col("id").alias("centre_id"), F.col("t").alias("centre"))
    return plates.rows_near(e, c, ["user_id"], "t", "centre", 172800e6).select("centre_id", "id")


_RA, _DEC = sql_place("c_custkey")


@query("control_stars", f"""
WITH s AS (SELECT c_custkey AS star, 180 + {_RA} / 360 AS ra, {_DEC} / 180 AS dec, 10 + c_acctbal / 2000 AS mag, (c_custkey * 37) % 60 AS n, c_custkey % 9 = 0 AS v FROM customer),
t AS (SELECT star AS tid, ra AS tra, dec AS tdec, mag AS tmag, n AS tn, 200 + tid_k % 5 * 100 AS r FROM (SELECT *, star // 10 AS tid_k FROM s) WHERE star % 10 = 0),
p AS (SELECT tid, star, r, {sql_separation('tra', 'tdec', 'ra', 'dec')} * 3600 AS d, abs(mag - tmag) AS dm, (star * 7919 + tid * 104729) % 1000003 AS o FROM t, s WHERE NOT v AND CASE WHEN tn < 20 THEN n < 20 ELSE n >= 0.5 * tn END),
z AS (SELECT *, 0 AS zone FROM p WHERE d > 0.4 * r AND d <= r AND dm < 1 UNION ALL SELECT *, 1 FROM p WHERE r >= 300 AND d > 120 AND d <= 900 AND dm < 1),
c AS (SELECT tid, zone, count(*) AS n, count(*) FILTER (dm < 0.5) AS a FROM z GROUP BY 1, 2), w AS (SELECT tid, CASE WHEN max(n) FILTER (zone = 0) >= 2 THEN 0 ELSE max(zone) END AS zone FROM c GROUP BY 1),
k AS (SELECT z.*, row_number() OVER (PARTITION BY tid ORDER BY o, star) AS k FROM z JOIN w USING (tid, zone) JOIN c USING (tid, zone) WHERE a < 2 OR dm < 0.5)
SELECT tid, star, round(d, 4) AS separation FROM k WHERE k <= 2
""")
def control_stars(spark, sf):
    """Two controls for every tenth of the customers, which stand for the stars of one square degree."""
    k = F.col("c_custkey")
    s = sky(spark, sf, "customer", "c_custkey").select(k.alias("star"), (180 + F.col("ra") / 360).alias("ra"), (F.col("dec") / 180).alias("dec"), (10 + F.col("c_acctbal") / 2000).alias("mag"), (k * 37 % 60).alias("matches"), F.when(k % 9 == 0, 1).otherwise(0).alias("v_flag"))
    t = s.where("star % 10 = 0").select(F.col("star").alias("tid"), F.col("ra").alias("target_ra"), F.col("dec").alias("target_dec"), F.col("mag").alias("target_mag"), F.col("matches").alias("target_matches"), (200 + F.floor(F.col("star") / 10) % 5 * 100).cast("double").alias("radius"))
    c = plates.control_stars(t, s, plates.Turn(F.col("star") * 7919, F.col("tid") * 104729, 1000003))
    return c.select("tid", "star", r6(F.col("separation"), 4).alias("separation"))
