"""Queries of registered SQL functions, sketches and striped extracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import registered
from skyloom.operators import sketches
from skyloom.operators.skymap import pixel_grid
from skyloom.queries.decisions import _ALPHA
from skyloom.queries.registry import query, r6, sky, sql_place, sql_separation, table
from skyloom.sources.shared import fresh_path, written
from skyloom.sources.stripes import Stripes

_RA, _DEC = sql_place("c_custkey")


@query("sql_functions", f"""
WITH s AS (SELECT c_custkey, {_RA} AS ra, {_DEC} AS dec FROM customer), k AS (SELECT *, {sql_separation('ra', 'dec', '83.8', '-5.4')} AS sep FROM s)
SELECT c_custkey, round(sep, 6) AS sep, sep <= 40 AS near FROM k
""")
def sql_functions(spark, sf):
    registered.register(spark)
    sky(spark, sf, "customer", "c_custkey").createOrReplaceTempView("skyloom_stars")
    return spark.sql("SELECT c_custkey, round(sky_sep(ra, dec, 83.8D, -5.4D), 6) AS sep, cone(ra, dec, 83.8D, -5.4D, 40D) AS near FROM skyloom_stars")


@query("sql_pixels", "SELECT c_custkey % 48 AS ipix, count(*) AS n FROM customer GROUP BY 1")
def sql_pixels(spark, sf):
    """Customers at the centre of the pixel of their key, counted by the pixel that the function gives."""
    registered.register(spark)
    stars = table(spark, sf, "customer").select((F.col("c_custkey") % 48).alias("ipix"))
    stars.join(pixel_grid(spark, 2), "ipix").createOrReplaceTempView("skyloom_centres")
    return spark.sql("SELECT healpix_ring(lon, lat, 2) AS ipix, count(*) AS n FROM skyloom_centres GROUP BY 1")


@query("sql_information_gain", f"""
WITH e AS (SELECT vec_id, unnest({_ALPHA}) AS a, list_sum({_ALPHA}) AS s FROM embeddings),
g AS (SELECT *, (lgamma(a + 1 + 1e-5) - lgamma(a + 1 - 1e-5)) / 2e-5 AS da, (lgamma(s + 1 + 1e-5) - lgamma(s + 1 - 1e-5)) / 2e-5 AS ds FROM e)
SELECT vec_id, round(greatest(0, sum(-a / s * ln(a / s)) + sum(a / s * (da - ds))), 4) AS gain FROM g GROUP BY 1
""")
def sql_information_gain(spark, sf):
    registered.register(spark)
    table(spark, sf, "embeddings").createOrReplaceTempView("skyloom_evidence")
    return spark.sql("SELECT vec_id, round(bald(transform(slice(embedding, 1, 4), x -> 1 + log1p(exp(CAST(x AS DOUBLE) * 4)))), 4) AS gain FROM skyloom_evidence")


@query("sql_scatter", """
WITH m AS (SELECT user_id, value, quantile_cont(value, 0.5) OVER (PARTITION BY user_id) AS med, count(value) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(CASE WHEN any_value(n) < 5 THEN 0.3 ELSE 1.4826 * quantile_cont(abs(value - med), 0.5) END, 6) AS sigma FROM m GROUP BY user_id
""")
def sql_scatter(spark, sf):
    registered.register(spark)
    table(spark, sf, "events").createOrReplaceTempView("skyloom_events")
    return spark.sql("SELECT user_id, round(mad_sigma(value), 6) AS sigma FROM skyloom_events GROUP BY user_id")


@query("sql_transits", """
WITH p AS (SELECT p_partkey, 2460000 + p_partkey % 100 AS t0, 1.5 + p_size / 10.0::DOUBLE AS period FROM part), f AS (SELECT *, ceil((2460310.0::DOUBLE - t0) / period)::BIGINT AS first FROM p)
SELECT p_partkey, first + k AS epoch, round(t0 + (first + k) * period, 6) AS mid FROM f, (SELECT unnest(range(3)) AS k)
""")
def sql_transits(spark, sf):
    registered.register(spark)
    table(spark, sf, "part").createOrReplaceTempView("skyloom_parts")
    return spark.sql("SELECT p_partkey, t.epoch, round(t.mid, 6) AS mid FROM skyloom_parts, LATERAL transit_times(CAST(2460000 + p_partkey % 100 AS DOUBLE), 1.5D + p_size / 10D, 2460310D, 3) t")


_LEVELS = [0.05, 0.5, 0.95]


@query("sketched_by_day", f"""
SELECT event_type, count(*) AS n, true AS distinct_within, true AS quantiles_within FROM events GROUP BY 1
""")
def sketched_by_day(spark, sf):
    """Sketches of users and values by day and type, stored, merged to types, and held against the exact values."""
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    stored = written(sketches.build(e, ["day", "event_type"], "user_id", "value"), "sketches")
    found = sketches.estimate(sketches.merge(stored, ["event_type"]), _LEVELS)
    exact = e.groupBy("event_type").agg(F.countDistinct("user_id").alias("d"), *[F.percentile("value", F.lit(min(1.0, max(0.0, q + s * sketches.RANK_ERROR)))).alias(f"q{i}{'lh'[s > 0]}") for i, q in enumerate(_LEVELS) for s in (-1, 1)])
    near = F.abs(F.col("n_distinct") - F.col("d")) <= sketches.DISTINCT_ERROR * F.col("d") + 1
    inside = F.lit(True)
    for i in range(len(_LEVELS)):
        inside = inside & F.col("quantiles")[i].between(F.col(f"q{i}l"), F.col(f"q{i}h"))
    return found.join(exact, "event_type").select("event_type", "n", near.alias("distinct_within"), inside.alias("quantiles_within"))


@query("striped_extract", f"SELECT c_custkey, round({_RA}, 6) AS ra FROM customer WHERE {_RA} >= 100 AND {_RA} < 145")
def striped_extract(spark, sf):
    """Customers as a catalogue in twelve stripes; the range reads two of them."""
    stripes = Stripes(spark, fresh_path(spark, "stripes"))
    stripes.extract(sky(spark, sf, "customer", "c_custkey").select("c_custkey", "ra", "dec"))
    return stripes.read(100.0, 145.0).select("c_custkey", r6(F.col("ra")).alias("ra"))
