"""Queries of fits and audits: Poisson dipole, conformal residuals, scrambled nulls, empty fields, rewarded abstention."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.operators import audits, decide, skyfits, skymap
from skyloom.operators.resample import sql_uniform
from skyloom.queries.decisions import _sources
from skyloom.queries.registry import query, r6, sky, sql_centres, sql_place, sql_separation, table

_NSIDE = 4
_XYZ = "cos(radians(lon)) * sqrt(1 - z * z) AS x, sin(radians(lon)) * sqrt(1 - z * z) AS y, z"
#: Orders by pixel; those divisible by five are missing in the south, so there is a dipole.
_PIXELS = f"""px AS (SELECT ipix, {_XYZ}, 0.5 + (ipix % 7) / 14.0::DOUBLE AS s, coalesce(k, 0)::DOUBLE AS k FROM {sql_centres(_NSIDE)} c LEFT JOIN
 (SELECT o_orderkey % {12 * _NSIDE**2} AS p, count(*) FILTER (o_orderkey % 5 <> 0) AS south, count(*) AS north FROM orders GROUP BY 1) o ON o.p = c.ipix, LATERAL (SELECT CASE WHEN z > 0 THEN north ELSE south END AS k))"""


def _pixels(spark, sf):
    grid = skymap.pixel_grid(spark, _NSIDE)
    o = table(spark, sf, "orders").select((F.col("o_orderkey") % (12 * _NSIDE**2)).alias("ipix"), (F.col("o_orderkey") % 5 != 0).alias("everywhere"))
    o = o.groupBy("ipix").agg(F.count_if("everywhere").alias("south"), F.count(F.lit(1)).alias("north"))
    count = F.coalesce(F.when(F.col("lat") > 0, F.col("north")).otherwise(F.col("south")), F.lit(0)).cast("double")
    return grid.join(o, "ipix", "left").select("ipix", "lon", "lat", count.alias("count"), (0.5 + F.col("ipix") % 7 / 14.0).alias("coverage"))


def _newton(steps: int) -> str:
    """Newton's steps written out: sums over the pixels, elimination of four equations, substitution."""
    x = ["1.0::DOUBLE", "x", "y", "z"]
    mu = "(s * (p[1] + p[2] * x + p[3] * y + p[4] * z))"
    ctes = ["p0 AS (SELECT [sum(k) / sum(s), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE] AS p FROM px)"]
    less = lambda a, b, k: f"list_transform(range(1, 6), lambda i: {a}[i] - {a}[{k}] / {b}[{k}] * {b}[i]) AS {a}"
    for n in range(steps):
        rows = [", ".join([*[f"sum(k * pow(s / {mu}, 2) * {x[i]} * {x[j]})" for j in range(4)], f"sum((k / {mu} - 1) * s * {x[i]})"]) for i in range(4)]
        ctes.append(f"m{n} AS (SELECT any_value(p) AS p, {', '.join(f'[{r}] AS r{i + 1}' for i, r in enumerate(rows))} FROM px, p{n})")
        ctes.append(f"e{n} AS (SELECT p, r1, {less('r2', 'r1', 1)}, {less('r3', 'r1', 1)}, {less('r4', 'r1', 1)} FROM m{n})")
        ctes.append(f"f{n} AS (SELECT p, r1, r2, {less('r3', 'r2', 2)}, {less('r4', 'r2', 2)} FROM e{n})")
        ctes.append(f"g{n} AS (SELECT p, r1, r2, r3, {less('r4', 'r3', 3)} FROM f{n})")
        ctes.append(f"h{n} AS (SELECT p, r1, r2, r3, r4[5] / r4[4] AS d FROM g{n})")
        ctes.append(f"i{n} AS (SELECT p, r1, r2, d, (r3[5] - r3[4] * d) / r3[3] AS c FROM h{n})")
        ctes.append(f"j{n} AS (SELECT p, r1, d, c, (r2[5] - r2[4] * d - r2[3] * c) / r2[2] AS b FROM i{n})")
        ctes.append(f"p{n + 1} AS (SELECT [p[1] + (r1[5] - r1[4] * d - r1[3] * c - r1[2] * b) / r1[1], p[2] + b, p[3] + c, p[4] + d] AS p FROM j{n})")
    return ",\n".join(ctes)


@query("poisson_dipole", f"""
WITH {_PIXELS},
{_newton(7)}
SELECT round(ln(p[1]), 6) AS ln_n, round(p[2] / p[1], 6) AS x, round(p[3] / p[1], 6) AS y, round(p[4] / p[1], 6) AS z, round(sqrt(p[2] * p[2] + p[3] * p[3] + p[4] * p[4]) / p[1], 6) AS amplitude, (SELECT count(*) FROM px) AS n_pixels, true AS converged FROM p7
""")
def poisson_dipole(spark, sf):
    d = skyfits.poisson_dipole(_pixels(spark, sf))
    return d.select(*[r6(F.col(c)).alias(c) for c in ("ln_n", "x", "y", "z", "amplitude")], "n_pixels", "converged")


_LN_N, _BETA, _K = 4.4, (0.001, -0.002, 0.01), 5.0


@query("conformal_residuals", f"""
WITH {_PIXELS}, r AS (SELECT abs(k - mu) / sqrt(greatest(mu, 1e-6)) AS r FROM (SELECT k, exp({_LN_N}::DOUBLE) * s * (1 + {_K} * ({_BETA[0]} * x + {_BETA[1]} * y + {_BETA[2]} * z)) AS mu FROM px)),
o AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS i, count(*) OVER () AS n FROM r), l AS (SELECT any_value(n) AS n, least(1, ceil((any_value(n) + 1) * 0.95::DOUBLE) / any_value(n)) * (any_value(n) - 1) AS level FROM o),
t AS (SELECT l.n, a.r + (level - floor(level)) * (b.r - a.r) AS t FROM l JOIN o a ON a.i = floor(level) JOIN o b ON b.i = least(floor(level) + 1, l.n - 1))
SELECT t.n AS n_pixels, round(t, 6) AS threshold, count(*) FILTER (r > t) AS n_anomalous, round(count(*) FILTER (r > t) / t.n, 6) AS fraction, round(max(r), 6) AS largest, round(avg(r), 6) AS mean FROM t, r GROUP BY t.n, t
""")
def conformal_residuals(spark, sf):
    s = skyfits.conformal_residuals(_pixels(spark, sf), _LN_N, _BETA, _K)[1]
    return s.select("n_pixels", "n_anomalous", *[r6(F.col(c)).alias(c) for c in ("threshold", "fraction", "largest", "mean")])


_RA, _DEC = sql_place("event_id")
_ALERT = {"ra": 150.0, "dec": 20.0, "area_90": 400.0, "distance": 60.0, "distance_std": 15.0}
_TRIGGER = 60340.0
_SIGMA = max((_ALERT["area_90"] / 3.141592653589793) ** 0.5 / 2.146, 0.1)
_AT = lambda ra, dec: f"(1 / (2 * pi() * {_SIGMA**2}) * exp(-0.5 * pow({sql_separation(ra, dec, '150.0', '20.0')} / {_SIGMA}, 2)))"


def _candidates(spark, sf):
    e = sky(spark, sf, "events", "event_id")
    return e.select(F.col("event_id").alias("candidate_id"), "ra", "dec", (60325.0 + F.col("event_id") % 30).alias("discovery_mjd"), F.lit(60380.0).alias("last_mjd"), F.col("value").alias("host_distance"), F.lit(5.0).alias("host_distance_err"))


@query("candidate_match", f"""
WITH e AS (SELECT event_id, {_AT(_RA, _DEC)} AS density, pow(value - 60, 2) / greatest(15 * 15 + 25, 1) AS chi2 FROM events)
SELECT event_id AS candidate_id, round(density, 9) AS density, round(chi2, 6) AS chi2, round(exp(-0.5 * least(chi2, 50)), 6) AS likelihood FROM e
""")
def candidate_match(spark, sf):
    m = audits.candidate_match(_candidates(spark, sf), _ALERT)
    return m.select("candidate_id", r6(F.col("density"), 9).alias("density"), r6(F.col("chi2")).alias("chi2"), r6(F.col("likelihood")).alias("likelihood"))


_SCORE = "(1000 * {d} * greatest(0, 1 - abs({t} - 60340.0::DOUBLE) / 30.0))"
_U = lambda k: sql_uniform(42, "draw", f"(event_id * 4 + {k})")


@query("scrambling_test", f"""
WITH o AS (SELECT coalesce(max({_SCORE.format(d=_AT(_RA, _DEC), t="(60325.0 + event_id % 30)")}), 0) AS observed FROM events),
c AS (SELECT draw, 360 * {_U(0)} AS ra, degrees(asin(2 * {_U(1)} - 1)) AS dec, 60340.0::DOUBLE - 30 + 60 * {_U(2)} AS t FROM events, (SELECT unnest(range(1, 21)) AS draw)),
m AS (SELECT draw, max({_SCORE.format(d=_AT("ra", "dec"), t="t")}) AS top FROM c GROUP BY draw)
SELECT round(observed, 6) AS observed, round(avg(top), 6) AS null_mean, round(stddev_pop(top), 6) AS null_std, count(*) FILTER (top >= observed) AS exceedances, round((count(*) FILTER (top >= observed) + 1) / 21.0::DOUBLE, 6) AS p_value,
 (count(*) FILTER (top >= observed) + 1) / 21.0 < 0.01 AS significant FROM m, o GROUP BY observed
""")
def scrambling_test(spark, sf):
    density = audits.sky_density_at("ra", "dec", _ALERT["ra"], _ALERT["dec"], _ALERT["area_90"])
    score = 1000 * density * F.greatest(F.lit(0.0), 1 - F.abs(F.col("discovery_mjd") - _TRIGGER) / 30.0)
    t = audits.scrambling_test(_candidates(spark, sf), score, _TRIGGER, 20)
    return t.select(*[r6(F.col(c)).alias(c) for c in ("observed", "null_mean", "null_std", "p_value")], "exceedances", "significant")


@query("empty_field_audit", """
WITH f AS (SELECT user_id, count(*) AS n, count(*) FILTER (value > 99) AS t FROM events GROUP BY 1)
SELECT count(*) AS n_fields, sum(n)::BIGINT AS n_candidates, sum(t)::BIGINT AS n_triggers, count(*) FILTER (t > 0) AS false_fields, round(sum(t) / sum(n), 6) AS false_alarm_rate, round(count(*) FILTER (t > 0) / count(*), 6) AS fdr, count(*) FILTER (t > 0) / count(*) <= 0.05 AS satisfied FROM f
""")
def empty_field_audit(spark, sf):
    a = audits.empty_field_audit(table(spark, sf, "events"), "user_id", F.col("value") > 99, 0.05)
    return a.select("n_fields", "n_candidates", "n_triggers", "false_fields", r6(F.col("false_alarm_rate")).alias("false_alarm_rate"), r6(F.col("fdr")).alias("fdr"), "satisfied")


@query("abstention_reward", """
WITH s AS (SELECT event_id, event_type = 'view' AND 0.5 + value / 200 >= 0.85 AND value / 100 >= 0.5 AND 0.6 - value / 200 <= 0.20 AS auto, (event_id % 20) / 100.0 >= 0.12 OR 0.6 - value / 200 >= 0.35 AS waits FROM events),
d AS (SELECT *, auto AND event_id % 7 <> 0 AND event_id % 3 <> 0 AS correct, auto AND event_id % 7 <> 0 AND event_id % 3 = 0 AS wrong, NOT auto AND waits AS abstains FROM s)
SELECT count(*) AS n_total, count(*) FILTER (correct) AS n_correct, count(*) FILTER (abstains) AS n_abstain, count(*) FILTER (wrong) AS n_wrong,
 round((count(*) FILTER (correct) - 2.0 * count(*) FILTER (wrong)) / count(*), 6) AS truthfulness, round(count(*) FILTER (correct) / greatest(1, count(*) FILTER (auto)), 6) AS accuracy,
 round(count(*) FILTER (abstains) / count(*), 6) AS abstention_rate, round(count(*) FILTER (wrong) / count(*), 6) AS wrong_rate FROM d
""")
def abstention_reward(spark, sf):
    """Decisions of the follow-up gate; the truth of every seventh source is unknown, and that of every third differs."""
    s = _sources(spark, sf)
    truth = s.where("event_id % 7 <> 0").select("event_id", F.when(F.col("event_id") % 3 == 0, "Galaxy").otherwise(F.col("class")).alias("class"))
    found = audits.abstention_reward(s, decide.route_sources(s), truth, id="event_id")
    return found.select(*[c for c in found.columns if c.startswith("n_")], *[r6(F.col(c)).alias(c) for c in ("truthfulness", "accuracy", "abstention_rate", "wrong_rate")])
