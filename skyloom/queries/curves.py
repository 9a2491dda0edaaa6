"""Queries of fits to single series."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.operators import series_fits, timeseries
from skyloom.queries.registry import least_squares, query, r6
from skyloom.queries.series import _JD, _curve, _plates

_PERIODS = [3.0, 7.0, 11.5, 29.0]


_V = [f"{f}({k} * turn)" for k in (1, 2) for f in ("cos", "sin")] + ["1.0::DOUBLE", "u", "u * u", "u * u * u"]


@query("fit_ephemeris", f"""
WITH e AS (SELECT {_JD} AS t, value / 10 - avg(value / 10) OVER () AS y FROM events), p AS (SELECT unnest({_PERIODS}::DOUBLE[]) AS period), s AS (SELECT min(t) AS a, max(t) AS b FROM e),
d AS (SELECT period, y, 100.0::DOUBLE AS w, 2 * pi() * (t - {series_fits.EPOCH}) / period AS turn, (t - (a + b) / 2) / (b - a) * 2 AS u FROM e, p, s), v AS (SELECT period, y, w, [{', '.join(_V)}] AS v FROM d),
m AS (SELECT period, count(*) AS n, sum(w * y * y) AS yy, {', '.join('[' + ', '.join([*[f'sum(w * v[{i}] * v[{j}])' for j in range(1, 9)], f'sum(w * v[{i}] * y)']) + f'] AS q{i}' for i in range(1, 9))} FROM v GROUP BY period),
{least_squares(8, "m")},
c AS (SELECT m.period, m.n - 8 AS dof, (m.yy - ({' + '.join(f'x{i} * m.q{i}[9]' for i in range(1, 9))})) / (m.n - 8) AS chi2, x1, x2 FROM b1 JOIN m USING (period))
SELECT period, round(chi2, 6) AS reduced_chi2, dof, round(x1, 6) AS c1, round(x2, 6) AS s1, chi2 = min(chi2) OVER () AS best FROM c
""")
def fit_ephemeris(spark, sf):
    """Four trial periods over all events; less than one knot spacing of time, so the spline is a cubic."""
    f = series_fits.fit_ephemeris(_curve(spark, sf), _PERIODS, "jd", "mag", "err")
    return f.select("period", r6(F.col("chi2") / F.col("dof")).alias("reduced_chi2"), "dof", r6(F.col("amplitudes")[0]).alias("c1"), r6(F.col("amplitudes")[1]).alias("s1"), "best")


@query("likelihood_scan")
def likelihood_scan(spark, sf):
    """Best eruption of every user's series; a search over hypotheses that tests hold against plain loops."""
    p = timeseries.envelope(_plates(spark, sf), ["user_id"], 4.0)
    return series_fits.likelihood_scan(p.withColumn("sig", F.lit(0.3)).withColumn("sat", F.lit(False)), "user_id", 4.0)
