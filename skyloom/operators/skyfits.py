"""Fits over sky maps beyond least squares: Poisson likelihood, and residuals held against a conformal limit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions import missing, sphere

STEPS = 60
DIPOLE = "ln_n double, x double, y double, z double, amplitude double, log_likelihood double, score_norm double, n_pixels long, steps int, converged boolean"


def poisson_dipole(maps: DataFrame, count: str = "count", selection: str = "coverage", tolerance: float = 1e-10) -> DataFrame:
    """One row: the likeliest mu = s N (1 + A n) over pixels with a positive selection s, counts being Poisson.

    With b = N A the mean is linear in (N, b), so the log-likelihood is concave and Newton's
    steps reach its only maximum; steps that would make a mean negative or lose likelihood are
    halved. A step is one aggregation of fifteen sums over the pixels. score_norm is the
    gradient's length in units of its curvature, at the result. Counts of a map without any
    source, or fewer than four pixels, give no fit and no row.
    """
    spark = maps.sparkSession
    good = missing.is_finite(F.col(count)) & missing.is_finite(F.col(selection)) & (F.col(selection) > 0)
    x = [F.lit(1.0), *sphere.unit_vector(F.col("lon"), F.col("lat"))]
    rows = maps.where(good).select(F.col(count).cast("double").alias("k"), F.col(selection).cast("double").alias("s"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"), F.sum("s").alias("s")).first()
    if total.n < 4 or not total.k:
        return spark.createDataFrame([], DIPOLE)

    def at(theta: np.ndarray):
        mu = F.col("s") * sum((float(t) * F.col(f"x{i}") for i, t in enumerate(theta)), F.lit(0.0))
        own = rows.withColumn("mu", mu)
        first = [F.sum((F.col("k") / F.col("mu") - 1) * F.col("s") * F.col(f"x{i}")) for i in range(4)]
        second = [F.sum(F.col("k") * F.pow(F.col("s") / F.col("mu"), 2) * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(4) for j in range(i, 4)]
        r = own.agg(F.min("mu").alias("least"), F.sum(F.when(F.col("mu") > 0, F.col("k") * F.log("mu") - F.col("mu"))).alias("l"), F.array(*first, *second).alias("m")).first()
        if not r.least > 0:
            return None
        h, values = np.zeros((4, 4)), iter(r.m[4:])
        for i in range(4):
            for j in range(i, 4):
                h[i, j] = h[j, i] = next(values)
        return r.l, np.asarray(r.m[:4]), h

    theta = np.array([total.k / total.s, 0.0, 0.0, 0.0])
    here, steps, converged = at(theta), 0, False
    while steps < STEPS:
        likelihood, g, h = here
        step = np.linalg.lstsq(h, g, rcond=None)[0]
        if float(g @ step) < tolerance:
            converged = True
            break
        size, new = 1.0, None
        while size > 1e-6 and steps < STEPS:
            steps += 1
            new = at(theta + size * step)
            if new is not None and new[0] >= likelihood:
                break
            size, new = size / 2, None
        if new is None:
            break
        theta, here = theta + size * step, new
    likelihood, g, h = here
    a = theta[1:] / theta[0]
    norm = float(np.sqrt(max(0.0, g @ np.linalg.lstsq(h, g, rcond=None)[0])))
    return spark.createDataFrame([(float(np.log(theta[0])), *map(float, a), float(np.linalg.norm(a)), float(likelihood), norm, total.n, steps, converged)], DIPOLE)


def conformal_residuals(maps: DataFrame, ln_n: float, beta: tuple[float, float, float], kinematic: float, gamma: float = 1.0, alpha: float = 0.05, count: str = "count", selection: str = "coverage") -> tuple[DataFrame, DataFrame]:
    """Pixels with their expected count, Pearson residual and whether it is beyond the conformal limit; and a summary row.

    Expected count: e^ln_n s^gamma (1 + kinematic beta n). The limit is the linearly
    interpolated quantile of absolute residuals at ceil((n + 1)(1 - alpha)) / n, at most 1:
    two neighbouring order statistics, found over ranges of values, not in one task.
    """
    from skyloom.operators.calibration import cumulated

    direction = sum((float(b) * c for b, c in zip(beta, sphere.unit_vector(F.col("lon"), F.col("lat")), strict=True)), F.lit(0.0))
    mu = float(np.exp(ln_n)) * F.pow(selection, F.lit(gamma)) * (1 + kinematic * direction)
    own = maps.where(F.col(selection) > 0).withColumn("expected", mu)
    own = own.withColumn("residual", (F.col(count) - F.col("expected")) / F.sqrt(F.greatest(F.col("expected"), F.lit(1e-6))))
    size = F.abs(F.col("residual"))
    counts = own.select(size.alias("r")).groupBy("r").agg(F.count(F.lit(1)).alias("c"))
    n = counts.agg(F.sum("c").alias("n")).first().n
    if not n:
        return own.withColumn("anomalous", F.lit(False)), maps.sparkSession.createDataFrame([], "n_pixels long, threshold double, n_anomalous long, fraction double, largest double, mean double")
    level = min(max(np.ceil((n + 1) * (1 - alpha)) / n, 0.0), 1.0) * (n - 1)
    low = int(np.floor(level))
    placed = cumulated(counts, "r", {"c": "upto"})
    ends = placed.agg(F.min(F.when(F.col("upto") > low, F.col("r"))).alias("a"), F.min(F.when(F.col("upto") > min(low + 1, n - 1), F.col("r"))).alias("b")).first()
    threshold = ends.a + (level - low) * (ends.b - ends.a)
    own = own.withColumn("anomalous", F.abs(F.col("residual")) > threshold)
    summary = own.agg(F.count(F.lit(1)).alias("n_pixels"), F.lit(float(threshold)).alias("threshold"), F.count_if("anomalous").alias("n_anomalous"), (F.count_if("anomalous") / F.count(F.lit(1))).alias("fraction"), F.max(size).alias("largest"), F.avg(size).alias("mean"))
    return own, summary
