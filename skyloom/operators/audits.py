"""Audits of decisions: scores of candidates against an alert, scrambled nulls, empty fields, rewarded abstention."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import sphere
from skyloom.operators.resample import draw_uniform


def sky_density_at(ra: str, dec: str, ra0: float, dec0: float, area_90: float) -> Column:
    """Probability per square degree of a round Gaussian whose 90 % area is given, no narrower than 0.1 degrees."""
    sigma = max(math.sqrt(max(area_90, 1.0) / math.pi) / 2.146, 0.1)
    apart = sphere.separation(F.col(ra), F.col(dec), F.lit(float(ra0)), F.lit(float(dec0)))
    return F.exp(-0.5 * F.pow(apart / sigma, 2)) / (2 * math.pi * sigma**2)


def distance_agreement(distance: str, error: str, mean: float, std: float) -> tuple[Column, Column]:
    """Chi-square of a host's distance against the alert's, and its likelihood with chi-square held at 50."""
    variance = F.greatest(F.lit(std**2) + F.pow(error, 2), F.lit(1.0))
    chi2 = F.pow(F.col(distance) - mean, 2) / variance
    return chi2, F.exp(-0.5 * F.least(chi2, F.lit(50.0)))


def candidate_match(candidates: DataFrame, alert: dict[str, float]) -> DataFrame:
    """Candidates with density, chi2 and likelihood against one alert (ra, dec, area_90, distance, distance_std).

    Without a host distance chi2 and likelihood are missing.
    """
    chi2, like = distance_agreement("host_distance", "host_distance_err", alert["distance"], alert["distance_std"])
    density = sky_density_at("ra", "dec", alert["ra"], alert["dec"], alert["area_90"])
    return candidates.withColumn("density", density).withColumn("chi2", chi2).withColumn("likelihood", like)


def scrambled(candidates: DataFrame, trigger_mjd: float, draws: int, seed: int = 42, id: str = "candidate_id") -> DataFrame:
    """Every candidate in each draw 1..draws at a random place and time: uniform on the sphere, found within 30 days of the trigger, last seen 31 to 60 days after.

    The association with a host is broken. Everything depends on seed, draw and the whole number id alone.
    """
    u = lambda k: draw_uniform(seed, F.col("draw"), F.col(id).cast("long") * 4 + k)
    own = candidates.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    new = {"ra": 360 * u(0), "dec": F.degrees(F.asin(2 * u(1) - 1)), "discovery_mjd": trigger_mjd - 30 + 60 * u(2), "last_mjd": trigger_mjd + 31 + 29 * u(3)}
    new |= {c: F.lit(None).cast("double") for c in ("host_distance", "host_distance_err") if c in candidates.columns}
    return own.withColumns(new)


def scrambling_test(candidates: DataFrame, score: Column, trigger_mjd: float, draws: int = 500, seed: int = 42, id: str = "candidate_id") -> DataFrame:
    """One row: the greatest observed score against the greatest of each scrambled draw, and the p-value (exceedances + 1) / (draws + 1).

    A task passes on one maximum a draw; the draws of its candidates are made and scored row by
    row. A missing score counts as 0, as do no candidates at all.
    """
    value = F.coalesce(score, F.lit(0.0))
    observed = candidates.agg(F.coalesce(F.max(value), F.lit(0.0)).alias("observed"))
    tops = scrambled(candidates, trigger_mjd, draws, seed, id).groupBy("draw").agg(F.max(value).alias("top"))
    every = candidates.sparkSession.range(1, draws + 1).withColumnRenamed("id", "draw").join(F.broadcast(tops), "draw", "left").withColumn("top", F.coalesce("top", F.lit(0.0)))
    found = every.join(F.broadcast(observed)).groupBy("observed").agg(F.avg("top").alias("null_mean"), F.stddev_pop("top").alias("null_std"), F.count_if(F.col("top") >= F.col("observed")).alias("exceedances"))
    p = (F.col("exceedances") + 1.0) / (draws + 1.0)
    return found.select(F.lit(draws).alias("draws"), "observed", "null_mean", "null_std", "exceedances", p.alias("p_value"), (p < 0.01).alias("significant"))


def empty_field_audit(decisions: DataFrame, field: str, trigger: Column, risk: float) -> DataFrame:
    """One row over fields without a true counterpart: any trigger makes a field a false discovery; the rate of such fields is held against the risk.

    Fields without candidates can't be in decisions and must be added by the caller.
    """
    fields = decisions.groupBy(field).agg(F.count(F.lit(1)).alias("n"), F.count_if(trigger).alias("t"))
    out = fields.agg(F.count(F.lit(1)).alias("n_fields"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_candidates"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_triggers"), F.count_if(F.col("t") > 0).alias("false_fields"))
    rate = F.col("false_fields") / F.greatest(F.col("n_fields"), F.lit(1))
    return out.select("*", (F.col("n_triggers") / F.greatest(F.col("n_candidates"), F.lit(1))).alias("false_alarm_rate"), rate.alias("fdr"), (rate <= risk).alias("satisfied"))


def abstention_reward(sources: DataFrame, decisions: DataFrame, truth: DataFrame, w_correct: float = 1.0, w_abstain: float = 0.0, w_wrong: float = 2.0, id: str = "source_id", klass: str = "class", action: str = "action") -> DataFrame:
    """One row: reward per source of decisions that were asserted rightly, abstained from, or asserted wrongly.

    sources has every source once, decisions a row for each source and queue, if any; a source in several queues is one source, and
    abstains once however many follow-ups it has. Asserted sources without a known truth count
    neither way. truth has one class per id.
    """
    known = sources.select(id).join(decisions.select(id, klass, action), id, "left").join(truth.select(F.col(id), F.col(klass).alias("__true")), id, "left")
    asserted = F.col(action) == "AUTO_CATALOG"
    by_source = known.groupBy(id).agg(
        F.count_if(asserted).alias("a"), F.count_if(asserted & (F.col(klass) == F.col("__true"))).alias("right"), F.count_if(asserted & (F.col(klass) != F.col("__true"))).alias("wrong"),
        F.max(F.when(F.col(action).isin("SCHEDULE_FOLLOWUP_QUERY", "CONTRACTIVE_DELIBERATION"), 1).otherwise(0)).alias("waits"),
    )
    out = by_source.agg(F.count(F.lit(1)).alias("n_total"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("a", "n_auto"), ("right", "n_correct"), ("waits", "n_abstain"), ("wrong", "n_wrong"))])
    n = F.greatest(F.col("n_total"), F.lit(1))
    reward = (w_correct * F.col("n_correct") + w_abstain * F.col("n_abstain") - w_wrong * F.col("n_wrong")) / n
    return out.select("n_total", "n_correct", "n_abstain", "n_wrong", reward.alias("truthfulness"), (F.col("n_correct") / F.greatest(F.col("n_auto"), F.lit(1))).alias("accuracy"), (F.col("n_abstain") / n).alias("abstention_rate"), (F.col("n_wrong") / n).alias("wrong_rate"))
