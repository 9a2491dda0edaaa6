"""Feature vectors of bursts and of transient candidates against an alert, as arrays of twelve doubles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import photometry, scores, sphere
from skyloom.operators.audits import candidate_match

BURST = ("log_dm", "log_dm_ne", "log_dm_ymw", "model_difference", "sin_b", "log_scatter", "log_width", "log_flux", "log_fluence", "snr", "scatter_excess", "redshift")
CANDIDATE = ("log_density", "chi2", "log_mass", "coincidence", "rate_r", "rate_g", "colour", "colour_rate", "extinction", "fading", "host_offset", "snr")
#: What a candidate without a host is given.
NO_HOST = {"chi2": 12.0, "log_mass": 9.5}


def _log(column: str, least: float) -> Column:
    return F.log10(F.greatest(F.col(column), F.lit(least)))


def burst_features(df: DataFrame) -> DataFrame:
    """Adds features, in the order of BURST, of dm, dm_ne, dm_ymw, glat, scat_ms, width_ms, flux_jy, fluence_jyms and snr. A missing input makes its features missing."""
    ne, ymw = F.greatest(F.col("dm_ne"), F.lit(0.0)), F.greatest(F.col("dm_ymw"), F.lit(0.0))
    scatter = _log("scat_ms", 1e-4)
    features = [
        _log("dm", 1.0), _log("dm_ne", 1.0), _log("dm_ymw", 1.0), F.abs(ne - ymw) / F.greatest(F.col("dm"), F.lit(1.0)), F.sin(F.radians(F.abs("glat"))), scatter, _log("width_ms", 0.05), _log("flux_jy", 0.01),
        _log("fluence_jyms", 0.05), F.least(F.col("snr"), F.lit(100.0)) / 20.0, scores.clip(scatter - F.log10(photometry.scattering_ms(F.col("dm"))), -5.0, 5.0), F.least(photometry.dispersion_redshift(ne), F.lit(4.0)),
    ]
    sources = [["dm"], ["dm_ne"], ["dm_ymw"], ["dm", "dm_ne", "dm_ymw"], ["glat"], ["scat_ms"], ["width_ms"], ["flux_jy"], ["fluence_jyms"], ["snr"], ["scat_ms", "dm"], ["dm_ne"]]
    present = lambda own: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in own])
    known = [F.when(present(own), f) for f, own in zip(features, sources, strict=True)]
    return df.withColumn("features", F.array(*[f.cast("double") for f in known]))


def candidate_features(df: DataFrame, alert: dict[str, float]) -> DataFrame:
    """Adds features, in the order of CANDIDATE, of candidates against one alert.

    Columns: ra, dec, host_distance, host_distance_err, log_mass (missing without a host), coincidence (missing: 0), rate_r,
    rate_g, colour, colour_rate, limit, mag_r, mag_err_r, host_offset.
    """
    own = candidate_match(df, alert)
    dust = photometry.extinction(sphere.latitude_from_pole(F.col("ra"), F.col("dec")))
    hosted = F.col("host_distance").isNotNull()
    features = [
        F.log10(F.greatest(F.col("density"), F.lit(1e-8))), F.least(F.when(hosted, F.col("chi2")).otherwise(NO_HOST["chi2"]), F.lit(50.0)), F.when(hosted, F.col("log_mass")).otherwise(NO_HOST["log_mass"]), F.coalesce("coincidence", F.lit(0.0)),
        F.col("rate_r"), F.col("rate_g"), F.col("colour") - 0.35 * dust, F.col("colour_rate"), dust, F.col("limit") - F.col("mag_r"), F.col("host_offset"), 1.0857 / F.greatest(F.col("mag_err_r"), F.lit(0.01)),
    ]
    return own.withColumn("features", F.array(*[f.cast("double") for f in features])).drop("density", "chi2", "likelihood")
