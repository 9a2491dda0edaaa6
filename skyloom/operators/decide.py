"""Decisions: ordered rule gates, routing of sources, packet checks and feature packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import missing, scores


def first_match(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """Action of the first rule that holds; unknown conditions don't hold."""
    out = None
    for test, action in rules:
        out = F.when(test, action) if out is None else out.when(test, action)
    return out.otherwise(otherwise)


def with_dirichlet(df: DataFrame, alpha: str, names: list[str]) -> DataFrame:
    """Summaries of an evidence array: probabilities, class, confidence and its error, vacuity, information gain."""
    a = F.col(alpha)
    df = df.withColumn("probs", scores.normalise(a)).withColumn("top", scores.argmax(F.col("probs")))
    df = df.withColumn("confidence", F.array_max("probs")).withColumn("error", scores.dirichlet_error(a, F.col("confidence")))
    return df.withColumn("vacuity", scores.vacuity(a)).withColumn("gain", scores.information_gain(a)).withColumn("class", F.get(F.array(*[F.lit(n) for n in names]), F.col("top")))


# The thresholds and action names of the five gates below are fixed values.
def alert_action(gain: float = 0.35, level: float = 0.80) -> Column:
    """Four-way gate of the alert stream over gain, top, vacuity, error, confidence and tension."""
    low = scores.clip(F.col("confidence") - 1.96 * F.col("error"), 0.0, 1.0)
    doubtful = (F.col("top") == 0) & ((F.col("vacuity") >= 0.35) | (F.col("error") >= 0.12))
    return first_match([
        ((F.col("gain") >= gain) | doubtful, "URGENT_FOLLOWUP"),
        ((F.col("confidence") >= level) & (F.col("vacuity") <= 0.25) & (F.col("tension") <= 0.12) & (low >= 0.50), "AUTO_CATALOG"),
        (F.col("tension") >= 0.15, "EXTEND_DELIBERATION"),
    ], "PASS_DEFER")


def counterpart_action(level: float = 0.85) -> Column:
    """Gate of gravitational-wave counterparts over p_kn, its error, vacuity, gain, class, confidence and error."""
    p, e = F.col("p_kn"), F.col("p_kn_error")
    low = scores.clip(p - 1.96 * e, 0.0, 1.0)
    supernova = F.col("class").isin("Supernova_Ia", "Core_Collapse_SN") & (F.col("confidence") >= 0.80) & (F.col("error") <= 0.15)
    screening = (p >= 0.40) | (F.col("gain") >= 0.25) | ((p >= 0.25) & ((F.col("vacuity") >= 0.40) | (e >= 0.12)))
    return first_match([((p >= level) & (F.col("vacuity") <= 0.35) & (low >= 0.40), "GEMINI_RAPID_TOO"), (screening, "LCOGT_SCREENING_TOO"), (supernova, "AUTO_CATALOG_SNE")], "PASS_DEFER")


def burst_action(level: float = 0.85) -> Column:
    """Gate of radio bursts over class, glat, p_cosmo, cosmo_low, vacuity and is_repeater."""
    return first_match([
        ((F.col("class") == "LOCAL_PLASMA_EXCESS") | (F.abs("glat") < 7.0), "FLAG_LOCAL_PLASMA_CONTAMINANT"),
        ((F.col("p_cosmo") >= level) & (F.col("vacuity") <= 0.58) & (F.col("cosmo_low") >= 0.15) & (F.abs("glat") >= 10.0), "COMMIT_8M_HOST_SPECTROSCOPY"),
        (F.col("is_repeater") | (F.col("vacuity") > 0.58) | (F.col("class") == "HOST_DOMINATED_BURST"), "MONITOR_RADIO_REPETITION"),
    ], "REJECT_RFI")


def planet_action(level: float = 0.85) -> Column:
    """Gate of transit candidates over p_exo, error, vacuity, rv_bis, prot_diff and odd_even."""
    low = scores.clip(F.col("p_exo") - 1.96 * F.col("error"), 0.0, 1.0)
    return first_match([
        ((F.col("p_exo") >= level) & (F.col("vacuity") <= 0.30) & (low >= 0.50) & (F.col("rv_bis") < 0.25) & (F.col("prot_diff") > 0.20), "COMMIT_ESPRESSO_RV"),
        ((F.col("rv_bis") >= 0.35) | (F.col("prot_diff") <= 0.15), "MONITOR_STELLAR_ROTATION"),
        ((F.col("odd_even") >= 2.0) | (F.col("vacuity") > 0.35) | (F.col("error") > 0.12), "ROBOTIC_1M_PHOTOMETRY"),
    ], "REJECT_FALSE_ALARM")


def weather_action(level: float = 0.85) -> Column:
    """Gate of space weather over p_storm, error, vacuity, p_impact and arc_hours."""
    return first_match([
        ((F.col("p_storm") >= level) & (F.col("vacuity") <= 0.30) & (F.col("p_storm") - 1.96 * F.col("error") >= 0.40), "TRIGGER_GLOBAL_SPACE_WEATHER_ALERT"),
        ((F.col("p_impact") > 0.05) & (F.col("arc_hours") < 4.0), "DISPATCH_PLANETARY_DEFENSE_RADAR"),
        (((F.col("p_impact") > 0.01) & (F.col("arc_hours") >= 4.0)) | (F.col("vacuity") > 0.40), "QUEUE_ROBOTIC_TRACKING"),
    ], "PASS_NOMINAL")


def route_sources(df: DataFrame, doubt_least: float = 0.35, purity_least: float = 0.5, tension_least: float = 0.12) -> DataFrame:
    """A row per source and queue: catalogued alone, or deliberated and/or followed up, or in no queue.

    Columns: class, confidence, purity, vacuity, tension, phot_g, w1_w2, pm, pm_err.
    """
    auto = (F.col("class") == "Quasar_AGN") & (F.col("confidence") >= 0.85) & (F.col("purity") >= purity_least) & (F.col("vacuity") <= 0.20)
    auto = F.coalesce(auto, F.lit(False))
    archive = first_match([((F.col("w1_w2") < 0.8) & (F.col("phot_g") <= 21.0), "MAST"), ((F.col("pm_err") >= 1.5) & (F.col("pm") < 3.0), "GAIA_EPOCH")], "HEASARC")
    gain = F.when(archive == "MAST", 0.82).when(archive == "GAIA_EPOCH", 0.74).otherwise(0.89)
    none = F.lit(None)
    queue = lambda name, where=none, expected=none: F.struct(F.lit(name).alias("action"), where.cast("string").alias("archive"), expected.cast("double").alias("expected_gain"))
    found = F.array_compact(F.array(
        F.when(auto, queue("AUTO_CATALOG")),
        F.when(~auto & (F.col("tension") >= tension_least), queue("CONTRACTIVE_DELIBERATION")),
        F.when(~auto & (F.col("vacuity") >= doubt_least), queue("SCHEDULE_FOLLOWUP_QUERY", archive, gain)),
    ))
    return df.select("*", F.inline(found))


def packet_errors(fields: tuple[str, ...] = ("alert_id", "ra", "dec", "mag", "mag_err", "filter_band")) -> Column:
    """Array of what is wrong with an alert packet; empty if nothing is. NULL is a missing field."""
    inside = lambda c, low, high: missing.is_finite(F.col(c)) & F.col(c).between(low, high)
    tests = [F.when(F.col(f).isNull(), F.lit(f"missing {f}")) for f in fields]
    tests += [F.when(F.col("ra").isNotNull() & ~inside("ra", 0, 360), F.lit("ra out of range")), F.when(F.col("dec").isNotNull() & ~inside("dec", -90, 90), F.lit("dec out of range"))]
    tests.append(F.when(F.col("mag").isNotNull() & ~(missing.is_finite(F.col("mag")) & (F.col("mag") > 0) & (F.col("mag") < 35)), F.lit("mag not physical")))
    return F.array_compact(F.array(*tests))


# Fixed values of the all-sky quasar catalogue's feature packets: what stands for a missing colour, blue colour,
# infrared colour, magnitude and motion; and the bounds of the estimated errors.
IMPUTED = {"colour": 0.6, "blue": -0.3, "infrared": 0.95, "faint": 20.0, "motion": 0.2, "w1_offset": -2.8}
SNR = {"scale": 100.0, "zero": 14.0, "low": 5.0, "high": 100.0}
ERRORS = {"optical": (1.0857, 0.005, 0.40), "colour": (1.414, 0.01, 0.50), "infrared": (0.05, 0.02, 14.0, 0.02, 0.35), "infrared_colour": (1.3, 0.03, 0.45), "last": 1.05}
MAGNITUDES = (5, 25)  # outside them a magnitude is missing


def feature_packet(df: DataFrame, imputed: dict[str, float] = IMPUTED) -> DataFrame:
    """Ten features, six errors and six validity flags of a photometric source, missing bands imputed.

    The defaults are those of the all-sky quasar catalogue; other catalogues pass their own.
    """
    known = lambda *names: F.coalesce(F.forall(F.array(*[F.col(n).cast("double") for n in names]), missing.is_finite), F.lit(False))
    seen = lambda name: known(name) & (F.col(name) > MAGNITUDES[0]) & (F.col(name) < MAGNITUDES[1])
    valid = {
        "g": seen("phot_g_mean_mag"), "colour": known("phot_bp_mean_mag", "phot_rp_mean_mag"), "w1": seen("mag_w1_vg"),
        "w1_w2": seen("mag_w1_vg") & seen("mag_w2_vg"), "pm": known("pm", "pmra_error", "pmdec_error"), "position": F.lit(True),
    }
    df = df.withColumn("mask", F.array(*[v.cast("double") for v in valid.values()]))
    or_else = lambda test, value, default: F.when(test, value).otherwise(default)
    g = or_else(valid["g"], F.col("phot_g_mean_mag"), F.lit(imputed["faint"]))
    w1 = or_else(valid["w1"], F.col("mag_w1_vg"), g + imputed["w1_offset"])
    snr = scores.clip(SNR["scale"] / F.greatest(g - SNR["zero"], F.lit(1.0)), SNR["low"], SNR["high"])
    pm_error = or_else(valid["pm"], F.hypot("pmra_error", "pmdec_error"), F.lit(imputed["motion"]))
    features = {
        "g": g,
        "bp_rp": or_else(valid["colour"], F.col("phot_bp_mean_mag") - F.col("phot_rp_mean_mag"), F.lit(imputed["colour"])),
        "g_bp": or_else(known("phot_bp_mean_mag"), g - F.col("phot_bp_mean_mag"), F.lit(imputed["blue"])),
        "w1": w1,
        "w1_w2": or_else(valid["w1_w2"], w1 - F.col("mag_w2_vg"), F.lit(imputed["infrared"])),
        "pm": or_else(valid["pm"], F.col("pm"), F.lit(imputed["motion"])),
        "pm_error": pm_error,
        "l": or_else(known("l"), F.col("l") / 360.0, F.lit(0.5)),
        "b": or_else(known("b"), (F.col("b") + 90.0) / 180.0, F.lit(0.5)),
        "snr": snr,
    }
    scale, low, high = ERRORS["optical"]
    optical = scores.clip(scale / F.greatest(snr, F.lit(1.0)), low, high)
    base, slope, zero, low, high = ERRORS["infrared"]
    infrared = scores.clip(base + slope * F.greatest(w1 - zero, F.lit(0.0)), low, high)
    wider = lambda x, kind: scores.clip(x * ERRORS[kind][0], *ERRORS[kind][1:])
    sigma = [optical, wider(optical, "colour"), infrared, wider(infrared, "infrared_colour"), pm_error, F.lit(ERRORS["last"])]
    return df.withColumn("mu", F.array(*features.values())).withColumn("sigma", F.array(*sigma))
