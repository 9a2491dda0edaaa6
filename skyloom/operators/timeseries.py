"""Light curves: nightly bins, running envelopes, sessions, eruption scans and levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.functions import missing

DAY = 1 / 365.25  # in Julian years


def nightly_bins(df: DataFrame, keys: list[str], jd: str = "jd", mag: str = "mag", err: str = "err", floor: float = 0.02, clip: float = 0.5) -> DataFrame:
    """Robust nightly medians: points within clip of the night's median, or all if none is."""
    own = df.where(missing.is_finite(F.col(jd)) & missing.is_finite(F.col(mag))).withColumn("night", F.floor(jd))
    night = W.partitionBy(*keys, "night")
    own = own.withColumn("__m", F.percentile(mag, F.lit(0.5)).over(night)).withColumn("__near", F.abs(F.col(mag) - F.col("__m")) < clip)
    own = own.withColumn("__any", F.max("__near").over(night)).where("__near OR NOT __any")
    own = own.withColumn("__m2", F.percentile(mag, F.lit(0.5)).over(night))
    n = F.count(F.lit(1))
    scatter = F.when(n > 2, 1.4826 * F.percentile(F.abs(F.col(mag) - F.col("__m2")), F.lit(0.5))).otherwise(0.0)
    quoted = F.coalesce(F.percentile(missing.finite_or_null(F.col(err)), F.lit(0.5)), F.lit(0.05))
    root = F.sqrt(n.cast("double"))
    return own.groupBy(*keys, "night").agg(F.avg(jd).alias("jd"), F.percentile(mag, F.lit(0.5)).alias("mag"), F.greatest(scatter / root, quoted / root, F.lit(floor)).alias("err"), n.alias("n"))


def fixed_bins(df: DataFrame, keys: list[str], t: str, value: str, start: float, width: float, least: int = 2) -> DataFrame:
    """Median and its MAD error in bins of fixed width with enough points."""
    own = df.withColumn("bin", F.floor((F.col(t) - start) / width)).withColumn("__m", F.percentile(value, F.lit(0.5)).over(W.partitionBy(*keys, "bin")))
    n = F.count(F.lit(1))
    return own.groupBy(*keys, "bin").agg(F.percentile(value, F.lit(0.5)).alias("median"), (1.4826 * F.percentile(F.abs(F.col(value) - F.col("__m")), F.lit(0.5)) / F.sqrt(n.cast("double"))).alias("error"), n.alias("n")).where(F.col("n") >= least)


def envelope(df: DataFrame, keys: list[str], faint: float, half_days: float = 500.0, t: str = "t", mag: str = "mag", det: str = "det", lim: str = "lim") -> DataFrame:
    """Running median level within [t - h, t + h) by time; limits enter as the fainter of themselves and faint.

    Series of fewer than ten usable points and windows of fewer than five have the level faint.
    """
    h = half_days * DAY
    value = F.when(F.col(det), missing.finite_or_null(F.col(mag))).otherwise(F.greatest(F.coalesce(missing.finite_or_null(F.col(lim)), F.lit(faint)), F.lit(faint)))
    own = df.withColumn("__v", value)
    # A range frame is closed; ending it one step short of t + h leaves the upper end out.
    part = ", ".join(f"`{k}`" for k in keys)
    frame = f"(PARTITION BY {part} ORDER BY `{t}` RANGE BETWEEN {h!r}D PRECEDING AND {h * (1 - 1e-12)!r}D FOLLOWING)"
    whole = F.count("__v").over(W.partitionBy(*keys))
    level, near = F.expr(f"percentile(__v, 0.5D) OVER {frame}"), F.expr(f"count(__v) OVER {frame}")
    return own.withColumn("envelope", F.when((whole >= 10) & (near >= 5), level).otherwise(F.lit(faint))).drop("__v")


def sessions(df: DataFrame, keys: list[str], t: str, gap: float) -> DataFrame:
    """Number of each row's session; a new one begins where more than gap has passed."""
    order = W.partitionBy(*keys).orderBy(t)
    new = F.when(F.col(t) - F.lag(t).over(order) > gap, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn("session", F.sum("__new").over(order)).drop("__new")


def night_count(df: DataFrame, keys: list[str], t_years: str) -> DataFrame:
    """Distinct observing nights: clusters of epochs more than half a day apart."""
    own = sessions(df.withColumn("__d", F.col(t_years) * 365.25), keys, "__d", 0.5)
    return own.groupBy(*keys).agg((F.max("session") + 1).alias("nights"), F.count(F.lit(1)).alias("points"))


def eruption_scan(df: DataFrame, keys: list[str], threshold: float = 1.0, gap_days: float = 200.0, t: str = "t", mag: str = "mag", det: str = "det", level: str = "envelope") -> DataFrame:
    """Best cluster of bright points per key: the second largest excess over the envelope, on at least two nights."""
    bright = df.where(F.col(det) & (F.col(mag) < F.col(level) - threshold)).withColumn("__d", F.col(t) * 365.25)
    own = sessions(bright, keys, "__d", gap_days).withColumnRenamed("session", "cluster")
    own = sessions(own, [*keys, "cluster"], "__d", 0.5)
    own = own.withColumn("__excess", F.col(level) - F.col(mag)).withColumn("__k", F.row_number().over(W.partitionBy(*keys, "cluster").orderBy(F.desc("__excess"))))
    found = own.groupBy(*keys, "cluster").agg(F.max(F.when(F.col("__k") == 2, F.col("__excess"))).alias("score"), F.min(t).alias("t0"), (F.max("session") + 1).alias("nights"), F.count(F.lit(1)).alias("plates"), F.min(mag).alias("peak"))
    best = found.where("nights >= 2").groupBy(*keys).agg(F.max(F.struct("score", (-F.col("t0")).alias("s"), "t0", "nights", "plates", "peak")).alias("b"))
    return best.select(*keys, "b.score", "b.t0", "b.nights", "b.plates", "b.peak")


def mean_level(df: DataFrame, keys: list[str], low: float, high: float, t: str = "t", mag: str = "mag") -> DataFrame:
    """Mean, its standard error and number of detections in [low, high); NULL for fewer than three."""
    own = df.where((F.col(t) >= low) & (F.col(t) < high) & missing.is_finite(F.col(mag))).groupBy(*keys).agg(F.count(mag).alias("n"), F.avg(mag).alias("m"), F.stddev_samp(mag).alias("s"))
    return own.select(*keys, "n", F.when(F.col("n") >= 3, F.col("m")).alias("mean"), F.when(F.col("n") >= 3, F.col("s") / F.sqrt(F.col("n").cast("double"))).alias("sem"))


def transit_windows(df: DataFrame, start: float, count: int, t0: str = "t0", period: str = "period", duration: str = "duration") -> DataFrame:
    """The next count transits at or after start of each object."""
    first = F.ceil((F.lit(start) - F.col(t0)) / F.col(period))
    own = df.withColumn("epoch", F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: first + k)))
    mid = F.col(t0) + F.col("epoch") * F.col(period)
    return own.withColumn("mid", F.round(mid, 5)).withColumn("ingress", F.round(mid - F.col(duration) / 2, 5)).withColumn("egress", F.round(mid + F.col(duration) / 2, 5))


def upcoming(df: DataFrame, first: str, last: str, start: str = "start", end: str = "end") -> DataFrame:
    """Open events that overlap the days from first to last, both included."""
    return df.where((F.col(start) <= F.lit(last).cast("date")) & (F.coalesce(end, start) >= F.lit(first).cast("date")))


def quiescent(df: DataFrame, keys: list[str], middle: str, half: float, faint: float, t: str = "t", mag: str = "mag", det: str = "det", lim: str = "lim") -> DataFrame:
    """Median level within half of each key's middle; limits enter as the fainter of themselves and faint.

    Of two middle values the lower one is taken; missing values don't count.
    """
    value = F.when(F.col(det), F.col(mag)).otherwise(F.greatest(F.col(lim), F.lit(faint)))
    return df.where(F.abs(F.col(t) - F.col(middle)) <= half).select(*keys, value.alias("__v")).groupBy(*keys).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY __v)").alias("level"))


def level_step(df: DataFrame, keys: list[str], begin: str, end: str, span_days: float = 200.0, t: str = "t", mag: str = "mag", det: str = "det", lim: str = "lim") -> DataFrame:
    """Median after an event less the median before it, over span_days each; limits count as they are. NULL with fewer than three rows on a side.

    The last five days before the event are left out.
    """
    value, at = F.when(F.col(det), F.col(mag)).otherwise(F.col(lim)), F.col(t)
    before = at.between(F.col(begin) - span_days * DAY, F.col(begin) - 5 * DAY)
    after = at.between(F.col(end), F.col(end) + span_days * DAY)
    level = lambda side: F.when(F.count(F.when(side, 1)) >= 3, F.percentile(F.when(side, value), F.lit(0.5)))
    return df.groupBy(*keys).agg((level(after) - level(before)).alias("step"))


def running_median(df: DataFrame, keys: list[str], order: list[str], value: str, half: int = 15) -> DataFrame:
    """Median of the half rows before a row, itself and the half - 1 rows after it, within its key."""
    part, by = ", ".join(f"`{k}`" for k in keys), ", ".join(f"`{c}`" for c in order)
    return df.withColumn("running", F.expr(f"percentile(`{value}`, 0.5D) OVER (PARTITION BY {part} ORDER BY {by} ROWS BETWEEN {half} PRECEDING AND {half - 1} FOLLOWING)"))


def grid_quantiles(df: DataFrame, keys: list[str], x: str, density: str, levels: list[float]) -> DataFrame:
    """The least x of an evenly spaced grid at which the cumulated, normalised density reaches each level."""
    own = df.withColumn("__c", F.sum(density).over(W.partitionBy(*keys).orderBy(x))).withColumn("__s", F.sum(density).over(W.partitionBy(*keys)))
    return own.groupBy(*keys).agg(*[F.min(F.when(F.col("__c") >= q * F.col("__s"), F.col(x))).alias(f"q{round(100 * q)}") for q in levels])
