"""Alert streams: a simulator, replay of files, triage of each alert, counts and sinks.

The same functions work on batch and streaming frames. Watermarks, windows and
deduplication bound the state of unbounded streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skyloom.operators import decide
from skyloom.operators.skymap import uniform

ALERT = (
    "alert_id string, ra double, dec double, mag double, mag_err double, filter_band string, features array<float>, "
    "timestamp timestamp, survey string, metadata map<string,string>"
)


def replay(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Alerts from JSON files as they arrive in a folder."""
    return spark.readStream.schema(ALERT).option("maxFilesPerTrigger", files_per_batch).json(folder)


def simulate(numbers: DataFrame, seed: int = 0, id: str = "value", ts: str = "timestamp") -> DataFrame:
    """Alerts from sequence numbers: positions uniform on the sphere, four archetypes (60, 25, 10 and 5 percent).

    Every value depends on seed and number alone.
    """
    u = lambda k: uniform(F.lit(seed), F.lit(k), F.col(id))
    kind = F.when(u(0) < 0.60, "star").when(u(0) < 0.85, "quasar").when(u(0) < 0.95, "galaxy").otherwise("transient")
    return numbers.select(
        F.concat(F.lit("SIM"), F.lpad(F.col(id).cast("string"), 10, "0")).alias("alert_id"), (u(1) * 360).alias("ra"), F.degrees(F.asin(2 * u(2) - 1)).alias("dec"),
        (16 + 6 * u(3)).alias("mag"), (0.02 + 0.1 * u(4)).alias("mag_err"), F.lit("r").alias("filter_band"), kind.alias("archetype"),
        F.array(*[(1 + 8 * F.pow(u(5 + k), 4)) for k in range(4)]).alias("alpha"), (0.2 * u(9)).alias("tension"), F.col(ts).alias("timestamp"), F.lit("simulator").alias("survey"),
    )


def rate_source(spark: SparkSession, rows_per_second: int = 10) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def triage(alerts: DataFrame, names: list[str], alpha: str = "alpha") -> DataFrame:
    """Each alert with its evidence summaries, prediction set, validity and action."""
    own = decide.with_dirichlet(alerts, alpha, names)
    from skyloom.functions import scores

    own = own.withColumn("prediction_set", scores.conformal_set(F.col("probs"), F.array(*[F.lit(n) for n in names]), 0.80))
    return own.withColumn("errors", decide.packet_errors()).withColumn("action", F.when(F.size("errors") > 0, "QUARANTINE").otherwise(decide.alert_action()))


def once(alerts: DataFrame, delay: str = "10 minutes", ts: str = "timestamp") -> DataFrame:
    """Alerts without repeats of an id within the watermark's delay."""
    marked = alerts.withWatermark(ts, delay)
    return marked.dropDuplicatesWithinWatermark(["alert_id"]) if alerts.isStreaming else marked.dropDuplicates(["alert_id"])


def action_counts(decisions: DataFrame) -> DataFrame:
    """Running number of decisions and mean confidence per action."""
    return decisions.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"))


def windowed_counts(decisions: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes", ts: str = "timestamp") -> DataFrame:
    """Decisions per action and time window; rows later than the delay are left out of a stream."""
    window: Column = F.window(ts, width, slide) if slide else F.window(ts, width)
    return decisions.withWatermark(ts, delay).groupBy(window.alias("w"), "action").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "action", "n")


def sessions(alerts: DataFrame, gap: str, key: str, delay: str = "10 minutes", ts: str = "timestamp") -> DataFrame:
    """Sessions of a key's alerts that are less than gap apart."""
    return alerts.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, "w.start", "w.end", "n")


def to_json(decisions: DataFrame, folder: str, checkpoint: str, once_only: bool = True) -> StreamingQuery:
    """Appends decisions as JSON lines, exactly once per checkpoint."""
    w = decisions.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once_only else w).start()
