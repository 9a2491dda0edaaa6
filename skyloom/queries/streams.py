"""Queries that run as streams: their input is read by readStream and their state outlives a restart."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.queries.registry import micros, query, table
from skyloom.sources.shared import fresh_path
from skyloom.streaming import tallies

_HOUR = 3_600_000_000
#: An event arrives up to 99 hours after its time; arrivals of ten days come together.
_ARRIVES = "floor((epoch_us(ts) - 1704067200000000 + (event_id * 7919) % 100 * 3600000000) / 864000000000)"


@query("late_tallies", f"""
WITH e AS (SELECT user_id AS key, epoch_us(ts) AS t, round(value * 100)::BIGINT AS v, {_ARRIVES} AS batch FROM events),
w AS (SELECT *, t // {6 * _HOUR} * {6 * _HOUR} AS start, max(t) OVER (PARTITION BY key) AS last, max(t) OVER (PARTITION BY key ORDER BY batch RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e),
l AS (SELECT *, coalesce(start + {6 * _HOUR} <= seen - {24 * _HOUR}, false) AS late FROM w)
SELECT key, start, start + {6 * _HOUR} AS "end", count(*) FILTER (NOT late) AS n, coalesce(sum(v) FILTER (NOT late), 0)::BIGINT AS total, any_value(start + {6 * _HOUR} <= last - {24 * _HOUR}) AS closed,
 count(*) FILTER (late) AS n_late, coalesce(sum(v) FILTER (late), 0)::BIGINT AS late_total FROM l GROUP BY key, start
""")
def late_tallies(spark, sf):
    """Six-hour tallies by user over events that arrive out of order, with a day's delay.

    The arrivals of each ten days are laid into a folder, and the stream is started again from its checkpoint for each.
    """
    e = table(spark, sf, "events")
    arrives = F.floor((micros() - 1704067200000000 + (F.col("event_id") * 7919) % 100 * _HOUR) / 864000000000)
    rows = e.select("user_id", micros().alias("t"), F.round(F.col("value") * 100).cast("long").alias("v"), arrives.alias("batch"))
    inbox, out, checkpoint = (fresh_path(spark, x) for x in ("inbox", "tallies", "tallies-checkpoint"))
    first, last = e.select(arrives.alias("b")).agg(F.min("b"), F.max("b")).first()
    for batch in range(first, last + 1) if first is not None else []:
        rows.where(F.col("batch") == batch).drop("batch").write.mode("append").parquet(inbox)
        stream = tallies.tallies(tallies.arrived(spark, inbox, rows.drop("batch").schema), "user_id", "t", "v", 6 * _HOUR, 24 * _HOUR)
        tallies.start(stream, out, checkpoint).awaitTermination()
    written = spark.read.schema("key long, start long, status string, n long, total long, revision long").parquet(out) if first is not None else spark.createDataFrame([], "key long, start long, status string, n long, total long, revision long")
    return tallies.settled(written, 6 * _HOUR)


@query("stream_closed_windows", """
SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start, event_type, count(*) AS n FROM events
WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY 1, 2
""")
def stream_closed_windows(spark, sf):
    """Daily counts by type of the events, read as a stream; days that may still change at its end are not given."""
    e = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    out, checkpoint = fresh_path(spark, "windows"), fresh_path(spark, "windows-checkpoint")
    tallies.start(tallies.closed_windows(e, "ts", "1 day", "2 days", ["event_type"]), out, checkpoint).awaitTermination()
    return spark.read.schema("start timestamp, end timestamp, event_type string, n long").parquet(out).select(F.unix_micros("start").alias("start"), "event_type", "n")
