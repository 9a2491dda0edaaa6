"""Stateful tallies of unordered streams: windows by key, late rows kept apart, restart from a checkpoint.

Every key (a survey, a station) has a clock of its own: the newest time seen from it in
earlier micro-batches, less the allowed delay. A window that ends by the clock is
closed: its tally is final and leaves the state. A row of a closed window is late; it
is no error and isn't dropped, but counted beside the window's tally. So a key that
falls silent delays no other key, and what came too late stays visible.

Each task first adds up its own rows by key and window, so a hot key sends a row for
each task and window through the shuffle. The state of a key is its clock and its open
windows: as many as fit in the delay and in one micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "newest long, revision long, starts array<long>, counts array<long>, totals array<long>"


def partial_tallies(rows: DataFrame, key: str, time: str, value: str, width: int) -> DataFrame:
    """Rows added up by key and window within each Arrow batch: key, start, n, total and newest time.

    time and width are whole numbers of one unit, value is a whole number. Rows without a
    key, time or value count nowhere.
    """
    own = rows.select(F.col(key).alias("key"), F.col(time).cast("long").alias("t"), F.col(value).cast("long").alias("v")).dropna()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = batch.assign(start=batch["t"] // width * width).groupby(["key", "start"], sort=False).agg(n=("t", "size"), total=("v", "sum"), newest=("t", "max"))
            yield sums.reset_index()

    return own.mapInPandas(run, f"key {dict(own.dtypes)['key']}, start long, n long, total long, newest long")


def tallies(rows: DataFrame, key: str, time: str, value: str, width: int, delay: int) -> DataFrame:
    """A stream of tallies: key, start, status, n, total, revision.

    status is "open" (the window's tally so far, replaced by a later revision), "closed"
    (final) or "late" (rows of a closed window in this micro-batch, to be added up). All
    rows of a micro-batch are held against the clock as it stood before it, so their order
    within the micro-batch doesn't matter.
    """
    own = partial_tallies(rows, key, time, value, width)
    kind = dict(own.dtypes)["key"]

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, revision, held = None, 0, {}
        if state.exists:
            newest, revision, starts, counts, totals = state.get
            held = {s: [n, v] for s, n, v in zip(starts, counts, totals, strict=True)}
        revision += 1
        clock, touched, late, seen = None if newest is None else newest - delay, set(), {}, newest
        for part in parts:
            for start, n, total, latest in part[["start", "n", "total", "newest"]].itertuples(index=False):
                behind = clock is not None and start + width <= clock
                tally = late.setdefault(start, [0, 0]) if behind else held.setdefault(start, [0, 0])
                tally[0] += int(n)
                tally[1] += int(total)
                if not behind:
                    touched.add(start)
                seen = int(latest) if seen is None else max(seen, int(latest))
        done = {s for s in held if s + width <= seen - delay}
        out = [(s, "late", *late[s]) for s in sorted(late)] + [(s, "closed", *held[s]) for s in sorted(done)] + [(s, "open", *held[s]) for s in sorted(touched - done)]
        kept = sorted(set(held) - done)
        state.update((seen, revision, kept, [held[s][0] for s in kept], [held[s][1] for s in kept]))
        found = pd.DataFrame(out, columns=["start", "status", "n", "total"]).assign(revision=revision)
        found.insert(0, "key", k[0])
        yield found

    shape = f"key {kind}, start long, status string, n long, total long, revision long"
    return own.groupBy("key").applyInPandasWithState(step, shape, STATE, "append", GroupStateTimeout.NoTimeout)


def settled(written: DataFrame, width: int) -> DataFrame:
    """One row a key and window from what a stream of tallies has written: n, total, closed, n_late and late_total.

    An open window has its newest revision. A window of which all rows were late has a tally of 0 and is closed.
    """
    is_ = lambda status: F.col("status") == status
    of = lambda c: F.coalesce(F.max(F.when(is_("closed"), F.col(c))), F.max_by(c, F.when(is_("open"), F.col("revision"))), F.lit(0)).alias(c)
    late = lambda c: F.sum(F.when(is_("late"), F.col(c)).otherwise(0))
    closed = F.max(F.when(is_("open"), 0).otherwise(1)) == 1
    return written.groupBy("key", "start").agg((F.col("start") + width).alias("end"), of("n"), of("total"), closed.alias("closed"), late("n").alias("n_late"), late("total").alias("late_total"))


def start(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a folder, each micro-batch exactly once; takes what has arrived and ends. Started again it goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def arrived(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def closed_windows(rows: DataFrame, time: str, width: str, delay: str, keys: list[str]) -> DataFrame:
    """Counts of windows under one clock for all keys, each given once it can't change any more; later rows are dropped.

    Spark holds rows against the clock as it stood one micro-batch earlier.
    """
    return rows.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", *keys, "n")
