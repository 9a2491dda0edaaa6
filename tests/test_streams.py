"""Streams fed out of order, stopped and started again, against plain reckoning of the same micro-batches."""

import random
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skyloom.streaming import alerts, tallies

SCHEMA = "key string, t long, v long, start string"
WIDTH, DELAY = 10, 25


def reckon(batches):
    """key, start -> n, total, closed, n_late, late_total, batch by batch."""
    newest, held, done = {}, defaultdict(lambda: [0, 0, 0, 0]), set()
    for rows in batches:
        rows = [r for r in rows if None not in r[:3]]
        clock = {k: t - DELAY for k, t in newest.items()}
        for k, t, v, _ in rows:
            s = t // WIDTH * WIDTH
            late = k in clock and s + WIDTH <= clock[k]
            assert late or (k, s) not in done
            own = held[k, s]
            own[2 if late else 0] += 1
            own[3 if late else 1] += v
            newest[k] = max(newest.get(k, t), t)
        done |= {(k, s) for k, s in held if s + WIDTH <= newest[k] - DELAY}
    return {(k, s): (n, v, (k, s) in done, m, w) for (k, s), (n, v, m, w) in held.items()}


def batches_of(seed):
    rng = random.Random(seed)
    out = []
    for b in range(6):
        hot = [("hot", max(0, 20 * b + rng.randint(-60, 25)), rng.randint(-5, 50), "x") for _ in range(200)]
        out.append(hot + [(rng.choice("abc"), max(0, 15 * b + rng.randint(-70, 30)), 1, None) for _ in range(rng.choice([0, 3, 12]))])
    out[2] += [(None, 5, 1, "x"), ("a", None, 1, "x"), ("a", 5, None, "x")]
    out.insert(3, [])
    return out


def run(spark, tmp_path, parts):
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = tallies.tallies(tallies.arrived(spark, f"{tmp_path}/in", SCHEMA), "key", "t", "v", WIDTH, DELAY)
        tallies.start(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()


def found(spark, tmp_path):
    out = spark.read.parquet(f"{tmp_path}/out")
    return {(r.key, r.start): (r.n, r.total, r.closed, r.n_late, r.late_total) for r in tallies.settled(out, WIDTH).collect()}


def test_tallies_restart_with_late_rows(spark, tmp_path):
    parts = batches_of(5)
    run(spark, tmp_path, parts)
    expected = reckon(parts)
    assert found(spark, tmp_path) == expected
    assert sum(x[3] for x in expected.values()) > 20 and any(not x[2] for x in expected.values())
    closed = spark.read.parquet(f"{tmp_path}/out").where("status = 'closed'")
    assert closed.count() == closed.select("key", "start").distinct().count()  # a window closes once


def test_a_micro_batch_that_broke_off_counts_once(spark, tmp_path):
    parts = batches_of(6)
    run(spark, tmp_path, parts[:3])
    commits = sorted((p for p in Path(f"{tmp_path}/checkpoint/commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()  # as if the driver had died before the last commit
    Path(f"{commits[-1].parent}/.{commits[-1].name}.crc").unlink(missing_ok=True)
    run(spark, tmp_path, parts[3:])
    assert found(spark, tmp_path) == reckon(parts)


def test_order_within_a_micro_batch_and_dealing_do_not_matter(spark, tmp_path):
    parts = [sorted(rows, key=str, reverse=True) for rows in batches_of(5)]
    run(spark, tmp_path, parts)
    assert found(spark, tmp_path) == reckon(batches_of(5))


def test_closed_windows_and_rows_behind_the_watermark(spark, tmp_path):
    """One clock for all keys: hours of days; each file is a micro-batch, then the stream stops and starts again."""
    files = [[10, 12, 30], [55, 26, 2], [3, 4, 57], [49, 90], [1, 91]]
    dropped = 0
    for hours in files:
        rows = spark.createDataFrame([(h,) for h in hours], "h long").select(F.timestamp_seconds(F.col("h") * 3600).alias("ts"), F.lit("k").alias("k"))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = tallies.start(tallies.closed_windows(tallies.arrived(spark, f"{tmp_path}/in", rows.schema), "ts", "1 day", "6 hours", ["k"]), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        q.awaitTermination()
        dropped += sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    got = {int(r.start.timestamp() // 86400) if r.start.tzinfo else int((r.start - __import__("datetime").datetime(1970, 1, 1)).total_seconds() // 86400): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # clock after the files: 24, 49, 51, 84, 85; windows of days 0 (to 24), 1 (to 48), 2 (to 72), 3
    assert got == {0: 2, 1: 2, 2: 3}
    assert dropped == 3  # 2, then 3 and 4, added up before, and 1 came after day 0 had closed


def test_repeated_alerts_count_once_across_a_restart(spark, tmp_path):
    schema = "alert_id string, timestamp timestamp"
    for ids in (["a", "b", "a"], ["b", "c"], ["a", "d"]):
        spark.createDataFrame([(i, __import__("datetime").datetime(2024, 1, 1, 0, k)) for k, i in enumerate(ids)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        tallies.start(alerts.once(tallies.arrived(spark, f"{tmp_path}/in", schema)), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(r.alert_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c", "d"]


@pytest.mark.parametrize("name", ["late_tallies", "stream_closed_windows"])
def test_queries_without_rows(spark, tmp_path, name):
    from skyloom.queries import QUERIES

    spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
