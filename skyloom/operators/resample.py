"""Bootstrap by clusters without copying rows.

In every draw a cluster counts a Poisson(1) number of times, which depends on the seed,
the draw and the cluster's number alone; so no table of draws is made or joined. A task
turns a batch of rows into a matrix of weights, a column a draw, and adds up what the
statistic needs. Draw 0 has weight 1 everywhere: the sample itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.sources.shared import written

PRIME = 2147483647
ROUNDS = (1013904223, 1442695040, 271828182)
RANGE_ROWS = 1_000_000  # rows of a range of values that one task reads in order, a batch at a time
MOST_RANGES = 4096  # with more rows the ranges get longer
#: Distribution function of a Poisson variable of mean 1.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def draw_uniform(seed: int, draw, key):
    """A number in [0, 1) from whole numbers, in plain arithmetic below 2^63: the same on columns, arrays and in SQL."""
    column = isinstance(key, Column) or isinstance(draw, Column)
    mod = (lambda x: F.pmod(x, F.lit(PRIME))) if column else (lambda x: x % PRIME)
    x = mod(mod(key) * 7919 + mod(draw) * 104729 + (seed * 15485863 + 12345) % PRIME)
    for k in ROUNDS:
        x = mod(x * x + k)
    return x / float(PRIME)


def sql_uniform(seed: int, draw: str, key: str) -> str:
    x = f"((({key}) % {PRIME} + {PRIME}) % {PRIME} * 7919 + ({draw}) * 104729 + {(seed * 15485863 + 12345) % PRIME}) % {PRIME}"
    for k in ROUNDS:
        x = f"(({x})::BIGINT * ({x})::BIGINT + {k}) % {PRIME}" if k == ROUNDS[0] else f"list_transform([{x}], lambda y: (y * y + {k}) % {PRIME})[1]"
    return f"(({x}) / {float(PRIME)}::DOUBLE)"


def sql_weight(seed: int, draw: str, key: str) -> str:
    u = sql_uniform(seed, draw, key)
    steps = " + ".join(f"(u >= {p!r}::DOUBLE)::INTEGER" for p in POISSON)
    return f"CASE WHEN {draw} = 0 THEN 1 ELSE list_transform([{u}], lambda u: {steps})[1] END"


def weights(keys: np.ndarray, seed: int, draws: int) -> np.ndarray:
    """Weights of clusters, a row each and a column for each of draws + 1 draws."""
    different, inverse = np.unique(keys, return_inverse=True)
    u = draw_uniform(seed, np.arange(draws + 1)[None, :], different.astype(np.int64)[:, None])
    times = np.searchsorted(POISSON, u.ravel(), side="right").reshape(u.shape).astype(np.int64)
    times[:, 0] = 1
    return times[inverse]


def cluster_number(cluster: str) -> Column:
    """A cluster's number; any column that isn't a whole number is hashed by the caller."""
    return F.col(cluster).cast("long")


def _of_batch(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column(k).to_numpy(zero_copy_only=False)


def drawn_quantiles(rows: DataFrame, score: str, cluster: str, q: float, draws: int, seed: int = 0) -> DataFrame:
    """draw, threshold and n: the order statistic at place ceil(q (n - 1)) of the scores of each draw.

    Equal scores of a batch are added up first, so a value that fills the table is a row a
    batch. Scores are dealt into ranges of about RANGE_ROWS rows; each is read in order with
    one counter a draw. Missing scores don't count; a draw without weight gives no row.
    """
    own = rows.select(F.col(score).cast("double").alias("score"), cluster_number(cluster).alias("cluster")).where("score IS NOT NULL AND NOT isnan(score) AND cluster IS NOT NULL")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, inverse = np.unique(_of_batch(batch, 0), return_inverse=True)
            times = np.zeros((len(values), draws + 1), np.int64)
            np.add.at(times, inverse, weights(_of_batch(batch, 1), seed, draws))
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(list(times), pa.list_(pa.int64()))], ["score", "times"])

    counted = written(own.mapInArrow(add_up, "score double, times array<long>"), "drawn")
    n_ranges = min(MOST_RANGES, max(2, math.ceil(counted.count() / RANGE_ROWS)))
    edges = np.unique(counted.approxQuantile("score", [k / n_ranges for k in range(1, n_ranges)], 0.1 / n_ranges))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.searchsorted(edges, _of_batch(batch, 0)).astype(np.int32))], ["score", "times", "range"])

    ranged = counted.mapInArrow(deal, "score double, times array<long>, range int")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(edges) + 1, draws + 1), np.int64)
        for batch in batches:
            np.add.at(sums, _of_batch(batch, 1), np.stack(batch.column(0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, draws + 1), np.int64))
        r, d = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(sums[r, d])], ["range", "draw", "w"])

    by_range = ranged.select("times", "range").mapInArrow(totals, "range int, draw int, w long").groupBy("draw", "range").agg(F.sum("w").alias("w"))
    upto, all_ = W.partitionBy("draw").orderBy("range"), W.partitionBy("draw")
    by_range = by_range.withColumn("upto", F.sum("w").over(upto)).withColumn("n", F.sum("w").over(all_)).withColumn("place", F.ceil(F.lit(q) * (F.col("n") - 1)))
    targets = by_range.where("upto > place AND upto - w <= place").select("draw", "range", (F.col("place") - F.col("upto") + F.col("w")).alias("within"), "n").collect()  # a row a draw
    wanted: dict[int, list] = {}
    for t in targets:
        wanted.setdefault(t.range, []).append((t.draw, t.within, t.n))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: dict[int, np.ndarray] = {}
        for batch in batches:
            scores, ranges = _of_batch(batch, 0), _of_batch(batch, 2)
            for r in np.unique(ranges).tolist():
                here = ranges == r
                times = np.stack(batch.column(1).filter(pa.array(here)).to_numpy(zero_copy_only=False))
                run = np.cumsum(times, 0) + passed.get(r, 0)
                out = []
                for draw, within, n in wanted.get(r, []):
                    at = int(np.searchsorted(run[:, draw], within, side="right"))
                    if at < len(run) and (r not in passed or passed[r][draw] <= within):
                        out.append((draw, float(scores[here][at]), n))
                passed[r] = run[-1]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["draw", "threshold", "n"])

    ordered = ranged.where(F.col("range").isin(list(wanted))).repartition("range").sortWithinPartitions("range", "score")
    return ordered.select("score", "times", "range").mapInArrow(find, "draw long, threshold double, n long")


def drawn_rates(rows: DataFrame, scores: list[str], cluster: str, thresholds: list[dict[int, float]], draws: int, seed: int = 0) -> DataFrame:
    """draw, n and for each score the rate of rows above the draw's threshold; a draw without weight or threshold gives no row."""
    limit = np.full((len(scores), draws + 1), np.nan)
    for k, by_draw in enumerate(thresholds):
        for d, t in by_draw.items():
            limit[k, d] = t
    own = rows.select(*[F.col(s).cast("double").alias(f"s{k}") for k, s in enumerate(scores)], cluster_number(cluster).alias("cluster")).where("cluster IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((1 + len(scores), draws + 1), np.int64)
        for batch in batches:
            times = weights(_of_batch(batch, len(scores)), seed, draws)
            sums[0] += times.sum(0)
            for k in range(len(scores)):
                sums[k + 1] += (times * (_of_batch(batch, k)[:, None] > limit[k][None, :])).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws + 1)), *[pa.array(s) for s in sums]], ["draw", "n", *[f"h{k}" for k in range(len(scores))]])

    shape = "draw long, n long, " + ", ".join(f"h{k} long" for k in range(len(scores)))
    summed = own.mapInArrow(run, shape).groupBy("draw").agg(F.sum("n").alias("n"), *[F.sum(f"h{k}").alias(f"h{k}") for k in range(len(scores))])
    known = [int(d) for d in range(draws + 1) if np.isfinite(limit[:, d]).all()]
    return summed.where(F.col("draw").isin(known) & (F.col("n") > 0)).select("draw", "n", *[(F.col(f"h{k}") / F.col("n")).alias(f"rate_{s}") for k, s in enumerate(scores)])


def recall_difference(controls: DataFrame, eruptions: DataFrame, first: str, second: str, cluster: str, rate: float, draws: int, seed: int = 0) -> DataFrame:
    """One row: recalls of two scores at a false-alarm rate, their difference and its 95 % interval over draws of clusters.

    Each draw takes its thresholds from its own controls.
    """
    limits = [{r.draw: r.threshold for r in drawn_quantiles(controls, s, cluster, 1 - rate, draws, seed).collect()} for s in (first, second)]  # a number a draw
    found = drawn_rates(eruptions, [first, second], cluster, limits, draws, seed).withColumn("delta", F.col(f"rate_{second}") - F.col(f"rate_{first}"))
    own = F.col("draw") == 0
    of = lambda c, name: F.max(F.when(own, F.col(c))).alias(name)
    interval = lambda p, name: F.percentile(F.when(~own, F.col("delta")), F.lit(p)).alias(name)
    return found.agg(of("n", "n"), of(f"rate_{first}", "recall_first"), of(f"rate_{second}", "recall_second"), of("delta", "delta"), interval(0.025, "low"), interval(0.975, "high"))


def calibration_interval(df: DataFrame, confidence: str, correct: str, key: str, bins: int = 15, draws: int = 100, seed: int = 42) -> DataFrame:
    """One row: n, calibration error over bins (lo, hi] and its 95 % interval over draws of rows.

    A row is a cluster of its own, by its key. Tasks pass on three sums a bin and draw.
    """
    own = df.select(F.col(confidence).cast("double").alias("c"), F.col(correct).cast("double").alias("y"), cluster_number(key).alias("k")).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, bins + 1, draws + 1))
        for batch in batches:
            c, y, times = _of_batch(batch, 0), _of_batch(batch, 1), weights(_of_batch(batch, 2), seed, draws)
            which = np.clip(np.ceil(c * bins), 0, bins).astype(np.int64)
            for k, part in enumerate((times, times * c[:, None], times * y[:, None])):
                np.add.at(sums[k], which, part)
        b, d = np.nonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(b), *[pa.array(s[b, d]) for s in sums]], ["draw", "bin", "w", "c", "y"])

    binned = own.mapInArrow(run, "draw long, bin long, w double, c double, y double").groupBy("draw", "bin").agg(*[F.sum(x).alias(x) for x in ("w", "c", "y")])
    errors = binned.groupBy("draw").agg(F.sum("w").alias("n"), F.sum(F.when(F.col("bin") > 0, F.abs(F.col("c") - F.col("y"))).otherwise(0.0)).alias("e")).withColumn("e", F.col("e") / F.col("n"))
    drawn = F.when(F.col("draw") > 0, F.col("e"))
    sample = lambda c: F.max(F.when(F.col("draw") == 0, F.col(c)))
    return errors.agg(sample("n").cast("long").alias("n"), sample("e").alias("ece"), F.percentile(drawn, F.lit(0.025)).alias("low"), F.percentile(drawn, F.lit(0.975)).alias("high"))
