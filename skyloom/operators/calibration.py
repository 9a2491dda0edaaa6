"""Calibration of class probabilities: error families, conformal prediction and risk control.

Order statistics and scans over scores are computed on sorted partitions: scores are
first reduced to one row per distinct value, then cumulated over ranges of values, so
no task gets all of them. Quantiles by key are cumulated within the key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.functions import scores


RANGES = 256  # ranges of values that are cumulated side by side


def cumulated(counts: DataFrame, order: str, totals: dict[str, str]) -> DataFrame:
    """Running sums over ascending values of a column: for each (column, name) of totals the sum up to and with the row.

    Values are dealt into ranges by approximate quantiles. Rows are cumulated within
    their range, and what the lower ranges hold together is added: a row per range,
    which is broadcast.
    """
    edges = sorted(set(counts.approxQuantile(order, [k / RANGES for k in range(1, RANGES)], 0.5 / RANGES)))
    place = F.lit(0)
    if edges:
        place = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col(order)))
    own = counts.withColumn("__range", place)
    sums = own.groupBy("__range").agg(*[F.sum(c).alias(n) for c, n in totals.items()])
    lower = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # at most RANGES rows
    before = sums.select(F.col("__range").alias("__r"), *[F.coalesce(F.sum(n).over(lower), F.lit(0)).alias(f"__{n}") for n in totals.values()])
    within = W.partitionBy("__range").orderBy(order)
    joined = own.join(F.broadcast(before), F.col("__range") == F.col("__r"))
    return joined.select(*counts.columns, *[(F.sum(c).over(within) + F.col(f"__{n}")).alias(n) for c, n in totals.items()])


def bin_above(x: Column, bins: int) -> Column:
    """Bin (lo, hi] from 1 to bins; 0 for x <= 0."""
    return F.ceil(x * bins).cast("int")


def bin_from(x: Column, bins: int) -> Column:
    """Bin [lo, hi) from 0, with 1 in the last."""
    return F.least(F.floor(x * bins), F.lit(bins - 1)).cast("int")


def with_confidence(df: DataFrame, probs: str, label: str) -> DataFrame:
    p = F.col(probs)
    return df.withColumn("confidence", F.array_max(p)).withColumn("correct", (scores.argmax(p) == F.col(label)).cast("double"))


def reliability(df: DataFrame, bins: int, half_open_right: bool = True) -> DataFrame:
    """Per bin of confidence: n, mean confidence, mean correctness. Bins without rows are absent."""
    b = bin_above(F.col("confidence"), bins) if half_open_right else bin_from(F.col("confidence"), bins)
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("s"), F.avg("correct").alias("y")).where("bin >= 1" if half_open_right else "bin >= 0")


def calibration_errors(df: DataFrame, probs: str, label: str, bins: int = 10) -> DataFrame:
    """Accuracy, mean squared error, and expected and maximal calibration error, one row."""
    own = with_confidence(df, probs, label)
    total = own.agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"), F.avg(scores.squared_error(F.col(probs), F.col(label))).alias("brier"))
    binned = reliability(own, bins).withColumn("d", F.abs(F.col("s") - F.col("y")))
    gaps = binned.agg(F.sum(F.col("n") * F.col("d")).alias("weighted"), F.max("d").alias("mce"))
    return total.join(F.broadcast(gaps)).select("n", "accuracy", "brier", (F.coalesce("weighted", F.lit(0.0)) / F.col("n")).alias("ece"), F.coalesce("mce", F.lit(0.0)).alias("mce"))


def debiased_error(df: DataFrame, probs: str, label: str, bins: int = 15, mode: str = "above") -> DataFrame:
    """Squared calibration error with and without its finite-sample bias.

    mode "above" has bins (lo, hi]; mode "from" has bins [lo, hi) and a debiased value of at least 0.
    """
    if mode not in ("above", "from"):
        raise ValueError("mode is 'above' or 'from'")
    binned = reliability(with_confidence(df, probs, label), bins, mode == "above")
    sq = F.pow(F.col("s") - F.col("y"), 2)
    bias = F.when(F.col("n") > 1, F.col("y") * (1 - F.col("y")) / F.greatest(F.col("n") - 1, F.lit(1))).otherwise(0.0)
    row = binned.agg(F.sum("n").alias("n"), F.sum(F.col("n") * sq).alias("a"), F.sum(F.col("n") * (sq - bias)).alias("b"))
    plugin, debiased = F.coalesce(F.col("a") / F.col("n"), F.lit(0.0)), F.coalesce(F.col("b") / F.col("n"), F.lit(0.0))
    debiased = F.greatest(debiased, F.lit(0.0)) if mode == "from" else debiased
    return row.select("n", plugin.alias("squared_plugin"), debiased.alias("squared_debiased"), F.sqrt(plugin).alias("root_plugin"), F.sqrt(F.greatest(debiased, F.lit(0.0))).alias("root_debiased"))


def skill(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """Confusion counts, hit and false-alarm rates, and true and Heidke skill scores."""
    c = df.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    tpr, fpr = tp / F.greatest(tp + fn, F.lit(1.0)), fp / F.greatest(fp + tn, F.lit(1.0))
    base = (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)
    return c.select("tp", "fp", "fn", "tn", tpr.alias("tpr"), fpr.alias("fpr"), (tpr - fpr).alias("tss"), (2 * (tp * tn - fp * fn) / F.greatest(base, F.lit(1.0))).alias("hss"))


def higher_quantile(df: DataFrame, column: str, q: float, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The order statistic at 0-based place ceil(q (n - 1)), a row per key; missing values don't count."""
    counts = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("c"))
    if keys:
        placed = counts.withColumn("upto", F.sum("c").over(W.partitionBy(*keys).orderBy(column))).withColumn("n", F.sum("c").over(W.partitionBy(*keys)))
    else:
        placed = cumulated(counts, column, {"c": "upto"}).crossJoin(F.broadcast(counts.agg(F.sum("c").alias("n"))))  # one row
    return placed.where(F.col("upto") > F.ceil(F.lit(q) * (F.col("n") - 1))).groupBy(*keys).agg(F.min(column).alias("quantile"), F.max("n").alias("n"))


def conformal_threshold(df: DataFrame, probs: str, label: str, doubt: str | None = None, alpha: float = 0.1, weight: float = 0.1) -> DataFrame:
    """Calibrated score threshold of split conformal prediction, one row; infinite if the sample is too small.

    Score 1 - p_label (+ weight * doubt); rank ceil((n + 1)(1 - alpha)); the order
    statistic at ceil(rank / n * (n - 1)) of the n sorted scores.
    """
    score = 1 - scores.at(F.col(probs), F.col(label))
    if doubt:
        score = score + weight * F.col(doubt)
    own = df.select(score.alias("score")).where(F.col("score").isNotNull())
    counts = own.groupBy("score").agg(F.count(F.lit(1)).alias("c"))
    counts = cumulated(counts, "score", {"c": "upto"}).crossJoin(F.broadcast(own.agg(F.count(F.lit(1)).alias("n"))))  # one row
    rank = F.ceil((F.col("n") + 1) * (1 - alpha))
    place = F.ceil(rank / F.col("n") * (F.col("n") - 1))
    return counts.agg(F.max("n").alias("n"), F.min(F.when(F.col("upto") > place, F.col("score"))).alias("t"), F.max(rank).alias("rank")).select("n", F.when(F.col("rank") > F.col("n"), float("inf")).otherwise(F.col("t")).alias("threshold"))


def _scan(df: DataFrame, p: str, target: Column) -> DataFrame:
    """Per distinct score and for 0 and 1: rows selected at or above it and false ones among them."""
    own = df.where(F.col(p).isNotNull()).select(F.col(p).cast("double").alias("lam"), target.cast("int").alias("hit"))
    ends = df.sparkSession.range(2).select(F.col("id").cast("double").alias("lam"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("h"))
    counts = own.groupBy("lam").agg(F.count(F.lit(1)).alias("c"), F.sum("hit").alias("h")).unionByName(ends).groupBy("lam").agg(F.sum("c").alias("c"), F.sum("h").alias("h"))
    whole = counts.agg(F.sum("c").alias("n"), F.sum("h").alias("targets"))  # one row
    upto = cumulated(counts, "lam", {"c": "__c", "h": "__h"}).crossJoin(F.broadcast(whole))
    return upto.select("lam", (F.col("n") - F.col("__c") + F.col("c")).alias("selected"), (F.col("targets") - F.col("__h") + F.col("h")).alias("hits"), "n", "targets")


def risk_control(df: DataFrame, p: str, target: Column, alpha: float = 0.05, mode: str = "strict") -> DataFrame:
    """Least threshold whose selection keeps the false-discovery rate, corrected for sample size, at alpha.

    mode "strict" counts an empty selection as without risk and reports retention over
    all rows, threshold 1 where nothing passes; mode "targets" skips empty selections,
    reports retention over the targets, and falls back to 0.85 with its real risk; mode
    "passing" is the same but that the fallback's risk and retention are given as 0.
    """
    if mode not in ("strict", "targets", "passing"):
        raise ValueError("mode is 'strict', 'targets' or 'passing'")
    scan = _scan(df, p, target).withColumn("risk", F.when(F.col("selected") > 0, (F.col("selected") - F.col("hits")) / F.greatest(F.col("selected"), F.lit(1))).otherwise(0.0))
    scan = scan.withColumn("ok", F.col("n") / (F.col("n") + 1.0) * F.col("risk") + 1 / (F.col("n") + 1.0) <= alpha)
    if mode != "strict":
        scan = scan.withColumn("ok", F.col("ok") & (F.col("selected") > 0))
    row = F.struct("lam", "risk", "selected", "hits")
    found = scan.agg(F.max("n").alias("n"), F.max("targets").alias("targets"), F.min(F.when(F.col("ok"), row)).alias("best"), F.min(F.when(F.col("lam") >= 0.85, row)).alias("fallback"))
    if mode == "strict":
        chosen = F.coalesce("best", F.struct(F.lit(1.0).alias("lam"), F.lit(0.0).alias("risk"), F.lit(0).cast("long").alias("selected"), F.lit(0).cast("long").alias("hits")))
        kept = chosen["selected"] / F.col("n")
        return found.select("n", chosen["lam"].alias("threshold"), chosen["risk"].alias("risk"), F.coalesce(F.when(F.col("best").isNotNull(), kept), F.lit(0.0)).alias("retention"), F.coalesce(F.col("best.selected") > 0, F.lit(False)).alias("feasible"))
    feasible = F.col("best").isNotNull()
    chosen = F.col("best") if mode == "passing" else F.coalesce("best", "fallback")
    return found.select("n", F.when(feasible, F.col("best.lam")).otherwise(0.85).alias("threshold"), F.coalesce(chosen["risk"], F.lit(0.0)).alias("risk"), F.coalesce(chosen["hits"] / F.greatest(F.col("targets"), F.lit(1)), F.lit(0.0)).alias("retention"), feasible.alias("feasible"))


def quantiles(df: DataFrame, column: str, levels: list[float]) -> list[float]:
    """Linearly interpolated quantiles of the finite values: two neighbouring order statistics a level, found over ranges of values.

    As many numbers as levels; none for a column without values.
    """
    own = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    counts = own.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    n = counts.agg(F.sum("c").alias("n")).first().n
    if not n:
        return []
    low = [min(int(q * (n - 1)), n - 1) for q in levels]
    places = sorted({*low, *[min(k + 1, n - 1) for k in low]})
    found = cumulated(counts, "x", {"c": "upto"}).agg(F.array(*[F.min(F.when(F.col("upto") > k, F.col("x"))) for k in places])).first()[0]
    at = dict(zip(places, found, strict=True))
    return [at[k] + (q * (n - 1) - k) * (at[min(k + 1, n - 1)] - at[k]) for q, k in zip(levels, low, strict=True)]


def uniform_mass_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Distinct quantiles that cut a column into bins of equal mass: a fixed number of values."""
    return sorted(set(quantiles(df, column, [k / bins for k in range(bins + 1)])))


@dataclass(frozen=True)
class ScalingBinning:
    """A temperature, and the accuracy of each bin [edge, next edge) of confidence."""

    temperature: float
    edges: tuple[float, ...]
    values: tuple[float, ...]


def _softmax(logits: Column, temperature: float) -> Column:
    top = F.array_max(logits)
    return scores.normalise(F.transform(logits, lambda z: F.exp((z - top) / temperature)))


def fit_temperature(df: DataFrame, logits: str, label: str, low: float = 0.05, high: float = 10.0, passes: int = 60) -> float:
    """The temperature of the least cross-entropy.

    The loss is convex in one over the temperature; its slope is the sum of expected less labelled
    logit. Newton's steps in that variable stay in a bracket that the slope's sign halves. A pass is
    one aggregation of two sums.
    """
    z, y = F.col(logits), scores.at(F.col(logits), F.col(label))
    a, b, beta = 1 / high, 1 / low, 1.0
    for _ in range(passes):
        p = _softmax(z, 1 / beta)
        both = F.arrays_zip(p.alias("p"), z.alias("z"))
        rows = df.select(F.aggregate(both, F.lit(0.0), lambda s, x: s + x["p"] * x["z"]).alias("m"), F.aggregate(both, F.lit(0.0), lambda s, x: s + x["p"] * x["z"] * x["z"]).alias("q"), y.cast("double").alias("y"))
        g, h = rows.agg(F.sum(F.col("m") - F.col("y")), F.sum(F.col("q") - F.col("m") * F.col("m"))).first()
        if g is None:
            return 1.0
        a, b = (a, beta) if g > 0 else (beta, b)
        new = beta - g / h if h > 0 else (a + b) / 2
        new = new if a < new < b else (a + b) / 2
        if abs(new - beta) <= 1e-12 * beta:
            break
        beta = new
    return 1 / beta


def fit_scaling_binning(df: DataFrame, logits: str, label: str, bins: int = 10) -> ScalingBinning:
    """Temperature first, then bins of equal mass over the scaled confidence with the accuracy of each; an empty bin has its middle."""
    temperature = fit_temperature(df, logits, label)
    own = with_confidence(df.withColumn("__p", _softmax(F.col(logits), temperature)), "__p", label).select("confidence", "correct")
    edges = quantiles(own, "confidence", [k / bins for k in range(bins + 1)])
    edges = sorted({0.0, *edges[1:-1], 1.0001})
    which = sum((F.when(F.col("confidence") >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    found = {r.b: r.y for r in own.groupBy(which.alias("b")).agg(F.avg("correct").alias("y")).collect()}  # a row a bin
    return ScalingBinning(temperature, tuple(edges), tuple(found.get(k, (edges[k] + edges[k + 1]) / 2) for k in range(len(edges) - 1)))


def apply_scaling_binning(df: DataFrame, model: ScalingBinning, logits: str) -> DataFrame:
    """Adds probs and confidence: the top class gets its bin's accuracy, the others share the rest as they did."""
    p = F.col("__p")
    top = scores.argmax(p)
    own = df.withColumn("__p", _softmax(F.col(logits), model.temperature))
    which = sum((F.when(F.array_max(p) >= e, 1).otherwise(0) for e in model.edges[1:-1]), F.lit(0))
    own = own.withColumn("__top", top).withColumn("__old", F.array_max(p)).withColumn("confidence", F.array(*[F.lit(v) for v in model.values])[which])
    rest = F.when(F.col("__old") < 1, (1 - F.col("confidence")) / (1 - F.col("__old") + 1e-12)).otherwise(1.0)
    return own.withColumn("__rest", rest).withColumn("probs", F.transform("__p", lambda x, i: F.when(i == F.col("__top"), F.col("confidence")).otherwise(x * F.col("__rest")))).drop("__p", "__top", "__old", "__rest")


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman's coefficient: correlation of average ranks, counted once per distinct value."""
    def ranks(c: str) -> DataFrame:
        counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        return cumulated(counts.where(F.col(c).isNotNull()), c, {"n": "__upto"}).select(c, (F.col("__upto") - F.col("n") + (F.col("n") + 1) / 2).alias(f"rank_{c}"))

    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(ranks(x), x).join(ranks(y), y).agg(F.corr(f"rank_{x}", f"rank_{y}").alias("rho"))
