"""Approximate aggregates, on request: sketches kept by key, merged later without the rows.

Exact aggregates stay the default everywhere. A sketch has a fixed size, whatever it has
seen, and sketches of parts merge into that of the whole: new days are sketched when they
come and any span of days is asked from the stored sketches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Two standard errors of a distinct count at the default precision (2^12 buckets), and the rank error of quantiles.
DISTINCT_ERROR, RANK_ERROR = 2 * 1.04 / 2**6, 0.0133


def build(df: DataFrame, keys: list[str], distinct: str, value: str) -> DataFrame:
    """keys, n, sketch of the different values of one column and sketch of the distribution of another. Missing values count nowhere."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.col(distinct)).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double")).alias("value_sketch"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser keys."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch").alias("value_sketch"))


def estimate(sketches: DataFrame, levels: list[float]) -> DataFrame:
    """Adds the estimated distinct count and the estimated quantiles, an array."""
    quantiles = F.array(*[F.kll_sketch_get_quantile_double("value_sketch", F.lit(q)) for q in levels])
    return sketches.select(*[c for c in sketches.columns if not c.endswith("_sketch")], F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"), quantiles.alias("quantiles"))
