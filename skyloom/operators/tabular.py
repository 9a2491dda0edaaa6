"""Table algebra: filter, projection, statistics, export and small set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import missing
from skyloom.functions.expr import compile_filter

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def filter_rows(df: DataFrame, expression: str) -> DataFrame:
    """Rows for which the expression is true; masked rows go, negated or not."""
    return df.where(compile_filter(df, expression))


def keep_columns(df: DataFrame, *names: str) -> DataFrame:
    """Ordered projection; a column that isn't there is an error."""
    absent = [n for n in names if n not in df.columns]
    if absent or not names:
        raise ValueError(f"no such column: {', '.join(absent) or 'none named'}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """n, missing, mean, sd, min, median and max of the finite values, a row per numeric column.

    One pass over the table. NULL, NaN and infinities are missing. Columns that aren't
    numbers and columns without a finite value are left out; sd is 0 for one value.
    """
    kinds = dict(df.dtypes)
    own = [c for c in (columns or df.columns) if kinds.get(c) in _NUMERIC or kinds.get(c, "").startswith("decimal")]
    if not own:
        return df.sparkSession.createDataFrame([], "column string, n long, missing long, mean double, sd double, min double, median double, max double")
    packs = []
    for c in own:
        x = missing.finite_or_null(F.col(f"`{c}`"))
        packs.append(F.struct(
            F.lit(c).alias("column"), F.count(x).alias("n"), (F.count(F.lit(1)) - F.count(x)).alias("missing"), F.avg(x).alias("mean"),
            F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd"), F.min(x).alias("min"), F.percentile(x, F.lit(0.5)).alias("median"), F.max(x).alias("max"),
        ))
    return df.agg(F.array(*packs).alias("s")).select(F.inline("s")).where("n > 0")


def export(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes a table as csv, json or parquet."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"can't export {kind!r}: csv, json and parquet are supported")
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def in_list_any_case(df: DataFrame, **allowed: list[str]) -> DataFrame:
    """Rows whose columns are in the given lists, case ignored; columns that aren't there don't restrict."""
    for name, values in allowed.items():
        if name in df.columns:
            df = df.where(F.lower(F.col(f"`{name}`")).isin([v.lower() for v in values]))
    return df


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by one column, as an aggregation: no key's rows are gathered or sorted.

    Of rows that tie, the one with the greatest values in column order stays.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    last = F.max(F.struct(order, *rest)).alias("last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.{c}").alias(c) for c in (order, *rest)]).select(*df.columns)


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with those rows of new whose key it doesn't hold."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def topic_year_counts(df: DataFrame, topic: str, year: str, years: list[int]) -> DataFrame:
    """Topic by year matrix of counts, with the trend from the first to the last year in percent."""
    counted = df.groupBy(topic).pivot(year, years).agg(F.count(F.lit(1))).na.fill(0)
    first, last = F.col(f"`{years[0]}`"), F.col(f"`{years[-1]}`")
    return counted.withColumn("trend_percent", F.when(first > 0, (last - first) * 100.0 / first))


def leverage(level: Column, rows: Column) -> Column:
    """Weight of a level (high, medium, low) by the order of magnitude of its rows, as in ``~1.5M``; the bare weight where rows say nothing."""
    weight = F.when(F.lower(F.trim(level)) == "high", 3.0).when(F.lower(F.trim(level)) == "medium", 2.0).otherwise(1.0)
    text = F.lower(F.regexp_replace(F.regexp_replace(F.trim(rows), "^~+", ""), ",", ""))
    unit = F.regexp_extract(text, r"^[0-9.]+([kmbg])$", 1)
    number = F.regexp_extract(text, r"^([0-9.]+)[kmbg]?$", 1).try_cast("double") * F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit != "", 1e9).otherwise(1.0)
    return F.when(number > 0, weight / F.greatest(F.log10(number), F.lit(1.0))).otherwise(weight)


def year_in_name(name: Column) -> Column:
    """Middle of the year in an object's name: two digits after a survey's name, else a year from 1850 to 2029; NULL without one."""
    short = F.regexp_extract(name, "^(?:Gaia|ZTF|PGIR|ASASSN-|ATLAS)([0-9]{2})", 1).try_cast("double")
    return F.coalesce(2000.5 + short, 0.5 + F.regexp_extract(name, "(18[5-9][0-9]|19[0-9]{2}|20[0-2][0-9])", 1).try_cast("double"))
