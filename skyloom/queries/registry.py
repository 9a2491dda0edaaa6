"""Registration of queries with their oracle SQL, and inputs derived from the standard tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(key: str) -> tuple[Column, Column]:
    """A position on the sphere from an integer key: longitude and height by two independent irrational steps, so they cover the sphere evenly."""
    k = F.col(key).cast("double")
    a, b = k * 137.50776405003785, k * 0.41421356237309515
    return a - F.floor(a / 360.0) * 360.0, F.degrees(F.asin(2.0 * (b - F.floor(b)) - 1.0))


def sql_place(key: str) -> tuple[str, str]:
    """The same position in SQL."""
    a, b = f"({key} * 137.50776405003785::DOUBLE)", f"({key} * 0.41421356237309515::DOUBLE)"
    return f"({a} - floor({a} / 360.0::DOUBLE) * 360.0::DOUBLE)", f"degrees(asin(2.0::DOUBLE * ({b} - floor({b})) - 1.0::DOUBLE))"


def sky(spark: SparkSession, sf_dir: str, name: str, key: str, ra: str = "ra", dec: str = "dec") -> DataFrame:
    lon, lat = place(key)
    return table(spark, sf_dir, name).withColumn(ra, lon).withColumn(dec, lat)


def micros(ts: str = "ts") -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def r6(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)


def sql_separation(a1: str, d1: str, a2: str, d2: str) -> str:
    h = f"(pow(sin(radians({d2} - {d1}) / 2), 2) + cos(radians({d1})) * cos(radians({d2})) * pow(sin(radians({a2} - {a1}) / 2), 2))"
    h = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {h}))"
    return f"degrees(2 * atan2(sqrt({h}), sqrt(1 - {h})))"


def sql_pixel(lon: str, lat: str, nside: int) -> str:
    """Ring pixel of a position, the same arithmetic as in the engine."""
    n = nside
    z, t = f"sin(radians({lat}))", f"({lon} / 90.0 - floor({lon} / 360.0) * 4)"
    jp, jm = f"floor({n} * (0.5 + {t}) - 0.75 * {n} * {z})", f"floor({n} * (0.5 + {t}) + 0.75 * {n} * {z})"
    ring = f"({n} + 1 + {jp} - {jm})"
    fm = lambda a, b: f"(({a}) - floor(({a}) / ({b})) * ({b}))"
    at = fm(f"floor(({jp} + {jm} - {n} + (1 - {fm(ring, '2.0')}) + 1) / 2)", f"{4 * n}.0")
    belt = f"{2 * n * (n - 1)} + ({ring} - 1) * {4 * n} + {at}"
    w = f"{n} * sqrt(3 * (1 - least(abs({z}), 1.0)))"
    part = f"({t} - floor({t}))"
    cap = f"(floor({part} * {w}) + floor((1 - {part}) * {w}) + 1)"
    ip = fm(f"floor({t} * {cap})", f"4 * {cap}")
    polar = f"CASE WHEN {z} > 0 THEN 2 * {cap} * ({cap} - 1) + {ip} ELSE {12 * n * n} - 2 * {cap} * ({cap} + 1) + {ip} END"
    return f"CAST(CASE WHEN abs({z}) <= 2.0 / 3.0 THEN {belt} ELSE {polar} END AS BIGINT)"


def sql_centres(nside: int) -> str:
    """Subquery of ipix, z and lon (degrees) of all pixel centres of the ring scheme, by its published formulas for caps and belt."""
    n, cap, npix = nside, 2 * nside * (nside - 1), 12 * nside**2
    return f"""(SELECT ipix,
      CASE WHEN north THEN 1 - i * i / {3 * n * n}.0 WHEN south THEN -1 + i * i / {3 * n * n}.0 ELSE ({2 * n} - i) * 2 / {3 * n}.0 END AS z,
      CASE WHEN north OR south THEN (s - 0.5) * 90.0 / i ELSE (s - 0.5 * (1 + (i + {n}) % 2)) * 90.0 / {n} END AS lon
    FROM (SELECT ipix, north, south, i, CASE WHEN north THEN ipix + 1 - 2 * i * (i - 1) WHEN south THEN 4 * i + 1 - ({npix} - ipix - 2 * i * (i - 1)) ELSE (ipix - {cap}) % {4 * n} + 1 END AS s
    FROM (SELECT ipix, ipix < {cap} AS north, ipix >= {npix - cap} AS south,
      CAST(CASE WHEN ipix < {cap} THEN floor((1 + sqrt(1 + 2 * ipix)) / 2) WHEN ipix >= {npix - cap} THEN floor((1 + sqrt(2 * ({npix} - ipix) - 1)) / 2) ELSE floor((ipix - {cap}) / {4 * n}) + {n} END AS BIGINT) AS i
    FROM (SELECT unnest(range({npix})) AS ipix))))"""


def least_squares(n: int, source: str) -> str:
    """CTEs that solve n normal equations by elimination: rows q1..qn of the source, each with its right side, give x1..xn of b1, by period."""
    less = lambda a, b, k: f"list_transform(range(1, {n + 2}), lambda i: {a}[i] - {a}[{k}] / {b}[{k}] * {b}[i]) AS {a}"
    ctes = [f"a0 AS (SELECT period, {', '.join(f'q{i} AS r{i}' for i in range(1, n + 1))} FROM {source})"]
    for p in range(1, n):
        ctes.append(f"a{p} AS (SELECT period, {', '.join(f'r{i}' if i <= p else less(f'r{i}', f'r{p}', p) for i in range(1, n + 1))} FROM a{p - 1})")
    for p in range(n, 0, -1):
        rest = "".join(f" - r{p}[{j}] * x{j}" for j in range(p + 1, n + 1))
        before = f"b{p + 1}" if p < n else f"a{n - 1}"
        ctes.append(f"b{p} AS (SELECT *, (r{p}[{n + 1}]{rest}) / r{p}[{p}] AS x{p} FROM {before})")
    return ", ".join(ctes)
