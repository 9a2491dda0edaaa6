"""Sky maps: density per equal-area pixel, masks, dipoles and multipoles, resampling.

Fits need only sums over pixels or sources, so Spark reduces to one row of moments
and a small matrix is solved on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import missing, sphere
from skyloom.operators.resample import draw_uniform


def centres(pixel: np.ndarray, nside: int) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude of ring pixels' centres."""
    p, npix, ncap = pixel.astype(np.int64), 12 * nside * nside, 2 * nside * (nside - 1)

    def ring(q: np.ndarray) -> np.ndarray:
        i = ((1 + np.sqrt(1 + 2.0 * np.maximum(q, 0))) / 2).astype(np.int64)
        i -= 2 * i * (i - 1) > q
        return np.maximum(i + (2 * i * (i + 1) <= q), 1)

    north, south = p < ncap, p >= npix - ncap
    i, j = ring(p), ring(npix - 1 - p)
    belt = p - ncap
    k = belt // (4 * nside) + nside
    z = np.where(north, 1 - i**2 / (3.0 * nside**2), np.where(south, j**2 / (3.0 * nside**2) - 1, (2 * nside - k) * 2 / (3.0 * nside)))
    turn = np.where(north, (p - 2 * i * (i - 1) + 0.5) / i, np.where(south, (4 * j - (npix - 1 - p - 2 * j * (j - 1)) - 0.5) / j, (belt % (4 * nside) + np.where((k + nside) % 2 == 0, 0.5, 0.0)) / nside))
    return np.mod(turn * 90.0, 360.0), np.degrees(np.arcsin(np.clip(z, -1, 1)))


def pixel_grid(spark: SparkSession, nside: int) -> DataFrame:
    """Every pixel with its centre: ipix, lon, lat."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lon, lat = centres(batch["id"].to_numpy(), nside)
            yield pd.DataFrame({"ipix": batch["id"], "lon": lon, "lat": lat})

    return spark.range(12 * nside * nside).mapInPandas(run, "ipix long, lon double, lat double")


def density(df: DataFrame, nside: int, lon: str, lat: str, weight: str | None = None, empty: str = "unobserved") -> DataFrame:
    """One row per pixel: ipix, count (or summed weight), lon, lat, coverage.

    Rows without a valid position are dropped. Pixels without a source have coverage 0,
    or 1 where empty is "observed".
    """
    if empty not in ("unobserved", "observed"):
        raise ValueError("empty is 'unobserved' or 'observed'")
    good = missing.is_finite(F.col(lon)) & missing.is_finite(F.col(lat)) & F.col(lat).between(-90, 90)
    value = F.count(F.lit(1)).cast("double") if weight is None else F.sum(F.coalesce(missing.finite_or_null(F.col(weight)), F.lit(0.0)))
    counts = df.where(good).groupBy(sphere.pixel_of(F.col(lon), F.col(lat), nside).alias("ipix")).agg(value.alias("count"))
    grid = pixel_grid(df.sparkSession, nside)
    covered = F.lit(1.0) if empty == "observed" else F.when(F.col("count").isNotNull(), 1.0).otherwise(0.0)
    return grid.join(counts, "ipix", "left").select("ipix", F.coalesce("count", F.lit(0.0)).alias("count"), "lon", "lat", covered.alias("coverage"))


def mask(maps: DataFrame, gal_lat_min: float | None = None, ecl_lat_min: float | None = None, dec_range: tuple[float, float] | None = None, min_count: float | None = None, frame: str = "icrs") -> DataFrame:
    """Coverage 0 for pixels that a condition rejects; all rows stay. frame says what lon and lat are."""
    if frame not in ("icrs", "galactic"):
        raise ValueError("frame is 'icrs' or 'galactic'")
    lon, lat = F.col("lon"), F.col("lat")
    ra, dec = (lon, lat) if frame == "icrs" else sphere.from_galactic(lon, lat)
    b = sphere.to_galactic(lon, lat)[1] if frame == "icrs" else lat
    keep = F.lit(True)
    if gal_lat_min is not None:
        keep = keep & (F.abs(b) >= gal_lat_min)
    if ecl_lat_min is not None:
        keep = keep & (F.abs(sphere.ecliptic_latitude(ra, dec)) >= ecl_lat_min)
    if dec_range is not None:
        keep = keep & dec.between(*dec_range)
    if min_count is not None:
        keep = keep & (F.col("count") >= min_count)
    return maps.withColumn("coverage", F.when(keep, F.col("coverage")).otherwise(0.0))


def _moments(maps: DataFrame, basis: list[Column], keys: list[str] = [], times: Column | None = None) -> DataFrame:  # noqa: B006
    """Weighted normal matrix and right side of value = basis * beta over pixels, an array per key.

    Weights are coverage^2 / max(count, 1), values count / coverage. times repeats a
    pixel, as a bootstrap does.
    """
    w = F.pow(F.col("coverage"), 2) / F.greatest(F.col("count"), F.lit(1.0))
    t = F.lit(1.0) if times is None else times.cast("double")
    n = len(basis)
    # The basis is a projection of its own: Spark computes each function once per pixel.
    rows = maps.where(F.col("coverage") > 0).select(*keys, *[b.alias(f"b{i}") for i, b in enumerate(basis)], t.alias("t"), (w * t).alias("w"), (F.col("count") / F.col("coverage")).alias("v"), F.col("count").alias("c"))
    sums = [F.sum(F.col("w") * F.col(f"b{i}") * F.col(f"b{j}")) for i in range(n) for j in range(i, n)]
    sums += [F.sum(F.col("w") * F.col(f"b{i}") * F.col("v")) for i in range(n)]
    sums += [F.sum("t"), F.sum(F.col("c") * F.col("t"))]
    return rows.groupBy(*keys).agg(F.array(*sums).alias("m"))


def _unpack(m: list[float], n: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    normal = np.zeros((n, n))
    at = 0
    for i in range(n):
        for j in range(i, n):
            normal[i, j] = normal[j, i] = m[at]
            at += 1
    return normal, np.asarray(m[at : at + n]), m[at + n], m[at + n + 1]


def solve_dipole(m: list[float]) -> dict:
    """Monopole, dipole vector, amplitude with its error, and direction from the moments of (1, x, y, z)."""
    normal, right, pixels, total = _unpack(m, 4)
    if pixels < 16:
        raise ValueError("a dipole needs at least 16 covered pixels")
    try:
        cov = np.linalg.inv(normal)
    except np.linalg.LinAlgError as error:
        raise ValueError("the dipole fit is singular: too few covered pixels") from error
    beta = cov @ right
    if abs(beta[0]) < 1e-12:
        raise ValueError("the monopole is zero: an empty map")
    vector = beta[1:] / beta[0]
    amplitude = float(np.linalg.norm(vector))
    u = vector / amplitude if amplitude > 0 else np.array([1.0, 0.0, 0.0])
    error = float(np.sqrt(max(0.0, u @ cov[1:, 1:] @ u))) / abs(beta[0])
    return {
        "monopole": float(beta[0]), "x": float(vector[0]), "y": float(vector[1]), "z": float(vector[2]), "amplitude": amplitude,
        "sigma": float(error), "significance": float(amplitude / error) if error > 0 else 0.0, "shot_noise": 3 / float(np.sqrt(total)) if total > 0 else float("nan"),
        "lon": float(np.degrees(np.arctan2(u[1], u[0])) % 360), "lat": float(np.degrees(np.arcsin(np.clip(u[2], -1, 1)))), "n_pixels": int(pixels),
    }


_DIPOLE = "monopole double, x double, y double, z double, amplitude double, sigma double, significance double, shot_noise double, lon double, lat double, n_pixels long"


def _dipole_basis() -> list[Column]:
    return [F.lit(1.0), *sphere.unit_vector(F.col("lon"), F.col("lat"))]


def dipole_moments(maps: DataFrame) -> DataFrame:
    """The sums that the dipole fit needs, as one row."""
    return _moments(maps, _dipole_basis())


def dipole_fit(maps: DataFrame) -> DataFrame:
    """Weighted least-squares dipole of a density map, one row."""
    found = solve_dipole(dipole_moments(maps).first().m)
    return maps.sparkSession.createDataFrame([tuple(found.values())], _DIPOLE)


def multipoles(maps: DataFrame, lmax: int = 2) -> DataFrame:
    """Power by degree, relative to the monopole, of a fit of polynomials of unit mean square."""
    if not 0 <= lmax <= 3:
        raise ValueError("lmax is 0 to 3")
    x, y, z = sphere.unit_vector(F.col("lon"), F.col("lat"))
    by_degree = [[F.lit(1.0)], [x, y, z], [x * y, y * z, z * x, x * x - y * y, 3 * z * z - 1]]
    by_degree.append([x * (x * x - 3 * y * y), y * (3 * x * x - y * y), z * (x * x - y * y), x * y * z, x * (5 * z * z - 1), y * (5 * z * z - 1), z * (5 * z * z - 3)])
    basis = [b for own in by_degree[: lmax + 1] for b in own]
    degree = np.repeat(np.arange(lmax + 1), [len(own) for own in by_degree[: lmax + 1]])
    seen = maps.where(F.col("coverage") > 0)
    columns = seen.select(*[b.alias(f"b{i}") for i, b in enumerate(basis)])
    squares = np.asarray(columns.agg(F.array(*[F.avg(F.col(c) * F.col(c)) for c in columns.columns])).first()[0], float)
    rms = np.where(squares > 0, np.sqrt(squares), 1.0)
    normal, right, pixels, _ = _unpack(_moments(maps, basis).first().m, len(basis))
    beta = np.linalg.lstsq(normal / np.outer(rms, rms), right / rms, rcond=None)[0]
    scale = beta[0] ** 2 or 1.0
    rows = [(int(d), float((beta[degree == d] ** 2).sum() / scale), int(pixels)) for d in range(lmax + 1)]
    return maps.sparkSession.createDataFrame(rows, "degree int, power double, n_pixels long")


def vector_dipole(df: DataFrame, lon: str, lat: str, weight: str | None = None, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Dipole 3 sum(w n) / sum(w) of sources, a row per key."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    x, y, z = sphere.unit_vector(F.col(lon), F.col(lat))
    sums = df.groupBy(*keys).agg(F.sum(w).alias("w"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * z).alias("sz"), F.count(F.lit(1)).alias("n"))
    d = [3 * missing.divide(F.col(c), F.col("w")) for c in ("sx", "sy", "sz")]
    return sums.select(*keys, "n", d[0].alias("dx"), d[1].alias("dy"), d[2].alias("dz"), F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("amplitude"))


def uniform(*keys: Column | str) -> Column:
    """A number in (0, 1) that depends on the keys alone, not on the partitioning."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + 0.5) / float(1 << 53)


def _solved(moments: DataFrame) -> DataFrame:
    """Amplitude of each draw's dipole; draws whose fit fails have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for m in batch["m"]:
                try:
                    found.append(solve_dipole(list(m))["amplitude"])
                except ValueError:
                    found.append(float("nan"))
            yield pd.DataFrame({"draw": batch["draw"], "amplitude": found})

    return moments.mapInPandas(run, "draw long, amplitude double")


def _poisson_one(u: Column) -> Column:
    """A Poisson count of mean 1 by inversion of the distribution function."""
    p = total = float(np.exp(-1.0))
    out = F.lit(0)
    for k in range(1, 12):
        out = F.when(u > total, k).otherwise(out)
        p /= k
        total += p
    return out


def bootstrap(maps: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """Amplitude of each resampling of the pixels: every pixel counts a Poisson(1) number of times."""
    seen = maps.where(F.col("coverage") > 0).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    times = _poisson_one(draw_uniform(seed, F.col("draw"), F.col("ipix")))
    return _solved(_moments(seen, _dipole_basis(), ["draw"], times))


def null_shuffle(maps: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """Amplitude of each permutation of counts and coverage over the covered pixels' positions."""
    from pyspark.sql import Window as W

    seen = maps.where(F.col("coverage") > 0).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    place = seen.withColumn("k", F.row_number().over(W.partitionBy("draw").orderBy("ipix"))).select("draw", "k", "lon", "lat")
    order = draw_uniform(seed, F.col("draw"), F.col("ipix"))
    value = seen.withColumn("k", F.row_number().over(W.partitionBy("draw").orderBy(order, "ipix"))).select("draw", "k", "count", "coverage")
    return _solved(_moments(place.join(value, ["draw", "k"]), _dipole_basis(), ["draw"]))


def summary(draws: DataFrame, observed: float | None = None) -> DataFrame:
    """Percentiles of drawn amplitudes and, with an observed one, the share of draws that reach it."""
    a = F.when(~F.isnan("amplitude"), F.col("amplitude"))
    out = [F.count(a).alias("draws"), F.avg(a).alias("mean"), F.stddev_samp(a).alias("sd"), *[F.percentile(a, F.lit(p / 100)).alias(f"p{p}") for p in (16, 50, 84)]]
    if observed is not None:
        out.append(((F.count_if(a >= observed) + 1) / (F.count(a) + 1)).alias("p_value"))
    return draws.agg(*out)


def synthetic_sky(spark: SparkSession, sources: int, nside: int, amplitude: float, lon: float, lat: float, seed: int = 0) -> DataFrame:
    """About so many sources with an injected dipole: Poisson counts per pixel, as a density map."""
    npix = 12 * nside * nside
    grid = pixel_grid(spark, nside)
    n = sphere.unit_vector(F.col("lon"), F.col("lat"))
    d = sphere.unit_vector(F.lit(float(lon)), F.lit(float(lat)))
    mean = sources / npix * (1 + amplitude * (n[0] * d[0] + n[1] * d[1] + n[2] * d[2]))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = [float(np.random.default_rng([seed, int(p)]).poisson(max(m, 0.0))) for p, m in zip(batch["ipix"], batch["mean"], strict=True)]
            yield pd.DataFrame({"ipix": batch["ipix"], "count": counts, "lon": batch["lon"], "lat": batch["lat"], "coverage": 1.0})

    return grid.withColumn("mean", mean).mapInPandas(draw, "ipix long, count double, lon double, lat double, coverage double")


def mode_coupling(maps: DataFrame) -> np.ndarray:
    """9 x 9 coupling of the harmonics up to degree 2 under the coverage."""
    ys = sphere.harmonics(*sphere.unit_vector(F.col("lon"), F.col("lat")))
    area = 4 * np.pi / maps.count()
    rows = maps.select("coverage", *[y.alias(f"y{i}") for i, y in enumerate(ys)])
    row = rows.agg(F.array(*[F.sum(F.col("coverage") * F.col(f"y{i}") * F.col(f"y{j}")) for i in range(9) for j in range(i, 9)])).first()[0]
    out = np.zeros((9, 9))
    at = 0
    for i in range(9):
        for j in range(i, 9):
            out[i, j] = out[j, i] = row[at] * area
            at += 1
    return out


def deconvolved_dipole(maps: DataFrame) -> DataFrame:
    """Dipole from pseudo harmonic coefficients of the density contrast, coupling undone."""
    seen = maps.where(F.col("coverage") > 0)
    mean = seen.agg((F.sum(F.col("count")) / F.sum("coverage")).alias("m")).first().m
    ys = sphere.harmonics(*sphere.unit_vector(F.col("lon"), F.col("lat")))
    area = 4 * np.pi / maps.count()
    contrast = F.col("count") / mean - F.col("coverage")
    rows = seen.select(contrast.alias("c"), *[y.alias(f"y{i}") for i, y in enumerate(ys)])
    right = np.asarray(rows.agg(F.array(*[F.sum(F.col("c") * F.col(f"y{i}")) for i in range(9)])).first()[0]) * area
    coupling = mode_coupling(maps)
    a = np.linalg.pinv(coupling) @ right
    norm = np.sqrt(3 / (4 * np.pi))
    vector = np.array([-a[3], -a[1], a[2]]) * norm
    amplitude = float(np.linalg.norm(vector))
    row = (*map(float, vector), amplitude, float(np.sqrt((a[4:] ** 2).sum())), float(np.linalg.cond(coupling)))
    return maps.sparkSession.createDataFrame([row], "x double, y double, z double, amplitude double, quadrupole double, condition double")


def clip_hot_pixels(maps: DataFrame, rounds: int = 5, factor: float = 6.0) -> DataFrame:
    """Coverage 0 for pixels above median + factor * 1.4826 MAD, again until nothing changes."""
    for _ in range(rounds):
        seen = maps.where(F.col("coverage") > 0)
        median = seen.agg(F.percentile("count", F.lit(0.5))).first()[0]
        if median is None:
            return maps
        mad = seen.agg(F.percentile(F.abs(F.col("count") - median), F.lit(0.5))).first()[0]
        hot = F.col("count") > median + factor * 1.4826 * mad
        if seen.where(hot).isEmpty():
            break
        maps = maps.withColumn("coverage", F.when(hot, 0.0).otherwise(F.col("coverage")))
    return maps


def compare(measured: DataFrame, expected: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Ratio and tension of measured dipoles (amplitude, sigma) with expected ones (amplitude), by key.

    Without keys there is one prediction; several would leave it open which one is meant and are an error.
    """
    m, e = measured.select(*keys, F.col("amplitude").alias("measured"), "sigma"), expected.select(*keys, F.col("amplitude").alias("expected"))
    if keys:
        pairs = m.join(e, keys)
    else:
        if len(e.take(2)) > 1:
            raise ValueError("several predictions need keys to tell which measurement each is for")
        pairs = m.join(F.broadcast(e))  # one row
    return pairs.select("*", missing.divide(F.col("measured"), F.col("expected")).alias("ratio"), missing.divide(F.col("measured") - F.col("expected"), F.col("sigma")).alias("tension_sigma"))
