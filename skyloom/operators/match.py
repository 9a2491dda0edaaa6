"""Matching in space and time: cones, cross-matches, intervals and as-of joins.

Theta joins become equi joins on cells with an exact test afterwards, so they
shuffle on cells and never compare all pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.functions import sphere
from skyloom.sources.shared import written


def in_cone(ra: str, dec: str, ra0: float, dec0: float, radius: float) -> Column:
    """Point in circle; the declination band in front lets the scan prune."""
    band = F.col(dec).between(dec0 - radius, dec0 + radius)
    return band & (sphere.separation(F.col(ra), F.col(dec), F.lit(float(ra0)), F.lit(float(dec0))) <= radius)


def cone_search(df: DataFrame, ra0: float, dec0: float, radius: float, ra: str = "ra", dec: str = "dec", limit: int | None = None) -> DataFrame:
    """Rows within radius degrees, nearest first if limited; the limit is part of the service it stands for."""
    found = df.where(in_cone(ra, dec, ra0, dec0, radius)).withColumn("separation", sphere.separation(F.col(ra), F.col(dec), F.lit(float(ra0)), F.lit(float(dec0))))
    return found.orderBy("separation").limit(limit) if limit else found


def outside_cones(df: DataFrame, cones: list[tuple[float, float, float]], ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Rows in none of a short list of cones (ra, dec, radius); the conditions are one filter at the scan."""
    for cone in cones:
        df = df.where(~in_cone(ra, dec, *cone))
    return df


def _cell(ra: Column, dec: Column, height: float) -> tuple[Column, Column, Column]:
    """Strip, cell in the strip and the strip's number of cells; cells are at least height wide on the sky."""
    strip = F.floor((dec + 90) / height)
    edge = F.greatest(F.abs(strip * height - 90), F.abs((strip + 1) * height - 90))
    cells = F.greatest(F.lit(1.0), F.floor(360 * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / height))
    return strip, F.least(F.floor(F.pmod(ra, F.lit(360.0)) * cells / 360), cells - 1), cells


#: Comparisons in a task, and how many more than rows a round of nearest_match may make.
TASK_TESTS, TESTS_A_ROW = 4_000_000, 64


def _in_cells(left: DataFrame, right: DataFrame, radius: float, left_pos: tuple[str, str], right_pos: tuple[str, str], reach: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Left rows with their cell, right rows once for every cell that their circle touches, both with their unit vector."""
    height = max(radius, 180.0 / (1 << 20))
    a = left.where(F.col(left_pos[0]).isNotNull() & F.col(left_pos[1]).between(-90, 90))
    strip, cell, _ = _cell(F.col(left_pos[0]), F.col(left_pos[1]), height)
    a = a.withColumn("__strip", strip).withColumn("__cell", cell.cast("long"))
    b = right.where(F.col(right_pos[0]).isNotNull() & F.col(right_pos[1]).between(-90, 90))
    own = F.least(F.col(reach), F.lit(float(radius))) if reach else F.lit(float(radius))
    b = b.withColumn("__own", own).withColumn("__chord", F.pow(2 * F.sin(F.radians(F.least(F.col("__own"), F.lit(180.0))) / 2), 2) * (1 + 1e-9) + 1e-15)
    ra, dec, own = F.pmod(F.col(right_pos[0]), F.lit(360.0)), F.col(right_pos[1]), F.col("__own")
    b = b.withColumn("__strip", F.explode(F.sequence(F.floor((dec - own + 90) / height), F.floor((dec + own + 90) / height))))
    edge = F.greatest(F.abs(F.col("__strip") * height - 90), F.abs((F.col("__strip") + 1) * height - 90))
    cells = F.greatest(F.lit(1.0), F.floor(360 * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / height))
    # Half width in right ascension of a circle: all of it where the circle holds a pole.
    half = F.when(F.abs(dec) + own >= 90, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(own)) / F.cos(F.radians(dec)))))) + 1e-9
    low, high = F.floor((ra - half) * cells / 360), F.floor((ra + half) * cells / 360)
    span = F.least(high, low + cells - 1)
    b = b.withColumn("__c", F.explode(F.sequence(low.cast("long"), span.cast("long")))).withColumn("__cell", F.pmod(F.col("__c"), cells.cast("long"))).drop("__c")
    for side, pos, name in ((a, left_pos, "a"), (b, right_pos, "b")):
        x, y, z = sphere.unit_vector(F.col(pos[0]), F.col(pos[1]))
        side = side.withColumns({f"__x{name}": x, f"__y{name}": y, f"__z{name}": z})
        a, b = (side, b) if name == "a" else (a, side)
    return a, b


def _loads(a: DataFrame, b: DataFrame, cell: list[str]) -> DataFrame:
    """Comparisons in each cell."""
    count = lambda df, n: df.groupBy(*cell).agg(F.count(F.lit(1)).alias(n))
    return count(a, "na").join(count(b, "nb"), cell).select(*cell, "na", (F.col("na") * F.col("nb")).alias("tests"))


def cross_match(left: DataFrame, right: DataFrame, radius: float, left_pos: tuple[str, str], right_pos: tuple[str, str], on: list[str] | None = None, reach: str | None = None) -> DataFrame:
    """All pairs within radius degrees, with their separation; columns of the two sides must differ in name.

    The sky is cut into declination strips no lower than the radius and into cells no
    narrower. Each row of the left side goes to its own cell; each row of the right
    side goes to every cell that its circle touches: up to three strips and, in each,
    the cells of a range of right ascension. So a pair meets in exactly one cell.
    ``on`` names columns that both sides have and that must be equal too; ``reach`` a column of the
    right side with a smaller radius of each row. Few bytes are much work here, so the
    comparisons are counted first: there are as many tasks as they need, and the left rows of a cell
    that holds more than a task's share are dealt over several.
    """
    cell = ["__strip", "__cell", *(on or [])]
    a, b = _in_cells(left, right, radius, left_pos, right_pos, reach)
    loads = written(_loads(a, b, cell), "loads")
    total = loads.agg(F.sum("tests")).first()[0] or 0
    n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(20_000, math.ceil(total / TASK_TESTS)))
    # At most total / TASK_TESTS cells.
    heavy = loads.where(F.col("tests") > TASK_TESTS).select(*cell, F.least("na", F.ceil(F.col("tests") / TASK_TESTS)).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    a = a.join(F.broadcast(heavy), cell, "left").withColumn("__part", F.pmod(F.xxhash64(*[c for c, t in left.dtypes if "map<" not in t]), parts).cast("int")).drop("__parts")
    b = b.join(F.broadcast(heavy), cell, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    key = [*cell, "__part"]
    if total > TASK_TESTS:
        a, b = a.repartition(n, *key), b.repartition(n, *key).hint("merge")
    pair = a.join(b, key)
    # Chords first, with room for rounding; the exact separation decides. It is exploded, so it is computed once and
    # after all filters that don't need it.
    chord = sum((F.col(f"__{c}a") - F.col(f"__{c}b")) * (F.col(f"__{c}a") - F.col(f"__{c}b")) for c in "xyz")
    sep = sphere.separation(F.col(left_pos[0]), F.col(left_pos[1]), F.col(right_pos[0]), F.col(right_pos[1]))
    pair = pair.where(chord <= F.col("__chord")).withColumn("separation", F.explode(F.array(sep))).where(F.col("separation") <= F.col("__own"))
    return pair.drop("__strip", "__cell", "__part", "__own", "__chord", *[f"__{c}{s}" for c in "xyz" for s in "ab"])


def _first_radius(left: DataFrame, right: DataFrame, radius: float, left_pos: tuple[str, str], right_pos: tuple[str, str]) -> float:
    """A radius, at most the given one, whose comparisons are in proportion to the rows."""
    rows = left.count() + right.count()
    while radius > 1e-5:
        tests = _loads(*_in_cells(left, right, radius, left_pos, right_pos), ["__strip", "__cell"]).agg(F.sum("tests")).first()[0] or 0
        if tests <= TESTS_A_ROW * rows:
            break
        radius *= min(0.5, math.sqrt(TESTS_A_ROW * rows / tests))
    return radius


def nearest_match(left: DataFrame, right: DataFrame, radius: float, left_pos: tuple[str, str], right_pos: tuple[str, str], key: str, other: str) -> DataFrame:
    """For each left key the nearest right row within radius, ties to the least other key.

    Left rows look within a small radius first, and those that find nothing within four times
    that, and so on up to the radius: whoever finds a row has all that could be nearer. Right rows
    of one position enter as the one of the least key.
    """
    right = written(right.groupBy(*right_pos).agg(F.min(other).alias(other)), "places")
    rest = written(left.select(key, *left_pos).where(F.col(left_pos[0]).isNotNull() & F.col(left_pos[1]).between(-90, 90)), "rest")
    own, out = _first_radius(rest, right, radius, left_pos, right_pos), None
    while True:
        pairs = cross_match(rest, right, own, left_pos, right_pos)
        best = written(pairs.groupBy(key).agg(F.min(F.struct("separation", other)).alias("best")), "nearest")
        out = best if out is None else out.unionByName(best)
        if own >= radius:
            break
        found = best.select(F.col(key).alias("__found"))
        rest = written(rest.join(found, F.col(key).eqNullSafe(F.col("__found")), "left_anti"), "rest")
        if rest.isEmpty():
            break
        own = min(radius, 4 * own)
    return out.select(key, F.col(f"best.{other}").alias(other), F.col("best.separation").alias("separation"))


def in_intervals(rows: DataFrame, intervals: DataFrame, t: str, low: str, high: str, keys: list[str], keep: bool, open_ends: bool = False) -> DataFrame:
    """Rows whose time lies in some interval of the same keys (keep) or in none.

    The intervals of a key are merged to disjoint ones first, so at most one can hold
    a time: the last that began by then. One sort by key and time finds it.
    """
    first = W.partitionBy(*keys).orderBy(low, high)
    touch = (F.col("__reach") > F.col(low)) if open_ends else (F.col("__reach") >= F.col(low))
    merged = intervals.where(F.col(low) <= F.col(high)).withColumn("__reach", F.max(high).over(first.rowsBetween(W.unboundedPreceding, -1)))
    merged = merged.withColumn("__group", F.sum(F.when(touch, 0).otherwise(1)).over(first))
    merged = merged.groupBy(*keys, "__group").agg(F.min(low).alias("__low"), F.max(high).alias("__high"))
    marks = merged.select(*keys, F.col("__low").alias("__t"), F.lit(1 if open_ends else 0).alias("__kind"), F.struct("__low", "__high").alias("__iv"))
    both = rows.withColumn("__t", F.col(t)).withColumn("__kind", F.lit(0 if open_ends else 1)).unionByName(marks, allowMissingColumns=True).withColumn("__row", F.col("__iv").isNull())
    order = W.partitionBy(*keys).orderBy(F.col("__t").asc_nulls_first(), "__kind").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("__last", F.last("__iv", ignorenulls=True).over(order)).where("__row")
    inside = (F.col("__last.__high") > F.col("__t")) if open_ends else (F.col("__last.__high") >= F.col("__t"))
    hit = F.coalesce(inside, F.lit(False))
    return seen.where(hit if keep else ~hit).select(*rows.columns)


def asof_backward(rows: DataFrame, events: DataFrame, t: str, event_t: str, keys: list[str]) -> DataFrame:
    """Each row with the time of the last event of its keys at or before its own; NULL if there is none."""
    marks = events.select(*keys, F.col(event_t).alias("__t"), F.lit(0).alias("__kind"), F.col(event_t).alias("last_event"))
    both = rows.withColumn("__t", F.col(t)).withColumn("__kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    order = W.partitionBy(*keys).orderBy(F.col("__t").asc_nulls_first(), "__kind").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("last_event", F.last("last_event", ignorenulls=True).over(order)).where("__kind = 1").drop("__t", "__kind")


def asof_nearest(left: DataFrame, right: DataFrame, left_t: str, right_t: str, keys: list[str], tolerance: float, left_id: str, right_id: str) -> DataFrame:
    """For each left row the right row of its keys nearest in time, nearer than tolerance; ties to the least id.

    Times are cut into buckets of the tolerance's width; a right row goes to its own
    bucket and the two beside it.
    """
    a = left.withColumn("__b", F.floor(F.col(left_t) / tolerance))
    b = right.withColumn("__b", F.explode(F.sequence(F.floor(F.col(right_t) / tolerance) - 1, F.floor(F.col(right_t) / tolerance) + 1)))
    pairs = a.join(b, [*keys, "__b"]).withColumn("__d", F.abs(F.col(left_t) - F.col(right_t))).where(F.col("__d") < tolerance)
    best = pairs.groupBy(left_id).agg(F.min(F.struct("__d", right_id, right_t)).alias("m"))
    return best.select(left_id, F.col(f"m.{right_id}").alias(right_id), F.col("m.__d").alias("gap"))


def match_nights(a: DataFrame, b: DataFrame, t: str, value: str) -> DataFrame:
    """Values of two series on common rounded nights, the first of each night."""
    first = lambda df, name: df.groupBy(F.floor(F.col(t) + 0.5).alias("night")).agg(F.min_by(value, t).alias(name))
    return first(a, "a").join(first(b, "b"), "night")


def coincidences(left: DataFrame, right: DataFrame, window_sec: float = 500.0) -> DataFrame:
    """Alerts (alert_id, mjd, ra, dec, area_90) with neutrinos (neutrino_id, nu_mjd, nu_ra, nu_dec, radius, p_astro) of the same time.

    score = p_astro * exp(-(separation / radius)^2 / 2) * (1 - |dt| / window), with the
    radius of both errors together. Times are joined by cells of the window's width and
    their neighbours, so only pairs that can coincide meet; pairs outside the window,
    which score 0, are left out.
    """
    day = window_sec / 86400.0
    cell = lambda c: F.floor(F.col(c) / day).cast("long")
    own = left.withColumn("cell", F.explode(F.array(*[cell("mjd") + k for k in (-1, 0, 1)])))
    pairs = own.join(right.withColumn("cell", cell("nu_mjd")), "cell").drop("cell")
    dt = F.abs(F.col("nu_mjd") - F.col("mjd")) * 86400.0
    radius = F.sqrt(F.greatest(F.col("area_90"), F.lit(1.0)) / math.pi + F.col("radius") * F.col("radius"))
    apart = sphere.separation(F.col("ra"), F.col("dec"), F.col("nu_ra"), F.col("nu_dec")) / F.greatest(radius, F.lit(0.1))
    pairs = pairs.where(dt <= window_sec).withColumn("dt", dt)
    return pairs.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p_astro") * F.exp(-0.5 * apart * apart) * (1 - F.col("dt") / window_sec))))
