"""Photographic plates: normalised rows, light curves put together by position, rows around an epoch, control stars."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.functions import missing
from skyloom.operators.match import cross_match
from skyloom.sources.shared import written

# Bits of the plates' quality flags.
AFLAGS = {
    "high_background": 1 << 6, "bad_plate_quality": 1 << 7, "multiple_exposure_unmatched": 1 << 8, "uncertain_date": 1 << 9, "multiple_exposure_blend": 1 << 10, "large_iso_rms": 1 << 11,
    "large_local_smooth_rms": 1 << 12, "close_to_limit": 1 << 13, "radial_bin_9": 1 << 14, "radial_bin_unknown": 1 << 15, "uncertain_catalogue_mag": 1 << 19, "case_b_blend": 1 << 20,
    "case_c_blend": 1 << 21, "case_bc_blend": 1 << 22, "large_drad": 1 << 23, "pickering_wedge": 1 << 24,
}
BFLAGS = {"saturated": 1 << 2, "psf_saturated": 1 << 10}
#: Flags that void a detection, that void a limit, and that only widen the error.
BAD = ("high_background", "bad_plate_quality", "multiple_exposure_unmatched", "uncertain_date", "multiple_exposure_blend", "radial_bin_unknown", "case_c_blend", "case_bc_blend", "pickering_wedge")
BAD_LIMIT = ("high_background", "bad_plate_quality", "uncertain_date", "pickering_wedge")
SOFT = ("large_iso_rms", "large_local_smooth_rms", "large_drad", "case_b_blend")


def bits(names: tuple[str, ...], of: dict[str, int] = AFLAGS) -> int:
    return sum(of[n] for n in names)


def _flagged(column: str, names: tuple[str, ...], of: dict[str, int] = AFLAGS) -> Column:
    return F.coalesce(missing.finite_or_null(F.col(column)), F.lit(0.0)).cast("long").bitwiseAND(F.lit(bits(names, of))) != 0


def tidy(df: DataFrame) -> DataFrame:
    """Plate rows with t (Julian year), mag, err, lim, det, good, near_limit and sat; other columns stay.

    A row is a detection if either identifier is set and its magnitude is finite. The error is the
    local scatter, or 0.25 where there is none above 0, held between 0.08 and 1.5; near the plate's
    limit 0.3 is added in quadrature, under a soft flag 0.5. A detection is good without a bad flag;
    a limit is good if it is fainter than 5 and the plate has none of the flags that void limits.
    Rows are a set: what needs them in order of time sorts by t.
    """
    either = (F.coalesce(missing.finite_or_null(F.col("gsc_bin_index")), F.lit(0.0)) != 0) | (F.coalesce(missing.finite_or_null(F.col("sextractor_number")), F.lit(0.0)) != 0)
    mag = F.when(either, missing.finite_or_null(F.col("magcal_magdep")))
    det, rms, lim = mag.isNotNull(), missing.finite_or_null(F.col("magcal_local_rms")), missing.finite_or_null(F.col("limiting_mag_local"))
    err = F.least(F.greatest(F.when(rms > 0, rms).otherwise(0.25), F.lit(0.08)), F.lit(1.5))
    near = det & _flagged("aflags", ("close_to_limit",))
    err = F.when(near, F.hypot(err, F.lit(0.3))).otherwise(err)
    err = F.when(det & _flagged("aflags", SOFT), F.hypot(err, F.lit(0.5))).otherwise(err)
    good = F.when(det, ~_flagged("aflags", BAD)).otherwise(F.coalesce(lim > 5, F.lit(False)) & ~_flagged("aflags", BAD_LIMIT))
    raw = ("date_jd", "magcal_magdep", "magcal_local_rms", "limiting_mag_local", "gsc_bin_index", "sextractor_number", "aflags", "bflags")
    new = {"t": 2000.0 + (F.col("date_jd") - 2451545.0) / 365.25, "mag": mag, "err": err, "lim": lim, "det": det, "good": good, "near_limit": near, "sat": det & _flagged("bflags", tuple(BFLAGS), BFLAGS)}
    return df.select(*[c for c in df.columns if c not in raw and c not in new], *[c.alias(n) for n, c in new.items()])


def _apart(ra: str, dec: str, ra0: str, dec0: str) -> Column:
    """Flat distance in arcseconds."""
    return F.hypot((F.col(ra) - F.col(ra0)) * F.cos(F.radians(dec0)), F.col(dec) - F.col(dec0)) * 3600


EXPOSURE = ("series", "plate", "solution")


def assemble(own: DataFrame, neighbours: DataFrame, target: str, r_det: float = 6.0, r_own: float = 15.0, r_resolve: float = 8.0, excess: float = 1.0) -> DataFrame:
    """One light curve a target from the rows of its own source and of its neighbours: target, exposure, mag, ra_deg, dec_deg, owner, distance.

    Both have target, target_ra, target_dec, ra_deg, dec_deg, mag, series, plate, solution and a row
    number ``row``; neighbours also have owner, owner_ra, owner_dec. A detection of the own source
    counts within r_own arcseconds. One of a neighbour counts within r_det if it is nearer to the target
    than half its distance from its owner; and, where owner and target can't be told apart (nearer
    than r_resolve), if it is brighter than the owner's median by ``excess``, or the owner has fewer
    than three detections. Each exposure keeps its nearest detection, ties to the own source, then to the
    least owner and row; an exposure without one keeps the own source's limits.
    """
    clean = lambda df: df.withColumn("mag", missing.finite_or_null(F.col("mag"))).withColumn("plate", F.coalesce(missing.finite_or_null(F.col("plate")), F.lit(0.0)).cast("long")).withColumn("solution", F.coalesce(missing.finite_or_null(F.col("solution")), F.lit(0.0)).cast("long"))
    columns = [target, *EXPOSURE, "mag", "ra_deg", "dec_deg", "owner", "row", "distance"]
    mine = clean(own).withColumn("owner", F.lit(None).cast(dict(neighbours.dtypes)["owner"])).withColumn("distance", _apart("ra_deg", "dec_deg", "target_ra", "target_dec"))
    theirs = clean(neighbours).withColumn("distance", _apart("ra_deg", "dec_deg", "target_ra", "target_dec")).withColumn("from_owner", _apart("ra_deg", "dec_deg", "owner_ra", "owner_dec"))
    theirs = theirs.withColumn("close", F.hypot((F.col("owner_ra") - F.col("target_ra")) * F.cos(F.radians("target_dec")), F.col("owner_dec") - F.col("target_dec")) * 3600 < r_resolve)
    usual = theirs.where("close").groupBy(target, "owner").agg(F.when(F.count("mag") >= 3, F.percentile("mag", F.lit(0.5))).alias("usual"))
    theirs = theirs.join(usual, [target, "owner"], "left")
    bright = F.col("usual").isNull() | (F.col("mag") <= F.col("usual") - excess)
    counts = (F.col("distance") <= r_det) & F.when(F.col("close"), bright).otherwise(2 * F.col("distance") < F.col("from_owner"))
    found = mine.where(F.col("mag").isNotNull() & (F.col("distance") <= r_own)).select(*columns).unionByName(theirs.where(F.col("mag").isNotNull() & counts).select(*columns))
    nearest = W.partitionBy(target, *EXPOSURE).orderBy("distance", F.col("owner").asc_nulls_first(), "row")
    best = found.withColumn("__k", F.row_number().over(nearest)).where("__k = 1").drop("__k")
    limits = mine.where(F.col("mag").isNull()).select(*columns).join(best.select(target, *EXPOSURE), [target, *EXPOSURE], "left_anti")
    return best.unionByName(limits).drop("row")


def rows_near(rows: DataFrame, centres: DataFrame, keys: list[str], t: str, centre: str, half: float, most: int | None = None, id: str = "id", centre_id: str = "centre_id", seed: int = 0, salts: int = 4) -> DataFrame:
    """Every centre with the rows of its keys in [centre - half, centre + half).

    Time is cut into buckets of that width; a centre goes to its own and the two beside it. Rows of a
    bucket are dealt over ``salts`` parts and a centre goes to all of them, so a crowded bucket is
    several tasks. With ``most`` a centre keeps so many of its rows at random, by a hash of seed, centre
    and row: a sample of crowded windows, as the training of a detector takes it.
    """
    a = rows.withColumn("__b", F.floor(F.col(t) / half)).withColumn("__s", F.pmod(F.xxhash64(id), F.lit(salts)).cast("int"))
    b = centres.withColumn("__c", F.floor(F.col(centre) / half))
    b = b.withColumn("__b", F.explode(F.sequence(F.col("__c") - 1, F.col("__c") + 1))).withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).drop("__c")
    pairs = a.join(b, [*keys, "__b", "__s"]).where((F.col(t) >= F.col(centre) - half) & (F.col(t) < F.col(centre) + half)).drop("__b")
    return _least(pairs, centre_id, F.xxhash64(F.lit(seed), F.col(centre_id), F.col(id)), id, most) if most else pairs.drop("__s")


def _least(pairs: DataFrame, key: str, order: Column, id: str, most: int) -> DataFrame:
    """The ``most`` rows of a key that come first; each salted part of a key leaves so many before the parts meet."""
    own = pairs.withColumn("__o", order)
    if "__s" not in pairs.columns:
        own = own.withColumn("__s", F.pmod("__o", F.lit(16)))
    first = lambda *part: F.row_number().over(W.partitionBy(*part).orderBy("__o", id)) <= most
    own = own.withColumn("__k", first(key, "__s")).where("__k")
    return own.withColumn("__k", first(key)).where("__k").drop("__k", "__o", "__s")


@dataclass
class Turn:
    """An order that looks random: (star + target) modulo modulus, a column of the catalogue's and one of the targets' columns."""

    star: Column
    target: Column
    modulus: int


#: Stars within the first look's part of a Turn, and how much larger each next part is.
FIRST_LOOK, WIDER = 8192, 4


def control_stars(targets: DataFrame, catalogue: DataFrame, order: Column | Turn, k: int = 2, narrow: float = 0.5, wide: float = 1.0, sparse_radius: float = 900.0, sparse_inner: float = 120.0) -> DataFrame:
    """tid, star and separation (arcsec): up to k field stars like each target, picked by an order that looks random.

    targets: tid, target_ra, target_dec, target_mag, target_matches, radius (arcsec, at most sparse_radius). catalogue: star, ra,
    dec, mag, matches, v_flag. A control lies between 0.4 and 1 radius away, isn't flagged variable, and is as
    visible: fewer than 20 matches if the target has fewer, else at least half the target's. Its
    magnitude differs by less than ``narrow``; with fewer than k such stars by less than ``wide``. Targets
    of a radius of at least 300 that still have fewer than k look between sparse_inner and
    sparse_radius instead. Missing matches and flags are 0. Pairs are made by cells of the
    widest radius; each target's candidates are cut to k in parts before they meet.

    With any column as the order all pairs are made. A Turn deals the stars around a circle on which
    each target has its own beginning, so a target looks at a short arc from there on, then at one
    WIDER times as long: with k alike stars within its own radius nothing later can come before
    them. Only those that don't find k in half of the circle or less meet all stars.
    """
    stars = catalogue.withColumnsRenamed({"ra": "star_ra", "dec": "star_dec"})
    places = ("star_ra", "star_dec"), ("target_ra", "target_dec")
    zero = lambda c: F.coalesce(missing.finite_or_null(F.col(c)), F.lit(0.0))
    apart, differ = F.col("separation") * 3600, F.abs(F.col("mag") - F.col("target_mag"))
    seen = F.when(zero("target_matches") < 20, zero("matches") < 20).otherwise(zero("matches") >= 0.5 * zero("target_matches"))
    own_zone = (F.col("apart") > 0.4 * F.col("radius")) & (F.col("apart") <= F.col("radius"))
    out = None
    if isinstance(order, Turn):
        m = order.modulus
        stars = written(stars.where(zero("v_flag") == 0).withColumn("__phase", F.pmod(order.star, F.lit(m)).cast("long")), "stars")
        targets = written(targets.withColumn("__begin", F.pmod(-order.target, F.lit(m)).cast("long")), "targets")
        order = F.pmod(F.col("__phase") - F.col("__begin"), F.lit(m))
        arcs = 1 << max(0, min(stars.count() // FIRST_LOOK, m).bit_length() - 1)
        while arcs > 1:
            arc = -(-m // arcs)  # whole numbers of the circle; the last arc may be shorter
            at = F.floor(F.col("__begin") / arc)
            end = F.floor(F.pmod(F.col("__begin") + arc - 1, F.lit(m)) / arc)
            # The circle's end may fall within the part, so it can touch three arcs.
            last = F.lit((m - 1) // arc)
            touched = F.array_distinct(F.array(at, F.when(at == last, F.lit(0)).otherwise(at + 1), end))
            asked = targets.select("tid", "target_ra", "target_dec", "target_mag", "target_matches", "radius", "__begin", (F.col("radius") / 3600).alias("__reach"), F.explode(touched.cast("array<bigint>")).alias("__arc"))
            near = cross_match(stars.withColumn("__arc", F.floor(F.col("__phase") / arc).cast("long")), asked, sparse_radius / 3600, *places, on=["__arc"], reach="__reach")
            near = near.where((order < arc) & seen & (differ < narrow)).select("tid", "star", "radius", apart.alias("apart"), order.alias("order")).where(own_zone)
            picked = written(_least(near, "tid", F.col("order"), "star", k), "picked")
            done = picked.groupBy("tid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("tid")
            found = picked.join(done, "tid", "left_semi").select("tid", "star", F.col("apart").alias("separation"))
            out = found if out is None else out.unionByName(found)
            targets = written(targets.join(done, "tid", "left_anti"), "targets")
            if targets.isEmpty():
                return out
            arcs //= WIDER
    reach = F.when(F.col("radius") < 300, F.col("radius")).otherwise(F.lit(float(sparse_radius))) / 3600
    pairs = cross_match(stars, targets.withColumn("__reach", reach), sparse_radius / 3600, *places, reach="__reach")
    pairs = pairs.where(seen & (zero("v_flag") == 0) & (differ < wide)).select("tid", "star", "radius", apart.alias("apart"), (differ < narrow).alias("alike"), order.alias("order"))
    zones = F.array_compact(F.array(F.when(own_zone, F.lit(0)), F.when((F.col("radius") >= 300) & (F.col("apart") > sparse_inner), F.lit(1))))
    pairs = pairs.withColumn("zone", F.explode(zones))
    counted = pairs.groupBy("tid", "zone").agg(F.count_if("alike").alias("n_alike"), F.count(F.lit(1)).alias("n"))
    chosen = counted.groupBy("tid").agg(F.coalesce(F.max(F.when((F.col("zone") == 0) & (F.col("n") >= k), 0)), F.max("zone")).alias("zone")).join(counted, ["tid", "zone"])
    pairs = pairs.join(chosen, ["tid", "zone"]).where((F.col("n_alike") < k) | F.col("alike"))
    rest = _least(pairs, "tid", F.col("order"), "star", k).select("tid", "star", F.col("apart").alias("separation"))
    return rest if out is None else out.unionByName(rest)
