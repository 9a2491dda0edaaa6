"""Spherical geometry as Column expressions: frames, separations, equal-area pixels, harmonics.

Angles are degrees unless a name says otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rows of the rotation from equatorial (ICRS) to galactic axes.
GALACTIC = (
    (-0.0548755604162154, -0.8734370902348850, -0.4838350155487132),
    (0.4941094278755837, -0.4448296299600112, 0.7469822444972189),
    (-0.8676661490190047, -0.1980763734312015, 0.4559837761750669),
)
OBLIQUITY = 23.4392911  # mean obliquity of the ecliptic at J2000


def unit_vector(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    a, d = F.radians(lon), F.radians(lat)
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def lon_lat(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Longitude in [0, 360) and latitude of a vector of any length but zero."""
    r = F.sqrt(x * x + y * y + z * z)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / r))))


def rotate(rows: tuple, v: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    return tuple(a * v[0] + b * v[1] + c * v[2] for a, b, c in rows)


def to_galactic(ra: Column, dec: Column) -> tuple[Column, Column]:
    return lon_lat(*rotate(GALACTIC, unit_vector(ra, dec)))


def from_galactic(lon: Column, lat: Column) -> tuple[Column, Column]:
    return lon_lat(*rotate(tuple(zip(*GALACTIC, strict=True)), unit_vector(lon, lat)))


def ecliptic_latitude(ra: Column, dec: Column) -> Column:
    e = math.radians(OBLIQUITY)
    x, y, z = unit_vector(ra, dec)
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -math.sin(e) * y + math.cos(e) * z))))


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance by the haversine formula, exact for small and large angles; missing or NaN if a coordinate is."""
    d1, d2 = F.radians(dec1), F.radians(dec2)
    h = F.pow(F.sin((d2 - d1) / 2), 2) + F.cos(d1) * F.cos(d2) * F.pow(F.sin(F.radians(ra2 - ra1) / 2), 2)
    # Not by least() and greatest(), which pass over missing values.
    h = F.when((h > 1) & ~F.isnan(h), 1.0).when(h < 0, 0.0).otherwise(h)
    return F.degrees(2 * F.atan2(F.sqrt(h), F.sqrt(1 - h)))


def separation_flat(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Small-angle distance on the tangent plane; right ascension wraps."""
    dra = F.pmod(ra2 - ra1 + 180, F.lit(360.0)) - 180
    return F.hypot(dra * F.cos(F.radians((dec1 + dec2) / 2)), dec2 - dec1)


def pixel_of(lon: Column, lat: Column, nside: int) -> Column:
    """Equal-area ring pixel (Gorski et al. 2005) of a position."""
    z = F.sin(F.radians(lat))
    za, turn = F.abs(z), F.pmod(lon / 90.0, F.lit(4.0))
    t1, t2 = nside * (0.5 + turn), 0.75 * nside * z
    jp, jm = F.floor(t1 - t2), F.floor(t1 + t2)
    ring = nside + 1 + jp - jm
    shift = 1 - F.pmod(ring, F.lit(2))
    place = F.pmod(F.floor((jp + jm - nside + shift + 1) / 2), F.lit(4 * nside))
    belt = 2 * nside * (nside - 1) + (ring - 1) * 4 * nside + place
    part = turn - F.floor(turn)
    w = nside * F.sqrt(3 * (1 - F.least(za, F.lit(1.0))))
    kp, km = F.floor(part * w), F.floor((1 - part) * w)
    cap = kp + km + 1
    at = F.pmod(F.floor(turn * cap), 4 * cap)
    polar = F.when(z > 0, 2 * cap * (cap - 1) + at).otherwise(12 * nside * nside - 2 * cap * (cap + 1) + at)
    return F.when(za <= 2.0 / 3.0, belt).otherwise(polar).cast("long")


def pixel_centre(pixel: Column, nside: int) -> tuple[Column, Column]:
    """Longitude and latitude of a ring pixel's centre."""
    ncap, npix = 2 * nside * (nside - 1), 12 * nside * nside
    p = pixel.cast("long")

    def cap(q: Column) -> tuple[Column, Column]:
        # Ring i of a cap holds 4 i pixels and begins at 2 i (i - 1); the root is corrected by at most one.
        guess = F.floor((1 + F.sqrt(1 + 2.0 * q)) / 2).cast("long")
        i = F.when(2 * guess * (guess - 1) > q, guess - 1).when(2 * guess * (guess + 1) <= q, guess + 1).otherwise(guess)
        return i, q - 2 * i * (i - 1) + 1

    i1, p1 = cap(F.greatest(p, F.lit(0)))
    i2, back = cap(F.greatest(npix - 1 - p, F.lit(0)))
    p2 = 4 * i2 + 1 - back
    b = p - ncap
    i0 = F.floor(b / F.lit(4 * nside)).cast("long") + nside
    p0 = F.pmod(b, F.lit(4 * nside)) + 1
    half = F.when(F.pmod(i0 + nside, F.lit(2)) == 0, 0.5).otherwise(1.0)
    z = F.when(p < ncap, 1 - i1 * i1 / F.lit(3.0 * nside * nside)).when(p < npix - ncap, (2 * nside - i0) * 2 / F.lit(3.0 * nside)).otherwise(i2 * i2 / F.lit(3.0 * nside * nside) - 1)
    quarter = F.when(p < ncap, (p1 - 0.5) / i1).when(p < npix - ncap, (p0 - half) / nside).otherwise((p2 - 0.5) / i2)
    return F.pmod(quarter * 90.0, F.lit(360.0)), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))))


def harmonics(x: Column, y: Column, z: Column) -> list[Column]:
    """Real spherical harmonics up to degree 2 of a unit vector, orthonormal, order -l..l in each degree.

    The Condon-Shortley phase is kept, so odd orders are negative where x or y is positive.
    """
    n1, n2 = math.sqrt(3 / (4 * math.pi)), math.sqrt(15 / (4 * math.pi))
    one = F.lit(1.0)
    return [
        one * math.sqrt(1 / (4 * math.pi)), -n1 * y, n1 * z, -n1 * x,
        n2 * x * y, -n2 * y * z, math.sqrt(5 / (16 * math.pi)) * (3 * z * z - 1), -n2 * x * z, n2 / 2 * (x * x - y * y),
    ]


def separation_arccos(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance by the cosine rule; loses digits at small angles."""
    d1, d2 = F.radians(dec1), F.radians(dec2)
    c = F.sin(d1) * F.sin(d2) + F.cos(d1) * F.cos(d2) * F.cos(F.radians(ra2 - ra1))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def latitude_from_pole(ra: Column, dec: Column) -> Column:
    """Galactic latitude as the distance to the pole."""
    return 90 - separation(ra, dec, F.lit(192.85948), F.lit(27.12825))
