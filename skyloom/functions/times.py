"""Time scales as arithmetic on doubles, and their conversion to timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Julian dates of reference epochs and length of the Julian year.
J2000_JD, JULIAN_YEAR, MJD_ZERO, GAIA_ZERO, SWIFT_ZERO, UNIX_ZERO_JD = 2451545.0, 365.25, 2400000.5, 2455197.5, 2451910.5, 2440587.5
DAY_SECONDS = 86400.0
GPS_ZERO_MJD = 44244.0
# MJD from which GPS time was ahead of UTC by so many whole seconds.
GPS_LEAP_SECONDS = (
    (44786, 1), (45151, 2), (45516, 3), (46247, 4), (47161, 5), (47892, 6), (48257, 7), (48804, 8), (49169, 9),
    (49534, 10), (50083, 11), (50630, 12), (51179, 13), (53736, 14), (54832, 15), (56109, 16), (57204, 17), (57754, 18),
)


def jd_to_year(jd: Column) -> Column:
    return 2000.0 + (jd - J2000_JD) / JULIAN_YEAR


def year_to_jd(year: Column) -> Column:
    return J2000_JD + (year - 2000.0) * JULIAN_YEAR


def mjd_to_jd(mjd: Column) -> Column:
    return mjd + MJD_ZERO


def gaia_to_jd(days: Column) -> Column:
    return days + GAIA_ZERO


def swift_to_jd(seconds: Column) -> Column:
    return SWIFT_ZERO + seconds / DAY_SECONDS


def gps_to_mjd(seconds: Column) -> Column:
    """UTC day number of GPS seconds: leap seconds are a step function of the day itself."""
    day = GPS_ZERO_MJD + seconds / DAY_SECONDS
    leap = F.lit(0)
    for start, count in GPS_LEAP_SECONDS:
        leap = F.when(day - count / DAY_SECONDS >= start, count).otherwise(leap)
    return day - leap / DAY_SECONDS


def timestamp_to_jd(ts: Column) -> Column:
    return F.unix_micros(ts) / 1e6 / DAY_SECONDS + UNIX_ZERO_JD


def jd_to_timestamp(jd: Column) -> Column:
    return F.timestamp_micros(F.round((jd - UNIX_ZERO_JD) * DAY_SECONDS * 1e6).cast("long"))


def night(jd: Column) -> Column:
    """Integer Julian date: nights change at noon."""
    return F.floor(jd)


def phase(jd: Column, epoch: float, period: float) -> Column:
    return F.pmod((jd - epoch) / period, F.lit(1.0))
