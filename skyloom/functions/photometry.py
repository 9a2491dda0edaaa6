"""Magnitudes, rates and fluxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def magnitude_to_flux(mag: Column, zero_flux: float, zero_mag: float = 0.0, extinction: float = 0.0, reddening: float = 0.0) -> Column:
    """Dereddened flux from a magnitude and its band's zero point."""
    return zero_flux * F.pow(F.lit(10.0), -0.4 * (mag - extinction * reddening - zero_mag))


def rate_to_magnitude(rate: Column, zero_mag: float, year: Column | None = None, decline: float = 0.01) -> Column:
    """Magnitude of a count rate; with year the sensitivity loss since 2005 is undone."""
    corrected = rate if year is None else rate / F.pow(F.lit(1 - decline), year - 2005.0)
    return zero_mag - 2.5 * F.log10(F.greatest(corrected, F.lit(1e-6)))


def coincidence_corrected(rate: Column, frame_time: float, dead_fraction: float, polynomial: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """Corrected count rate and whether the frame is saturated (0.97 counts or more)."""
    x = rate * frame_time
    c = F.least(F.greatest(x, F.lit(0.0)), F.lit(0.97))
    live = 1 - dead_fraction
    theory = -F.log1p(-live * c) / (live * frame_time)
    factor = F.lit(1.0)
    power = F.lit(1.0)
    for a in polynomial:
        power = power * c
        factor = factor + a * power
    return theory * factor, x >= 0.97


def template_flux(days: Column, t2: Column) -> Column:
    """Peak-normalised eruption: three days of rise, then a power-law decline that fades two magnitudes in t2."""
    tau = t2 / (10 ** (0.8 / 1.75) - 1)
    return F.when(days >= 0, F.pow(1 + days / tau, F.lit(-1.75))).when(days > -3, F.pow(F.lit(10.0), -2.4 * (-days / 3))).otherwise(0.0)


def exposure_minutes(mag: Column, reference_mag: float, reference_minutes: float) -> Column:
    """Time to reach the same depth, between 2 and 45 minutes."""
    return F.least(F.greatest(reference_minutes * F.pow(F.lit(10.0), 0.4 * (mag - reference_mag)), F.lit(2.0)), F.lit(45.0))


def kinematic_dipole(velocity_kms: Column, alpha: Column, slope: Column) -> Column:
    """Expected number-count dipole of a moving observer."""
    return (2 + slope * (1 + alpha)) * velocity_kms / 299792.458


def reduced_proper_motion(mag: Column, motion_mas: Column) -> Column:
    """Magnitude and proper motion in one number, larger for stars of low luminosity; NULL without motion."""
    return mag + 5 * F.log10(motion_mas / 1000) + 5


def extinction(latitude: Column) -> Column:
    """V extinction of a plane-parallel dust layer at a galactic latitude, between 0.02 and 5 magnitudes."""
    height = F.least(F.greatest(F.abs(latitude), F.lit(1.0)), F.lit(85.0))
    return F.least(F.greatest(0.05 / F.sin(F.radians(height)), F.lit(0.02)), F.lit(5.0))


def scattering_ms(dispersion: Column) -> Column:
    """Scattering time in milliseconds of a dispersion measure: a parabola in its logarithm."""
    x = F.log10(F.greatest(dispersion, F.lit(1.0)))
    return F.greatest(F.pow(F.lit(10.0), -3.86 + 0.154 * x + 1.07 * x * x) / 1000, F.lit(1e-4))


def dispersion_redshift(excess: Column, halo: float = 60.0) -> Column:
    """Redshift of what dispersion is left beyond a halo, at 950 units a redshift."""
    return F.greatest(excess - halo, F.lit(0.0)) / 950
