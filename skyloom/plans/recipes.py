"""Named recipes: small declarative selections over an archive's tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators import match


@dataclass(frozen=True)
class Recipe:
    """Columns of a table under a condition, in an order, up to a number of rows; with a cone (ra, dec, radius in degrees) around a position."""

    summary: str
    table: str
    columns: tuple[str, ...]
    where: str = "true"
    order: str | None = None
    most: int | None = None
    cone: tuple[float, float, float] | None = None


# Selections that the sky archives are sampled by.
RECIPES = {
    "gaia-bright-nearby": Recipe("Bright nearby seed stars", "gaia_source", ("source_id", "ra", "dec", "parallax", "phot_g_mean_mag"), "parallax > 20 AND phot_g_mean_mag < 10", "phot_g_mean_mag", 25),
    "wise-agn-colors": Recipe("Sources with the colours of active nuclei", "allwise_p3as_psd", ("designation", "ra", "dec", "w1mpro", "w2mpro", "w3mpro"), "w1mpro - w2mpro > 0.8 AND w2mpro < 15", None, 25),
    "heasarc-chandra-gc": Recipe("Observations near the Galactic Centre", "chanmaster", ("name", "ra", "dec", "time", "status"), most=25, cone=(266.4, -29.0, 0.5)),
    "euclid-q1-smoke": Recipe("A few catalogued objects", "mer_catalogue", ("object_id", "right_ascension", "declination"), most=10),
}


def select(rows: DataFrame, recipe: Recipe) -> DataFrame:
    """Applies a recipe to its table."""
    found = rows.where(recipe.where)
    if recipe.cone:
        found = found.where(match.in_cone("ra", "dec", *recipe.cone))
    if recipe.order:
        found = found.orderBy(F.col(recipe.order))
    found = found.select(*[F.col(f"`{c}`") for c in recipe.columns])
    return found.limit(recipe.most) if recipe.most else found


def in_days(rows: DataFrame, time: str, until: float, days: float = 3.0) -> DataFrame:
    """Rows whose time (in days) lies within the last ``days`` before ``until``, the newest first."""
    return rows.where(F.col(time).between(until - days, until)).orderBy(F.col(time).desc())
