"""All registered queries of the engine and their oracle SQL."""

from skyloom.queries import curves, decisions, extensions, fits, matching, plans, plate_rows, series, sky, streams, survey, tables, targets  # noqa: F401  registers the queries
from skyloom.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
