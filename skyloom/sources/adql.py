"""Archive queries: the constructs of the astronomical query language, rewritten to Spark SQL.

``SELECT TOP n`` becomes a trailing LIMIT, double-quoted identifiers become
back-quoted ones, and CONTAINS(POINT, CIRCLE) = 1 becomes a haversine test with a
declination band in front, which a scan can push down. Everything else is Spark SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
_NAME = r"[A-Za-z_][\w.`]*"
_POINT = rf"POINT\s*\(\s*'ICRS'\s*,\s*({_NAME})\s*,\s*({_NAME})\s*\)"
_CIRCLE = rf"CIRCLE\s*\(\s*'ICRS'\s*,\s*({_NUMBER})\s*,\s*({_NUMBER})\s*,\s*({_NUMBER})\s*\)"
_CONTAINS = rf"CONTAINS\s*\(\s*{_POINT}\s*,\s*{_CIRCLE}\s*\)"


def _cone(m: re.Match) -> str:
    ra, dec, ra0, dec0, radius = m.groups()[:5]
    h = f"pow(sin(radians({dec} - ({dec0})) / 2), 2) + cos(radians({dec})) * cos(radians({dec0})) * pow(sin(radians({ra} - ({ra0})) / 2), 2)"
    return f"({dec} BETWEEN {float(dec0) - float(radius)} AND {float(dec0) + float(radius)} AND degrees(2 * asin(sqrt(least(1.0D, {h})))) <= {radius})"


def to_spark(text: str) -> str:
    """Spark SQL for an archive query; string literals are left alone."""
    literals: list[str] = []

    def keep(m: re.Match) -> str:
        literals.append(m[0])
        return f"\x00{len(literals) - 1}\x00"

    icrs = re.sub(r"'ICRS'", "ICRS", text)
    sql = re.sub(r"'(?:[^']|'')*'", keep, icrs)
    sql = re.sub(r'"((?:[^"]|"")*)"', lambda m: "`" + m[1].replace("`", "``") + "`", sql)
    bare = _CONTAINS.replace("'ICRS'", "ICRS")
    sql = re.sub(rf"{bare}\s*=\s*1|1\s*=\s*{bare}", lambda m: _cone(_Shifted(m)), sql, flags=re.IGNORECASE)
    top = re.search(r"^\s*SELECT\s+TOP\s+([0-9]+)\s", sql, flags=re.IGNORECASE)
    if top:
        sql = re.sub(r"^(\s*SELECT)\s+TOP\s+[0-9]+\s", r"\1 ", sql, count=1, flags=re.IGNORECASE).rstrip().rstrip(";") + f" LIMIT {top[1]}"
    return re.sub("\x00([0-9]+)\x00", lambda m: literals[int(m[1])], sql)


class _Shifted:
    """The five groups of whichever side of the equation matched."""

    def __init__(self, m: re.Match):
        self._groups = tuple(g for g in m.groups() if g is not None)

    def groups(self) -> tuple:
        return self._groups


def run(spark: SparkSession, text: str, **values: object) -> DataFrame:
    """Runs an archive query over the registered views; values bind its named parameters (:name)."""
    return spark.sql(to_spark(text), args=values or None)


def quote(value: str) -> str:
    """A string literal of the archives' dialect: quotes are doubled."""
    return "'" + value.replace("'", "''") + "'"
