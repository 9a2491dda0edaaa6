"""Functions for SQL text: scalar functions, a grouped aggregate and a table function, registered with a session.

Scalar functions are SQL functions where Spark can express them: their bodies become part
of the plan and stay in generated code. ``bald`` works on Arrow batches. ``mad_sigma``
needs all values of its group at once, so it is for groups that fit in a task, such as
a series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_APART = "pow(sin(radians(dec2 - dec1) / 2), 2) + cos(radians(dec1)) * cos(radians(dec2)) * pow(sin(radians(ra2 - ra1) / 2), 2)"
#: Held at 1 against rounding; missing and NaN stay what they are, which least() would not do.
_ROOM = f"CASE WHEN {_APART} > 1 AND NOT isnan({_APART}) THEN 1D ELSE {_APART} END"
_Z, _T = "sin(radians(lat))", "pmod(lon, 360D) / 90"
_JP, _JM = f"floor(nside * (0.5D + {_T}) - 0.75D * nside * {_Z})", f"floor(nside * (0.5D + {_T}) + 0.75D * nside * {_Z})"
_RING = f"(nside + 1 + {_JP} - {_JM})"
_BELT = f"2 * nside * (nside - 1) + ({_RING} - 1) * 4 * nside + pmod(floor(({_JP} + {_JM} - nside + (1 - pmod({_RING}, 2)) + 1) / 2), 4 * nside)"
_PART, _WIDE = f"({_T} - floor({_T}))", f"(nside * sqrt(3 * (1 - abs({_Z}))))"
_CAP = f"(floor({_PART} * {_WIDE}) + floor((1 - {_PART}) * {_WIDE}) + 1)"
_AT = f"pmod(floor({_T} * {_CAP}), 4 * {_CAP})"
_POLE = f"CASE WHEN {_Z} > 0 THEN 2 * {_CAP} * ({_CAP} - 1) + {_AT} ELSE 12 * nside * nside - 2 * {_CAP} * ({_CAP} + 1) + {_AT} END"

SQL_FUNCTIONS = {
    "sky_sep": ("ra1 DOUBLE, dec1 DOUBLE, ra2 DOUBLE, dec2 DOUBLE", "DOUBLE", f"degrees(2 * asin(sqrt({_ROOM})))"),
    "healpix_ring": ("lon DOUBLE, lat DOUBLE, nside BIGINT", "BIGINT", f"CAST(CASE WHEN abs({_Z}) <= 2D / 3 THEN {_BELT} ELSE {_POLE} END AS BIGINT)"),
    "cone": ("ra1 DOUBLE, dec1 DOUBLE, ra2 DOUBLE, dec2 DOUBLE, radius DOUBLE", "BOOLEAN", f"dec1 BETWEEN dec2 - radius AND dec2 + radius AND degrees(2 * asin(sqrt({_ROOM}))) <= radius"),
}


def digamma(x: np.ndarray) -> np.ndarray:
    """For x > 0, by recurrence to beyond 6 and the asymptotic series."""
    x, shift = np.asarray(x, float), 0.0
    for k in range(8):
        shift = shift + 1 / (x + k)
    w = 1 / (x + 8) ** 2
    return np.log(x + 8) - 0.5 / (x + 8) - w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w / 240))) - shift


def _bald(alpha: pd.Series) -> pd.Series:
    """Information gain of a Dirichlet: entropy of its mean less its mean entropy; missing for missing evidence."""
    out = np.full(len(alpha), np.nan)
    known = alpha.notna().to_numpy()
    sizes = np.asarray([len(a) for a in alpha[known]], int)
    for k in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(known)[sizes == k]
        a = np.stack(alpha.iloc[at].to_numpy()).astype(float)
        s = a.sum(1, keepdims=True)
        p = a / s
        out[at] = np.maximum(0, (-p * np.log(p)).sum(1) + (p * (digamma(a + 1) - digamma(s + 1))).sum(1))
    return pd.Series(out).where(~np.isnan(out), None)


def _mad_sigma(x: pd.Series) -> float:
    """Robust scatter 1.4826 x the median distance from the median; 0.3 for fewer than five finite values."""
    v = x.to_numpy(dtype=float, na_value=np.nan)
    v = v[np.isfinite(v)]
    return 0.3 if len(v) < 5 else float(1.4826 * np.median(np.abs(v - np.median(v))))


class TransitTimes:
    """The next count mid-times of a periodic event at or after start: epoch, mid."""

    def eval(self, t0: float, period: float, start: float, count: int) -> Iterator[tuple[int, float]]:
        if t0 is None or period is None or start is None or count is None or period <= 0:
            return
        first = int(np.ceil((start - t0) / period))
        for k in range(first, first + count):
            yield k, float(t0 + k * period)


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL text of this session; again is no error."""
    for name, (arguments, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")

    @F.pandas_udf("double")
    def bald(alpha: pd.Series) -> pd.Series:
        return _bald(alpha)

    @F.pandas_udf("double")
    def mad_sigma(x: pd.Series) -> float:
        return _mad_sigma(x)

    spark.udf.register("bald", bald)
    spark.udf.register("mad_sigma", mad_sigma)
    spark.udtf.register("transit_times", F.udtf(TransitTimes, returnType="epoch long, mid double"))
