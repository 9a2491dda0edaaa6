"""Fits of single series: an ephemeris over a grid of periods, and eruptions by a likelihood scan."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from skyloom.functions import missing
from skyloom.functions.special import ERFC_SERIES
from skyloom.operators.timeseries import DAY
from skyloom.sources.shared import written

EPOCH = 2455828.9  # phases are counted from this Julian date


def spline_basis(t: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Cubic B-splines over the knots, clamped at both ends, a column each; 0 outside."""
    degree = 3
    full = np.concatenate([[knots[0]] * degree, knots, [knots[-1]] * degree])
    cell = np.clip(np.searchsorted(knots, t, side="right") - 1, 0, max(len(knots) - 2, 0))
    inside = (t >= knots[0]) & (t <= knots[-1]) & (len(knots) > 1)
    basis = np.zeros((len(t), len(full) - 1))
    basis[np.arange(len(t)), cell + degree] = inside
    for d in range(1, degree + 1):
        n = len(full) - 1 - d
        left, right = full[d : d + n] - full[:n], full[d + 1 : d + 1 + n] - full[1 : 1 + n]
        up = np.where(left > 0, (t[:, None] - full[:n]) / np.where(left > 0, left, 1), 0)
        down = np.where(right > 0, (full[d + 1 : d + 1 + n] - t[:, None]) / np.where(right > 0, right, 1), 0)
        basis = up * basis[:, :n] + down * basis[:, 1 : n + 1]
    return basis


def _harmonics(t: np.ndarray, period: float, harmonics: int) -> np.ndarray:
    turn = 2 * np.pi * (t - EPOCH) / period
    return np.stack([f(k * turn) for k in range(1, harmonics + 1) for f in (np.cos, np.sin)], 1)


def fit_ephemeris(df: DataFrame, periods: list[float], t: str = "t", mag: str = "mag", err: str = "err", spacing: float = 120.0, harmonics: int = 2) -> DataFrame:
    """period, chi2, dof, amplitudes of the harmonics and whether it is the best, for each trial period of one series.

    The model is a sum of harmonics and a free cubic spline with knots every ``spacing`` days.
    A weighted least-squares fit needs only sums over the points: a task adds up its own for
    all periods, those that don't depend on the period once, and every period is then solved
    for itself. So the points are read once, whatever the number of periods, and a task holds
    periods x splines numbers. Points without a finite time, magnitude and positive error
    don't count; a series without any gives no rows.
    """
    spark = df.sparkSession
    good = missing.is_finite(F.col(t)) & missing.is_finite(F.col(mag)) & missing.is_finite(F.col(err)) & (F.col(err) > 0)
    own = df.where(good).select(F.col(t).cast("double").alias("t"), F.col(mag).cast("double").alias("m"), F.pow(err, F.lit(-2.0)).alias("w"))
    ends = own.agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("a"), F.max("t").alias("b"), (F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("level")).first()
    shape = "period double, chi2 double, dof long, amplitudes array<double>, best boolean"
    if not ends.n:
        return spark.createDataFrame([], shape)
    knots, trial, h = np.arange(ends.a, ends.b + spacing, spacing), np.asarray(periods, float), 2 * harmonics
    nb = len(knots) + 2

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, by_period = np.zeros((nb + 1, nb + 1)), np.zeros((len(trial), h, h + nb + 1))
        for batch in batches:
            x, y, w = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            right = np.concatenate([spline_basis(x, knots), (y - ends.level)[:, None]], 1)
            common += (right * w[:, None]).T @ right
            for k, p in enumerate(trial):
                left = _harmonics(x, p, harmonics)
                by_period[k] += (left * w[:, None]).T @ np.concatenate([left, right], 1)
        rows = [common.ravel(), *by_period.reshape(len(trial), -1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(trial))), pa.array(rows, pa.list_(pa.float64()))], ["k", "sums"])

    def total(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = 0.0
        for batch in batches:  # a row a task
            found = found + np.stack(batch.column(1).to_numpy(zero_copy_only=False)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([found], pa.list_(pa.float64()))], ["k", "sums"])

    sums = written(own.mapInArrow(add_up, "k long, sums array<double>").groupBy("k").applyInArrow(total, "k long, sums array<double>"), "moments")
    common = np.asarray(sums.where("k = -1").first().sums).reshape(nb + 1, nb + 1)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.asarray(s).reshape(h, h + nb + 1)
                normal = np.block([[own[:, :h], own[:, h:-1]], [own[:, h:-1].T, common[:-1, :-1]]])
                right = np.concatenate([own[:, -1], common[:-1, -1]])
                beta = np.linalg.lstsq(normal, right, rcond=None)[0]
                out.append((trial[k], float(common[-1, -1] - 2 * beta @ right + beta @ normal @ beta), ends.n - h - nb, beta[:h].tolist()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.float64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.list_(pa.float64()))], ["period", "chi2", "dof", "amplitudes"])

    fits = written(sums.where("k >= 0").mapInArrow(solve, "period double, chi2 double, dof long, amplitudes array<double>"), "periods")
    best = fits.agg(F.min(F.struct("chi2", "period")).alias("b"))
    return fits.join(F.broadcast(best)).select("period", "chi2", "dof", "amplitudes", (F.col("period") == F.col("b.period")).alias("best"))


def minimum_epoch(amplitudes: list[float], period: float) -> float:
    """First epoch from EPOCH on at which the harmonic model is faintest, on a grid of 20,001 phases."""
    phase = np.linspace(0, 1, 20001)
    return EPOCH + period * float(phase[np.argmax(_harmonics(EPOCH + phase * period, period, len(amplitudes) // 2) @ np.asarray(amplitudes))])


# Decline times in days, starts before a bright point in decline times, and the limits of the scan.
DECLINES = (2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0)
STARTS = (0.0, 0.1, 0.3, 0.6, 1.0, 1.5, 2.5, 4.0)
FREEDOM, LIMIT_WIDTH, MISSED, SIDE_DAYS, ANCHORS, LEAST_AMPLITUDE, LEAST_NIGHTS = 3.0, 0.3, 0.02, 500.0, 15, 1.5, 2
WHOLE = 2000  # rows of a series that isn't taken apart
BOUNDED = 20_000  # points of hypotheses that are bounded at once


def log_phi(x: np.ndarray) -> np.ndarray:
    """Logarithm of the normal distribution function, by the series of the column function of that name."""
    x = np.asarray(x, float)
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.5 * z)
    tail = np.log(t) - z * z + np.polyval(ERFC_SERIES[::-1], t) - math.log(2)
    return np.where(x < 0, tail, np.log1p(-np.exp(tail)))


def seen_likelihood(residual: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Log density of a detection: Student's t."""
    norm = math.lgamma((FREEDOM + 1) / 2) - math.lgamma(FREEDOM / 2) - 0.5 * math.log(FREEDOM * math.pi)
    return norm - np.log(sigma) - (FREEDOM + 1) / 2 * np.log1p((residual / sigma) ** 2 / FREEDOM)


def saturated_likelihood(residual: np.ndarray) -> np.ndarray:
    """Log probability of a saturated detection, which only bounds the brightness from one side."""
    return log_phi((residual + 0.5) / 0.3)


def unseen_likelihood(model: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Log probability of no detection, by how far the model is below the plate's limit."""
    return np.log(MISSED + (1 - MISSED) * np.exp(log_phi((model - limit) / LIMIT_WIDTH)))


def decline(days: np.ndarray, t2: float) -> np.ndarray:
    """Flux in units of the peak: a rise of three days, then a power law."""
    after = np.maximum(days, 0) / (t2 / (10 ** (0.8 / 1.75) - 1)) + 1
    return np.where(days >= 0, after**-1.75, np.where(days > -3, 10 ** (0.8 * np.minimum(days, 0)), 0.0))


STEP, LEVEL_STEP = 5, 8  # neighbouring peaks that are bounded together, and constant levels of which one is tried
WIDEST = 80.0  # magnitudes between peak and quiet level that bounds in single precision allow for
# Log probabilities of no detection in steps of 1 / UNSEEN_GRID; from UNSEEN_END on, either way, they don't change any more.
UNSEEN_GRID, UNSEEN_END = 512, 12
UNSEEN = unseen_likelihood(np.arange(-UNSEEN_END * UNSEEN_GRID, UNSEEN_END * UNSEEN_GRID + 1) / UNSEEN_GRID * LIMIT_WIDTH, np.float64(0)).astype(np.float32)


def _unseen_about(model: np.ndarray, limit: np.ndarray, up: bool) -> np.ndarray:
    """Log probability of no detection from the table: from a place above, or from one below."""
    at = (model - limit) * np.float32(UNSEEN_GRID / LIMIT_WIDTH)
    at = np.ceil(at + 1) if up else np.floor(at - 1)
    return UNSEEN[np.clip(at, -UNSEEN_END * UNSEEN_GRID, UNSEEN_END * UNSEEN_GRID).astype(np.int32) + UNSEEN_END * UNSEEN_GRID]


def _windows(x: dict[str, np.ndarray], t0: np.ndarray, t2: np.ndarray, faint: float) -> tuple[np.ndarray, ...]:
    """First and last points, quiet level beside them and brightest detection of each hypothesis; x is sorted by time."""
    t, mag, det = x["t"], x["mag"], x["det"]
    level = np.where(det, mag, np.maximum(np.nan_to_num(x["lim"], nan=faint), faint))
    begin, end = t0 - 3 * DAY, t0 + 10 * t2 * DAY
    lo, hi = np.searchsorted(t, begin), np.searchsorted(t, end, "right")
    before, after = np.searchsorted(t, begin - SIDE_DAYS * DAY), np.searchsorted(t, end + SIDE_DAYS * DAY, "right")
    by_level, bright = np.argsort(level), np.flatnonzero(det & ~np.isnan(mag))
    bright = bright[np.argsort(mag[bright])]
    quiet, brightest = np.full(len(t0), faint), np.full(len(t0), np.nan)
    some = max(1, 1_000_000 // max(len(t), 1))
    for k in range(0, len(t0), some):
        own = slice(k, k + some)
        a, b, c, d = (y[own, None] for y in (before, lo, hi, after))
        n = (b - a + d - c).ravel()
        rank = np.cumsum(((by_level >= a) & (by_level < b)) | ((by_level >= c) & (by_level < d)), 1, dtype=np.int32)
        middle = [level[by_level[np.argmax(rank > place[:, None], 1)]] for place in ((n - 1) // 2, n // 2)]
        quiet[own] = np.where(n >= 5, (middle[0] + middle[1]) / 2, faint)
        if len(bright):
            inside = (bright >= b) & (bright < c)
            first = np.argmax(inside, 1)
            brightest[own] = np.where(inside[np.arange(len(inside)), first], mag[bright[first]], np.nan)
    return lo, hi, quiet, brightest


def _bounds(x: dict[str, np.ndarray], t0: np.ndarray, t2: np.ndarray, lo: np.ndarray, hi: np.ndarray, quiet: np.ndarray, brightest: np.ndarray, n_peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the score of each hypothesis can't exceed, and by how much at least a constant level lowers the score against the quiet one.

    STEP neighbouring peaks at a time: between the models of the first and the last of them every point
    takes the model that suits it best. Of the constant levels the quiet one and every LEVEL_STEP-th are tried.
    In single precision, with residuals and sums better (of levels worse) by more than its errors.
    """
    start = brightest - 2.0
    cells, j = hi - lo, int(-(-n_peaks.max() // STEP))
    starts = np.concatenate([[0], np.cumsum(cells)[:-1]])
    of = np.repeat(np.arange(len(t0)), cells)
    at = np.arange(cells.sum()) - starts[of] + lo[of]
    days = ((x["t"][at] - t0[of]) / DAY).astype(np.float32)
    fall = (t2 / (10 ** (0.8 / 1.75) - 1)).astype(np.float32)[of]
    log_shape = np.where(days >= 0, np.float32(-1.75) * np.log(np.maximum(days, 0) / fall + 1), np.where(days > -3.001, np.float32(0.8 * math.log(10)) * days, -np.inf))
    shift = (0.4 * math.log(10) * np.minimum(quiet - start, WIDEST)).astype(np.float32)[of]
    # Brightness over the quiet level at every STEP-th peak, the brightest first.
    ratio = np.exp(log_shape + shift)[:, None] * np.exp(np.float32(-0.04 * STEP * math.log(10)) * np.arange(j + 1, dtype=np.float32))
    over = np.float32(-2.5 / math.log(10)) * np.log(1 + ratio)
    above, best = (x["mag"][at] - quiet[of]).astype(np.float32), np.zeros((len(at), j), np.float32)
    det, sat, lim = x["det"][at], x["sat"][at], x["lim"][at]
    plain, full, blank = np.flatnonzero(det & ~sat), np.flatnonzero(det & sat), np.flatnonzero(~det & np.isfinite(lim))
    scale, y, o = (1 / (FREEDOM * x["sig"][at][plain] ** 2)).astype(np.float32)[:, None], above[plain, None], over[plain]
    off = np.maximum(np.maximum(y - o[:, 1:], o[:, :-1] - y) - np.float32(3e-4), 0)
    best[plain] = np.nan_to_num(np.float32((FREEDOM + 1) / 2) * (np.log(1 + y * y * scale) - np.log(1 + off * off * scale)), nan=0.0)
    if len(full):
        y = above[full, None].astype(float)
        best[full] = saturated_likelihood(y - over[full, :-1] + 3e-4) - saturated_likelihood(y)
    if len(blank):
        below = (lim[blank] - quiet[of][blank]).astype(np.float32)[:, None]
        best[blank] = _unseen_about(over[blank, 1:], below, True) - _unseen_about(np.zeros_like(below), below, False)
    total = np.add.reduceat(best, starts, axis=0, dtype=np.float64)
    total[np.arange(j) >= -(-n_peaks // STEP)[:, None]] = -np.inf
    # Constant levels over the quiet one, a grid's every LEVEL_STEP-th.
    n_levels = np.maximum(1 + np.floor(np.minimum(quiet - brightest + 1.0, 2 * WIDEST) / (0.1 * LEVEL_STEP)), 1).astype(int)
    here = (brightest - 0.5 - quiet).astype(np.float32)[of][:, None] + np.float32(0.1 * LEVEL_STEP) * np.arange(n_levels.max(), dtype=np.float32)
    flat = np.zeros(here.shape, np.float32)
    y, off = above[plain, None], np.abs(above[plain, None] - here[plain]) + np.float32(3e-4)
    flat[plain] = np.nan_to_num(np.float32((FREEDOM + 1) / 2) * (np.log(1 + y * y * scale) - np.log(1 + off * off * scale)), nan=0.0)
    if len(full):
        y = above[full, None].astype(float)
        flat[full] = saturated_likelihood(y - here[full] - 3e-4) - saturated_likelihood(y)
    if len(blank):
        flat[blank] = _unseen_about(here[blank], below, False) - _unseen_about(np.zeros_like(below), below, True)
    level = np.add.reduceat(flat, starts, axis=0, dtype=np.float64)
    level[np.arange(n_levels.max()) >= n_levels[:, None]] = -np.inf
    lowered = np.nan_to_num(np.maximum(2 * level.max(1) - 2e-4 * cells - 1e-3, 0), nan=0.0)
    bound = 2 * total.max(1) + 2e-4 * cells + 1e-3 - lowered
    return np.where((quiet - start <= WIDEST) & ~np.isnan(bound), bound, np.inf), lowered


def _scan(x: dict[str, np.ndarray], t0: np.ndarray, t2: np.ndarray, faint: float, least_nights: int) -> tuple | None:
    """number of the hypothesis, score, peak, amplitude, nights, plates and contradictions of the best one; the earlier of equals.

    x is sorted by time. Hypotheses whose nights can't suffice are left out before anything is
    computed. The others are bounded, and computed from the highest bound down as long as it
    isn't below the best score: those left then can't be the best.
    """
    t, mag, lim, sig, det, sat = x["t"], x["mag"], x["lim"], x["sig"], x["det"], x["sat"]
    seen_t = t[det]
    # A night begins half a day after the last detection or later, so nights of some detections are at most those that begin among all.
    first, last = np.searchsorted(seen_t, t0 - 3 * DAY), np.searchsorted(seen_t, t0 + 10 * t2 * DAY, "right")
    begins = np.concatenate([[0], np.cumsum(np.diff(seen_t * 365.25) > 0.5)]) if len(seen_t) else np.zeros(1, int)
    span = np.where(last > first, begins[np.minimum(np.maximum(last, 1), len(begins)) - 1] - begins[np.minimum(first, len(begins) - 1)] + 1, 0)
    number = np.flatnonzero(span >= max(least_nights, 1))
    if not len(number):
        return None
    lo, hi, quiet, brightest = _windows(x, t0[number], t2[number], faint)
    stop = np.minimum(brightest + 3.0, quiet - LEAST_AMPLITUDE)
    with np.errstate(invalid="ignore"):
        good = np.flatnonzero(stop > brightest - 2.0)
    number, lo, hi, quiet, brightest, stop = (y[good] for y in (number, lo, hi, quiet, brightest, stop))
    n_peaks = np.ceil((stop - brightest + 2.0) / 0.1 + 1e-6).astype(int)
    bound, lowered, upto = np.empty(len(number)), np.empty(len(number)), np.cumsum(hi - lo)
    a = 0
    with np.errstate(all="ignore"):
        while a < len(number):  # few cells in memory
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + BOUNDED, "right")))
            own = slice(a, b)
            bound[own], lowered[own] = _bounds(x, t0[number[own]], t2[number[own]], lo[own], hi[own], quiet[own], brightest[own], n_peaks[own])
            a = b
    best, part, cells, most = None, [], 0, 100
    order = np.argsort(-bound, kind="stable").tolist()
    for i, k in enumerate(order, 1):
        if bound[k] < (best[1] if best else 0.0):
            break
        part.append((int(number[k]), slice(int(lo[k]), int(hi[k])), float(quiet[k]), brightest[k], np.arange(brightest[k] - 2.0, stop[k], 0.1), lowered[k]))
        cells += hi[k] - lo[k]
        # Few of them in memory: a point has some fifty models of a hypothesis. The first ones show how good the best must be.
        if i == len(order) or cells > most:
            best, part, cells, most = _best_of(part, best, t, mag, lim, sig, det, sat, t0, t2, least_nights), [], 0, 1000
    return _best_of(part, best, t, mag, lim, sig, det, sat, t0, t2, least_nights) if part else best


def _best_of(found: list[tuple], best: tuple | None, t, mag, lim, sig, det, sat, t0, t2, least_nights: int) -> tuple | None:
    """The best of some hypotheses and of the best before them."""
    cells, width = [own.stop - own.start for _, own, *_ in found], [len(f[4]) for f in found]
    at = np.concatenate([np.arange(own.start, own.stop) for _, own, *_ in found])
    of = np.repeat(np.arange(len(found)), cells)
    h, quiet = np.asarray([f[0] for f in found]), np.asarray([f[2] for f in found])
    shape = decline((t[at] - t0[h][of]) / DAY, t2[h][of])
    starts = np.concatenate([[0], np.cumsum(cells)[:-1]])

    def total(model: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log likelihoods of models, a row a point, summed over each hypothesis's points."""
        out, d, s = np.zeros_like(model), det[at], sat[at]
        plain, full, blank = d & ~s, d & s, ~d & np.isfinite(lim[at])
        out[plain] = np.nan_to_num(seen_likelihood(mag[at][plain, None] - model[plain], sig[at][plain, None]))
        if full.any():
            out[full] = saturated_likelihood(mag[at][full, None] - model[full])
        if blank.any():
            out[blank] = unseen_likelihood(model[blank], lim[at][blank, None])
        return np.add.reduceat(out, starts, axis=0)

    peaks = np.stack([np.concatenate([f[4], np.full(max(width) - len(f[4]), f[4][-1])]) for f in found])
    models = -2.5 * np.log10(10 ** (-0.4 * quiet[of])[:, None] + (10 ** (-0.4 * peaks))[of] * shape[:, None])
    likely = total(models, at, starts)
    top = np.argmax(likely, 1)  # a repeated last peak never comes before it
    bound = 2 * (likely[np.arange(len(found)), top] - total(np.repeat(quiet, cells)[:, None], at, starts)[:, 0]) - np.asarray([f[5] for f in found])
    for k in np.argsort(-bound, kind="stable").tolist():
        if bound[k] + 1e-6 < (best[1] if best else 0.0):
            break
        number, own, calm, brightest, *_ = found[k]
        model = models[starts[k] : starts[k] + cells[k], top[k]]
        d = det[own]
        support = d & (model < calm - 0.5) & (np.abs(np.where(d, mag[own], 0.0) - model) < 3 * sig[own] + 0.5)
        nights = int(1 + (np.diff(t[own][support] * 365.25) > 0.5).sum()) if support.any() else 0
        if nights < least_nights:
            continue
        levels = np.concatenate([[calm], np.arange(brightest - 0.5, calm + 0.51, 0.1)])
        null = total(np.broadcast_to(levels, (cells[k], len(levels))), np.arange(own.start, own.stop), np.zeros(1, int)).max()
        score = 2 * float(likely[k, top[k]] - null)
        if score > 0 and (best is None or (-score, number) < (-best[1], best[0])):
            peak = float(peaks[k, top[k]])
            best = (number, score, peak, calm - peak, nights, int(support.sum()), int((~d & (model < lim[own] - 0.5)).sum()))
    return best


def _hypotheses(place: np.ndarray, anchor: np.ndarray, own: int, allow: tuple[float, float] | None, masks: list[tuple[float, float]]) -> tuple[np.ndarray, ...]:
    """Place, number, start and decline time of the hypotheses of all anchors of a series, or (own not -1) those of one place."""
    t2, back = np.repeat(DECLINES, len(STARTS)), np.tile(STARTS, len(DECLINES))
    t0, at = (anchor[:, None] - back * t2 * DAY).ravel(), np.tile(np.arange(len(t2)), len(anchor))
    place, t2 = np.repeat(place, len(t2)), np.tile(t2, len(anchor))
    _, first = np.unique(np.stack([np.rint(t0 * 365.25), t2]), axis=1, return_index=True)  # of equals the first by place and number
    keep = np.zeros(len(t0), bool)
    keep[first] = True
    if own != -1:
        keep &= place == own
    if allow is not None:
        keep &= (t0 >= allow[0]) & (t0 <= allow[1])
    else:
        for low, high in masks:
            keep &= ~((t0 >= low) & (t0 <= high))
    return place[keep], at[keep], t0[keep], t2[keep]


EVENT = "score double, t0 double, t2 double, peak double, amplitude double, nights int, plates int, contradictions int"


def likelihood_scan(df: DataFrame, key: str, faint: float, allow: tuple[float, float] | None = None, masks: list[tuple[float, float]] = [], least_nights: int = LEAST_NIGHTS) -> DataFrame:  # noqa: B006
    """The best eruption of each series: score, start, decline time, peak, amplitude, nights, plates and contradicting limits.

    Rows have t (Julian years), mag, det, lim, sig, sat and envelope. Bright points, the ANCHORS
    brightest over the envelope of a series, start hypotheses: each decline time at each distance
    before the point. A hypothesis is the likelihood ratio of the decline template, added in flux to
    the quiet level beside it, against the best constant level. Starts of one decline time within a
    rounded day are one hypothesis, that of the first anchor. A series of over WHOLE rows is taken apart by anchor,
    and a task gets only the rows that an anchor's hypotheses can reach. Series without a supported
    hypothesis give no row.
    """
    own = df.select(key, *[F.col(c).cast("double").alias(c) for c in ("t", "mag", "lim", "sig", "envelope")], *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("det", "sat")]).where("t IS NOT NULL")
    # Everything is dealt by key once: anchors are told to all rows of their series.
    above, series = F.col("mag") - F.col("envelope"), W.partitionBy(key)
    own = own.withColumn("above", F.when(F.col("det") & (above < -0.75), above)).withColumn("many", F.count(F.lit(1)).over(series)).withColumn("bright", F.count("above").over(series))
    order = series.orderBy(F.col("above").isNull(), F.when(F.col("bright") > ANCHORS, F.col("above")), "t", "above")
    place = F.row_number().over(order)
    own = own.where("bright > 0").withColumn("place", F.when(F.col("above").isNotNull() & (place <= ANCHORS), place))
    anchors = F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", F.col("t").alias("anchor")))).over(series))
    reach_back, reach_on = (max(DECLINES) * max(STARTS) + 3 + SIDE_DAYS) * DAY, (10 * max(DECLINES) + SIDE_DAYS) * DAY
    # A series of up to WHOLE rows goes to its task once, with all its hypotheses; of a longer one each anchor's reach.
    reached = F.filter("anchors", lambda a: F.col("t").between(a["anchor"] - reach_back, a["anchor"] + reach_on))
    own = own.withColumn("anchors", anchors).withColumn("__place", F.explode(F.when(F.col("many") <= WHOLE, F.array(F.lit(-1))).otherwise(F.transform(reached, lambda a: a["place"]))))
    rows = own.groupBy(key, "__place").agg(F.sort_array(F.collect_list(F.struct("t", "mag", "lim", "sig", "det", "sat"))).alias("x"), F.first("anchors").alias("anchors"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, own, x, anchors in zip(*batch.columns, strict=True):
                points, told = pa.RecordBatch.from_struct_array(x.values), pa.RecordBatch.from_struct_array(anchors.values)
                x = {c: points.column(c).to_numpy(zero_copy_only=False).astype(bool if c in ("det", "sat") else float) for c in points.schema.names}
                place, at, t0, t2 = _hypotheses(told.column("place").to_numpy(), told.column("anchor").to_numpy(), own.as_py(), allow, masks)
                found = _scan(x, t0, t2, faint, least_nights)
                if found is not None:
                    n, score, *rest = found
                    out.append((k.as_py(), int(place[n]), int(at[n]), score, float(t0[n]), float(t2[n]), *rest))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(shape)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    kind = dict(own.dtypes)[key]
    told = f"{key} {kind}, place int, at int, {EVENT}"
    shape = to_arrow_schema(own.sparkSession.createDataFrame([], told).schema)
    # Dealt by number: few bytes are much work here, and adaptive execution would gather them in one task.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.select(key, "__place", "x", "anchors").repartition(n, key, "__place").mapInArrow(scan, told)
    best = found.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "place", "at", *[c.split()[0] for c in EVENT.split(", ")])).alias("b"))
    return best.select(key, *[f"b.{c.split()[0]}" for c in EVENT.split(", ")])
