"""Ephemeris fits and the likelihood scan against plain numpy and plain loops."""

import math

import numpy as np
import pytest

from skyloom.operators import series_fits

DAY = 1 / 365.25


def de_boor(t, knots, i, d, full):
    if d == 0:
        last = max(k for k in range(len(full) - 1) if full[k] < full[k + 1])
        return float(full[i] <= t < full[i + 1] or (i == last and t == full[-1]))
    a = (t - full[i]) / (full[i + d] - full[i]) * de_boor(t, knots, i, d - 1, full) if full[i + d] > full[i] else 0.0
    b = (full[i + d + 1] - t) / (full[i + d + 1] - full[i + 1]) * de_boor(t, knots, i + 1, d - 1, full) if full[i + d + 1] > full[i + 1] else 0.0
    return a + b


def design(t, period, spacing):
    knots = np.arange(t.min(), t.max() + spacing, spacing)
    full = np.concatenate([[knots[0]] * 3, knots, [knots[-1]] * 3])
    turn = 2 * np.pi * (t - series_fits.EPOCH) / period
    return np.stack([np.cos(turn), np.sin(turn), np.cos(2 * turn), np.sin(2 * turn), *[np.array([de_boor(x, knots, i, 3, full) for x in t]) for i in range(len(full) - 4)]], 1)


def test_ephemeris_finds_a_planted_period_and_equals_numpy(spark):
    rng = np.random.default_rng(0)
    t = np.sort(2455000 + rng.uniform(0, 700, 400))
    err = rng.uniform(0.02, 0.08, 400)
    mag = 10 + 0.3 * np.sin(t / 150) + 0.12 * np.cos(4 * np.pi * (t - series_fits.EPOCH) / 227.6 + 0.4) + rng.normal(size=400) * err
    rows = [*zip(t.tolist(), mag.tolist(), err.tolist(), strict=True), (None, 1.0, 0.1), (float(t[5]), float("nan"), 0.1), (float(t[5]), 3.0, 0.0)]
    periods = [200.0, 215.0, 227.6, 240.0, 260.0]
    got = {r.period: r for r in series_fits.fit_ephemeris(spark.createDataFrame(rows, "t double, mag double, err double").repartition(5), periods).collect()}
    for p in periods:
        x, sw = design(t, p, 120.0), 1 / err
        beta = np.linalg.lstsq(x * sw[:, None], mag * sw, rcond=None)[0]
        assert abs(got[p].chi2 - np.sum(((mag - x @ beta) * sw) ** 2)) < 1e-4 and got[p].dof == 400 - x.shape[1]
        assert np.allclose(got[p].amplitudes, beta[:4], atol=1e-6)
        assert got[p].best == (p == 227.6)
    deepest = series_fits.minimum_epoch(got[227.6].amplitudes, 227.6)
    turn = 2 * np.pi * (deepest - series_fits.EPOCH) / 227.6
    a = got[227.6].amplitudes
    value = lambda x: a[0] * np.cos(x) + a[1] * np.sin(x) + a[2] * np.cos(2 * x) + a[3] * np.sin(2 * x)
    assert value(turn) >= value(np.linspace(0, 2 * np.pi, 5000)).max() - 1e-4


def test_ephemeris_without_points(spark):
    assert series_fits.fit_ephemeris(spark.createDataFrame([], "t double, mag double, err double"), [1.0]).count() == 0


def log_phi(x):
    return math.log(0.5 * math.erfc(-x / math.sqrt(2))) if x > -30 else -x * x / 2 - math.log(-x) - 0.5 * math.log(2 * math.pi)


def naive_scan(rows, faint, masks=(), allow=None, nights=2):
    """rows: (t, mag, det, lim, envelope, sig, sat) in order of time."""
    value = [m if d else max(faint if lim is None else lim, faint) for _, m, d, lim, *_ in rows]
    bright = [r for r in rows if r[2] and r[1] < r[4] - 0.75]
    if len(bright) > 15:
        bright = sorted(bright, key=lambda r: r[1] - r[4])[:15]
    tried, best = set(), None

    def log_l(r, model):
        if r[2]:
            if r[6]:
                return log_phi((r[1] - model + 0.5) / 0.3)
            z = (r[1] - model) / r[5]
            return math.lgamma(2) - math.lgamma(1.5) - 0.5 * math.log(3 * math.pi) - math.log(r[5]) - 2 * math.log1p(z * z / 3)
        return 0.0 if r[3] is None else math.log(0.02 + 0.98 * math.exp(log_phi((model - r[3]) / 0.3)))

    for b in bright:
        for t2 in (2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0):
            for k in (0.0, 0.1, 0.3, 0.6, 1.0, 1.5, 2.5, 4.0):
                t0 = b[0] - k * t2 * DAY
                if (round(t0 * 365.25), t2) in tried:
                    continue
                tried.add((round(t0 * 365.25), t2))
                if (allow and not allow[0] <= t0 <= allow[1]) or (not allow and any(lo <= t0 <= hi for lo, hi in masks)):
                    continue
                begin, end = t0 - 3 * DAY, t0 + 10 * t2 * DAY
                own = [r for r in rows if begin <= r[0] <= end]
                seen = [r for r in own if r[2]]
                if not seen:
                    continue
                side = [v for r, v in zip(rows, value, strict=True) if begin - 500 * DAY <= r[0] < begin or end < r[0] <= end + 500 * DAY]
                quiet = float(np.median(side)) if len(side) >= 5 else faint
                low = min(r[1] for r in seen)
                null = max(sum(log_l(r, m) for r in own) for m in [quiet, *np.arange(low - 0.5, quiet + 0.51, 0.1)])
                options = []
                for peak in np.arange(low - 2.0, min(low + 3.0, quiet - 1.5), 0.1):
                    models = []
                    for r in own:
                        d = (r[0] - t0) * 365.25
                        f = (1 + d / (t2 / (10 ** (0.8 / 1.75) - 1))) ** -1.75 if d >= 0 else 10 ** (0.8 * d) if d > -3 else 0.0
                        models.append(-2.5 * math.log10(10 ** (-0.4 * quiet) + 10 ** (-0.4 * peak) * f))
                    options.append((sum(log_l(r, m) for r, m in zip(own, models, strict=True)), peak, models))
                if not options:
                    continue
                top, peak, models = max(options, key=lambda o: o[0])
                score = 2 * (top - null)
                support = sorted(r[0] * 365.25 for r, m in zip(own, models, strict=True) if r[2] and m < quiet - 0.5 and abs(r[1] - m) < 3 * r[5] + 0.5)
                n = 1 + sum(b - a > 0.5 for a, b in zip(support, support[1:], strict=False)) if support else 0
                if n >= nights and score > (best[0] if best else 0):
                    best = (score, t0, t2, peak, quiet - peak, n, len(support), sum(not r[2] and r[3] is not None and m < r[3] - 0.5 for r, m in zip(own, models, strict=True)))
    return best


def series_of(seed):
    rng = np.random.default_rng(seed)
    faint, rows = 15.0, []
    for t in np.sort(1900 + rng.uniform(0, 12, 90)):
        days = (t - 1905.3) * 365.25
        flux = 10 ** (-0.4 * 14.5) + (10 ** (-0.4 * 9.5) * (1 + days / 11) ** -1.75 if days >= 0 and seed % 3 else 0)
        mag, lim = -2.5 * math.log10(flux) + rng.normal() * 0.1, 15.2 + rng.normal() * 0.3
        det = bool(mag < lim) and rng.random() > 0.1
        rows.append((float(t), float(mag) if det else None, det, None if rng.random() < 0.05 else float(lim), 14.5, 0.15, bool(rng.random() < 0.1)))
    for _ in range(3):  # an eruption is followed closely
        t = 1905.3 + rng.uniform(0, 40) * DAY
        rows.append((float(t), 10.5 + float(rng.normal()) * 0.2, True, 15.0, 14.5, 0.15, False))
    return faint, sorted(rows)


@pytest.mark.parametrize("limits", [{}, {"masks": [(1904.0, 1907.0)]}, {"allow": (1905.2, 1905.4)}])
def test_likelihood_scan_equals_plain_loops(spark, limits):
    series = {k: series_of(k)[1] for k in range(4)} | {9: [(1900.0, 10.0, True, 15.0, 14.0, 0.1, False)]}
    df = spark.createDataFrame([(k, *r) for k, rows in series.items() for r in rows] + [(3, None, 1.0, True, 1.0, 1.0, 1.0, False)], "k long, t double, mag double, det boolean, lim double, envelope double, sig double, sat boolean")
    got = {r.k: tuple(r)[1:] for r in series_fits.likelihood_scan(df, "k", 15.0, **limits).collect()}
    expected = {k: e for k, rows in series.items() if (e := naive_scan(rows, 15.0, **limits))}
    assert got.keys() == expected.keys() and (limits or len(got) >= 3)
    for k in got:
        assert np.allclose(got[k], expected[k], atol=2e-5), k


def test_scan_tries_levels_for_few_hypotheses(monkeypatch):
    rows, asked, seen = series_of(1)[1], [], series_fits.seen_likelihood
    monkeypatch.setattr(series_fits, "seen_likelihood", lambda r, s: asked.append(r.shape) or seen(r, s))
    x = {c: np.array([r[k] for r in rows], float) for k, c in ((0, "t"), (1, "mag"), (3, "lim"), (5, "sig"))} | {"det": np.array([r[2] for r in rows]), "sat": np.array([r[6] for r in rows])}
    t0, t2 = (np.array(c) for c in zip(*[(r[0] - k * d * DAY, d) for r in rows if r[2] for d in series_fits.DECLINES for k in series_fits.STARTS], strict=True))
    assert series_fits._scan(x, t0, t2, 15.0, 2) is not None
    # At most one model a hypothesis, the quiet level, and a tenth as many rows for the grid of constant levels.
    assert len(asked) < len(t0) / 4


def arrays_of(seed):
    rows = series_of(seed)[1]
    x = {c: np.array([r[k] for r in rows], float) for k, c in ((0, "t"), (1, "mag"), (3, "lim"), (5, "sig"))} | {"det": np.array([r[2] for r in rows]), "sat": np.array([r[6] for r in rows])}
    bright = [(r[1] - r[4], r[0]) for r in rows if r[2] and r[1] < r[4] - 0.75]
    anchors = np.array([t for _, t in sorted(bright)[:15]] if len(bright) > 15 else [t for _, t in bright])
    _, _, t0, t2 = series_fits._hypotheses(np.arange(1, len(anchors) + 1), anchors, -1, None, [])
    return x, t0, t2


def test_scan_computes_few_hypotheses(monkeypatch):
    asked, best_of = [], series_fits._best_of
    monkeypatch.setattr(series_fits, "_best_of", lambda found, *rest: asked.append(len(found)) or best_of(found, *rest))
    total = 0
    for seed in (1, 2, 4, 5):
        x, t0, t2 = arrays_of(seed)
        total += len(t0)
        assert series_fits._scan(x, t0, t2, 15.0, 2) is not None
    assert sum(asked) < total / 5


@pytest.mark.parametrize("sigma", [0.001, 0.15, 3.0])
def test_no_score_exceeds_its_bound(monkeypatch, sigma):
    told, bounds = [], series_fits._bounds
    monkeypatch.setattr(series_fits, "_bounds", lambda *a: told.append((*a[1:], *bounds(*a))) or told[-1][-2:])
    checked = 0
    for seed in range(4):
        x, t0, t2 = arrays_of(seed)
        x["sig"][:] = sigma
        told.clear()
        series_fits._scan(x, t0, t2, 15.0, 2)
        for a, b, lo, hi, quiet, brightest, _, bound, lowered in ((*y,) for part in told for y in zip(*part, strict=True)):
            peaks = np.arange(brightest - 2.0, min(brightest + 3.0, quiet - 1.5), 0.1)
            found = series_fits._best_of([(0, slice(lo, hi), quiet, brightest, peaks, lowered)], None, *(x[c] for c in ("t", "mag", "lim", "sig", "det", "sat")), np.array([a]), np.array([b]), 0)
            assert found is None or found[1] <= bound
            checked += found is not None
    assert checked > 100


def test_long_series_are_taken_apart_alike(spark, monkeypatch):
    df = spark.createDataFrame([(k, *r) for k in range(4) for r in series_of(k)[1]] + [(1, 1905.4, None, True, 15.0, 14.5, 0.15, False)], "k long, t double, mag double, det boolean, lim double, envelope double, sig double, sat boolean")
    whole = sorted(map(tuple, series_fits.likelihood_scan(df, "k", 15.0).collect()))
    monkeypatch.setattr(series_fits, "WHOLE", 20)
    assert sorted(map(tuple, series_fits.likelihood_scan(df, "k", 15.0).collect())) == whole and len(whole) >= 3


def test_likelihood_scan_without_rows(spark):
    df = spark.createDataFrame([], "k long, t double, mag double, det boolean, lim double, envelope double, sig double, sat boolean")
    assert series_fits.likelihood_scan(df, "k", 15.0).count() == 0


def test_log_phi():
    for x in (-60.0, -25.0, -19.0, -8.0, -1.0, 0.0, 3.0, 9.0):
        assert abs(series_fits.log_phi(np.array([x]))[0] - (log_phi(x) if x > -30 else -x * x / 2 - math.log(-x) - 0.5 * math.log(2 * math.pi))) < 1e-6 * (1 + x * x)
