"""The cluster bootstrap against copied rows in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import resample


def copied(values, clusters, seed, draws):
    """For each draw the values, each as often as its cluster is drawn."""
    w = resample.weights(np.asarray(clusters), seed, draws)
    return [np.repeat(values, w[:, d], axis=0) for d in range(draws + 1)]


def test_weights_are_poisson_and_the_same_everywhere(spark):
    w = resample.weights(np.arange(4000), 7, 50)
    assert (w[:, 0] == 1).all() and abs(w[:, 1:].mean() - 1) < 0.02 and abs(w[:, 1:].var() - 1) < 0.03
    assert abs(np.corrcoef(w[:, 1], w[:, 2])[0, 1]) < 0.06 and abs(np.corrcoef(w[:-1, 1], w[1:, 1])[0, 1]) < 0.06
    u = spark.range(-3, 50).select("id", resample.draw_uniform(7, F.lit(5), F.col("id")).alias("u")).collect()
    assert [r.u for r in u] == [resample.draw_uniform(7, 5, np.int64(r.id)) for r in u]


@pytest.mark.parametrize("range_rows", [resample.RANGE_ROWS, 7])
def test_thresholds_equal_copied_rows(spark, monkeypatch, range_rows):
    monkeypatch.setattr(resample, "RANGE_ROWS", range_rows)
    rng = np.random.default_rng(0)
    scores, clusters = np.round(rng.normal(size=300), 1), rng.integers(0, 12, 300)
    scores[:100] = 0.5  # a value of a third of the rows
    rows = spark.createDataFrame([*zip(scores.tolist(), clusters.tolist(), strict=True), (None, 1), (float("nan"), 1), (9.0, None)], "x double, c long").repartition(4)
    for q in (0.0, 0.5, 0.97, 1.0):
        got = {r.draw: (r.threshold, r.n) for r in resample.drawn_quantiles(rows, "x", "c", q, 25, 3).collect()}
        expected = {d: (np.quantile(x, q, method="higher"), len(x)) for d, x in enumerate(copied(scores, clusters, 3, 25)) if len(x)}
        assert got == expected


def test_recall_difference_equals_copied_rows(spark):
    rng = np.random.default_rng(1)
    c, e = rng.normal(size=(200, 2)), rng.normal(size=(80, 2)) + [0.5, 1.5]
    kc, ke = rng.integers(0, 15, 200), rng.integers(5, 25, 80)
    frame = lambda x, k: spark.createDataFrame([(*r, int(t)) for r, t in zip(x.tolist(), k, strict=True)], "a double, b double, t long")
    r = resample.recall_difference(frame(c, kc), frame(e, ke), "a", "b", "t", 0.1, 30, 5).first()
    delta = []
    for x, y in zip(copied(c, kc, 5, 30), copied(e, ke, 5, 30), strict=True):
        t = np.quantile(x, 0.9, axis=0, method="higher")
        delta.append((y[:, 1] > t[1]).mean() - (y[:, 0] > t[0]).mean())
    assert r.n == 80 and abs(r.delta - delta[0]) < 1e-12
    assert np.allclose([r.low, r.high], np.percentile(delta[1:], [2.5, 97.5]))


def test_calibration_interval_equals_copied_rows(spark):
    rng = np.random.default_rng(2)
    conf = np.concatenate([rng.uniform(0.3, 1, 150), [1.0, 0.0]])
    ok = (rng.uniform(size=152) < conf).astype(float)
    rows = spark.createDataFrame([(float(a), float(b), k) for k, (a, b) in enumerate(zip(conf, ok, strict=True))] + [(None, 1.0, 5)], "c double, y double, k long")
    errors = []
    for x in copied(np.stack([conf, ok], 1), np.arange(152), 42, 20):
        e = 0.0
        for lo in range(15):
            own = (x[:, 0] > lo / 15) & (x[:, 0] <= (lo + 1) / 15)
            e += own.sum() / len(x) * abs(x[own, 0].mean() - x[own, 1].mean()) if own.any() else 0
        errors.append(e)
    r = resample.calibration_interval(rows, "c", "y", "k", 15, 20).first()
    assert r.n == 152 and np.allclose([r.ece, r.low, r.high], [errors[0], *np.percentile(errors[1:], [2.5, 97.5])])


def test_no_rows(spark):
    none = spark.createDataFrame([], "a double, b double, t long")
    assert resample.drawn_quantiles(none, "a", "t", 0.5, 5).count() == 0
    assert resample.recall_difference(none, none, "a", "b", "t", 0.1, 5).first().delta is None
