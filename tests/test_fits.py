"""Poisson dipole, conformal residuals, scrambled nulls and audits against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import audits, skyfits, skymap
from skyloom.operators.resample import draw_uniform

SCHEMA = "ipix long, lon double, lat double, count double, coverage double"


def sky_of(a, n=200.0, nside=8, seed=1, poisson=True):
    lon, lat = skymap.centres(np.arange(12 * nside**2), nside)
    xyz = np.stack([np.cos(np.radians(lat)) * np.cos(np.radians(lon)), np.cos(np.radians(lat)) * np.sin(np.radians(lon)), np.sin(np.radians(lat))], 1)
    rng = np.random.default_rng(seed)
    s = rng.uniform(0.2, 1.0, len(lon))
    mu = s * n * (1 + xyz @ np.asarray(a))
    k = rng.poisson(mu).astype(float) if poisson else mu
    return lon, lat, xyz, s, k


def frame(spark, lon, lat, s, k):
    return spark.createDataFrame([*zip(range(len(lon)), lon.tolist(), lat.tolist(), k.tolist(), s.tolist(), strict=True)], SCHEMA)


@pytest.mark.parametrize("a", [(0.02, -0.05, 0.1), (0.6, 0.5, -0.4)])
def test_poisson_score_vanishes(spark, a):
    lon, lat, xyz, s, k = sky_of(a)
    s[:50] = 0.0
    d = skyfits.poisson_dipole(frame(spark, lon, lat, s, k)).first()
    own = s > 0
    found = np.array([d.x, d.y, d.z])
    mu = s[own] * math.exp(d.ln_n) * (1 + xyz[own] @ found)
    score = np.concatenate([[np.sum(k[own] - mu)], ((k[own] / mu - 1) * s[own]) @ xyz[own]])
    assert d.converged and np.abs(score).max() < 1e-3 and d.n_pixels == own.sum() and abs(d.amplitude - np.linalg.norm(found)) < 1e-12
    assert np.abs(found - a).max() < 0.05


def test_poisson_dipole_is_exact_on_expected_counts_and_empty_maps(spark):
    lon, lat, _, s, k = sky_of((0.1, 0.2, -0.3), poisson=False)
    d = skyfits.poisson_dipole(frame(spark, lon, lat, s, k)).first()
    assert np.allclose([d.x, d.y, d.z, math.exp(d.ln_n)], [0.1, 0.2, -0.3, 200.0], atol=1e-6)
    assert skyfits.poisson_dipole(frame(spark, lon, lat, s, 0 * k)).count() == 0
    assert skyfits.poisson_dipole(frame(spark, lon[:3], lat[:3], s[:3], k[:3])).count() == 0


def test_conformal_residuals_equal_numpy(spark):
    lon, lat, xyz, s, k = sky_of((0.0, 0.05, 0.1))
    s[7] = 0.0
    rows, summary = skyfits.conformal_residuals(frame(spark, lon, lat, s, k), math.log(200.0), (0.0, 0.01, 0.02), 5.0, 1.1, 0.1)
    own = s > 0
    mu = 200 * s[own] ** 1.1 * (1 + 5 * xyz[own] @ np.array([0.0, 0.01, 0.02]))
    r = np.abs((k[own] - mu) / np.sqrt(mu))
    n = own.sum()
    t = np.quantile(r, min(math.ceil((n + 1) * 0.9) / n, 1.0))
    got = summary.first()
    assert got.n_pixels == n and got.n_anomalous == (r > t).sum() == rows.where("anomalous").count()
    assert np.allclose([got.threshold, got.fraction, got.largest, got.mean], [t, (r > t).mean(), r.max(), r.mean()])
    assert skyfits.conformal_residuals(frame(spark, lon, lat, 0 * s, k), 0.0, (0.0, 0.0, 0.0), 1.0)[1].count() == 0


def test_scrambling_equals_plain_draws(spark):
    rows = [(k, 10.0 * k, 5.0 * k - 30, 100.0 + k, 140.0, None if k == 3 else 50.0) for k in range(12)]
    df = spark.createDataFrame(rows, "candidate_id long, ra double, dec double, discovery_mjd double, last_mjd double, host_distance double")
    score = F.sin(F.radians(F.col("dec"))) + F.coalesce(F.col("host_distance"), F.lit(0.0)) / 100 - F.abs(F.col("discovery_mjd") - 105) / 50
    got = audits.scrambling_test(df, score, 105.0, 60, 9).first()
    tops = []
    for d in range(1, 61):
        best = 0.0 - math.inf
        for k in range(12):
            u = [draw_uniform(9, d, k * 4 + j) for j in range(4)]
            best = max(best, math.sin(math.radians(math.degrees(math.asin(2 * u[1] - 1)))) - abs(105 - 30 + 60 * u[2] - 105) / 50)
        tops.append(best)
    observed = max(math.sin(math.radians(r[2])) + (r[5] or 0.0) / 100 - abs(r[3] - 105) / 50 for r in rows)
    assert np.allclose([got.observed, got.null_mean, got.null_std], [observed, np.mean(tops), np.std(tops)])
    assert got.exceedances == sum(t >= observed for t in tops) and abs(got.p_value - (got.exceedances + 1) / 61) < 1e-12
    none = audits.scrambling_test(df.where("false"), score, 105.0, 5).first()
    assert (none.observed, none.exceedances, none.p_value) == (0.0, 5, 1.0)


def test_audits_of_nothing(spark):
    e = spark.createDataFrame([], "field long, source_id long, class string, action string")
    a = audits.empty_field_audit(e, "field", F.col("action") == "T", 0.05).first()
    assert (a.n_fields, a.fdr, a.satisfied) == (0, 0.0, True)
    assert audits.abstention_reward(e, e, e).first().truthfulness == 0.0


def test_reward_counts_a_source_once(spark):
    s = spark.createDataFrame([(k,) for k in range(6)], "source_id long")
    d = spark.createDataFrame([(0, "Q", "AUTO_CATALOG"), (1, "Q", "AUTO_CATALOG"), (2, "S", "SCHEDULE_FOLLOWUP_QUERY"), (2, "S", "CONTRACTIVE_DELIBERATION"), (3, "S", "AUTO_CATALOG")], "source_id long, class string, action string")
    t = spark.createDataFrame([(0, "Q"), (1, "S"), (2, "S")], "source_id long, class string")
    r = audits.abstention_reward(s, d, t).first()
    assert (r.n_total, r.n_correct, r.n_abstain, r.n_wrong) == (6, 1, 1, 1)
    assert np.allclose([r.truthfulness, r.accuracy, r.abstention_rate], [(1 - 2) / 6, 1 / 3, 1 / 6])
