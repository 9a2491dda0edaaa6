"""Registered SQL functions, sketches, striped extracts and the scaling-binning calibrator."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import registered, sphere
from skyloom.operators import calibration, sketches, skymap
from skyloom.sources.stripes import Stripes


def test_functions_in_sql_text(spark):
    registered.register(spark)
    registered.register(spark)  # again is no error
    r = spark.sql("SELECT sky_sep(10D, 20D, 10D, 21D) AS a, sky_sep(0D, 90D, 77D, 90D) AS b, sky_sep(0D, 0D, 180D, 0D) AS c, sky_sep(NULL, 0D, 1D, 1D) AS d, cone(359.9D, 0D, 0.05D, 0D, 0.2D) AS e, cone(1D, 5D, 1D, 0D, 4.9D) AS f, bald(CAST(NULL AS ARRAY<DOUBLE>)) AS g").first()
    assert abs(r.a - 1) < 1e-9 and abs(r.b) < 1e-9 and abs(r.c - 180) < 1e-6 and r.d is None and r.e and not r.f and r.g is None
    v = [1.0, 2.0, 3.0, 4.0, 50.0]
    spark.createDataFrame([(1, x) for x in v] + [(1, float("nan")), (2, 1.0), (3, None)], "k int, x double").createOrReplaceTempView("odd_values")
    got = {r.k: r.s for r in spark.sql("SELECT k, mad_sigma(x) AS s FROM odd_values GROUP BY k").collect()}
    assert got == {1: 1.4826 * np.median(np.abs(np.array(v) - 3.0)), 2: 0.3, 3: 0.3}
    assert [tuple(r) for r in spark.sql("SELECT * FROM transit_times(10D, 3D, 20D, 2)").collect()] == [(4, 22.0), (5, 25.0)]
    assert spark.sql("SELECT * FROM transit_times(10D, 0D, 20D, 2)").count() == 0


@pytest.mark.parametrize("nside", [1, 2, 8, 16])
def test_healpix_ring_in_sql_equals_the_column(spark, nside):
    registered.register(spark)
    skymap.pixel_grid(spark, nside).createOrReplaceTempView("centres")
    assert spark.sql(f"SELECT count(*) AS n FROM centres WHERE healpix_ring(lon, lat, {nside}) <> ipix").first().n == 0
    rng = np.random.default_rng(nside)
    rows = [(float(a), float(b)) for a, b in zip(rng.uniform(-400, 800, 2000), np.degrees(np.arcsin(rng.uniform(-1, 1, 2000))), strict=True)] + [(0.0, 90.0), (10.0, -90.0)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    df.createOrReplaceTempView("places")
    both = spark.sql(f"SELECT lon, lat, healpix_ring(lon, lat, {nside}) AS p FROM places").withColumn("q", sphere.pixel_of(F.col("lon"), F.col("lat"), nside))
    assert both.where("p <> q OR p IS NULL").count() == 0


def test_scalar_functions_stay_in_the_plan(spark):
    registered.register(spark)
    spark.range(5).selectExpr("CAST(id AS DOUBLE) AS x").createOrReplaceTempView("numbers")
    plan = spark.sql("SELECT sky_sep(x, x, 1D, 2D) AS s, healpix_ring(x, x, 4) AS p FROM numbers WHERE cone(x, x, 1D, 2D, 9D)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_digamma():
    assert abs(registered.digamma(np.array([1.0]))[0] + 0.5772156649015329) < 1e-10
    for x in (0.1, 1.0, 7.5, 300.0):
        a, b = registered.digamma(np.array([x, x + 1]))
        assert abs(b - a - 1 / x) < 1e-9


def test_merged_sketches_stay_within_their_bounds(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("day"), (F.xxhash64("id") % 9000).alias("user"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10**6)).cast("double").alias("x"))
    days = sketches.build(rows, ["day"], "user", "x")
    whole = sketches.estimate(sketches.merge(days, []), [0.1, 0.5, 0.9]).first()
    exact = rows.agg(F.countDistinct("user").alias("d")).first().d
    assert whole.n == 60_000 and abs(whole.n_distinct - exact) <= sketches.DISTINCT_ERROR * exact
    x = np.sort([r.x for r in rows.select("x").collect()])
    for q, v in zip((0.1, 0.5, 0.9), whole.quantiles, strict=True):
        assert abs(np.searchsorted(x, v) / len(x) - q) <= sketches.RANK_ERROR
    assert sketches.build(rows.where("false"), ["day"], "user", "x").count() == 0


def test_stripes_resume_and_prune(spark, tmp_path):
    df = spark.range(720).select("id", (F.col("id") / 2.0).alias("ra")).unionByName(spark.createDataFrame([(900, None), (901, 360.0), (902, -1.0)], "id long, ra double"))
    s = Stripes(spark, f"file://{tmp_path}/s")
    assert s.extract(df) == list(range(12)) and s.extract(df) == []
    (tmp_path / "s/stripe=3/_SUCCESS").unlink()  # as if the extract had broken off there
    with pytest.raises(ValueError):
        s.read()
    assert s.missing() == [3] and s.extract(df) == [3]
    assert sorted(r.id for r in s.read().collect()) == list(range(720))
    part = s.read(29.5, 60.0)
    assert sorted(r.id for r in part.collect()) == list(range(59, 120))
    scan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(stripe" in scan and len({r.f for r in part.select(F.input_file_name().alias("f")).collect()}) <= 8
    assert {r.s for r in part.select(F.regexp_extract(F.input_file_name(), r"stripe=(\d+)", 1).alias("s")).distinct().collect()} == {"0", "1"}


def test_scaling_binning_equals_numpy(spark):
    rng = np.random.default_rng(3)
    z = np.round(rng.normal(size=(400, 3)) * 3, 2)
    p = np.exp(z / 1.7)
    p /= p.sum(1, keepdims=True)
    y = np.array([rng.choice(3, p=r) for r in p])
    df = spark.createDataFrame([(k, a, int(b)) for k, (a, b) in enumerate(zip(z.tolist(), y, strict=True))], "id int, z array<double>, y int")
    m = calibration.fit_scaling_binning(df, "z", "y", 8)

    def loss(t):
        s = z / t
        return np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(400), y])

    grid = np.linspace(m.temperature * 0.9, m.temperature * 1.1, 41)
    assert loss(m.temperature) <= min(map(loss, grid)) + 1e-12
    q = np.exp(z / m.temperature)
    q /= q.sum(1, keepdims=True)
    conf, ok = q.max(1), q.argmax(1) == y
    edges = np.unique(np.concatenate([[0.0], np.quantile(conf, np.arange(1, 8) / 8), [1.0001]]))
    values = [ok[(conf >= a) & (conf < b)].mean() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    assert np.allclose(m.edges, edges) and np.allclose(m.values, values)
    for r in calibration.apply_scaling_binning(df, m, "z").collect():
        v = values[int(np.searchsorted(edges, conf[r.id], side="right")) - 1]
        want = q[r.id] * (1 - v) / (1 - conf[r.id] + 1e-12)
        want[q[r.id].argmax()] = v
        assert np.allclose(r.probs, want) and abs(r.confidence - v) < 1e-12 and math.isclose(sum(r.probs), 1.0, abs_tol=1e-6)


def test_scaling_binning_of_nothing_and_ties(spark):
    none = spark.createDataFrame([], "z array<double>, y int")
    assert calibration.fit_scaling_binning(none, "z", "y").temperature == 1.0
    same = spark.createDataFrame([([1.0, 0.0], k % 2) for k in range(10)], "z array<double>, y int")
    m = calibration.fit_scaling_binning(same, "z", "y", 4)
    assert len(m.values) == len(m.edges) - 1 and calibration.apply_scaling_binning(same, m, "z").count() == 10
    assert calibration.quantiles(none.withColumn("x", F.lit(1.0)), "x", [0.5]) == []


def test_third_risk_control(spark):
    df = spark.createDataFrame([(0.9, 1)] * 90 + [(0.4, 0)] * 50 + [(0.95, 1)] * 10, "p double, y int")
    r = calibration.risk_control(df, "p", F.col("y") == 1, 0.05, "passing").first()
    assert (r.threshold, r.risk, r.retention, r.feasible) == (0.9, 0.0, 1.0, True)
    r = calibration.risk_control(df.where("y = 0"), "p", F.col("y") == 1, 0.05, "passing").first()
    assert (r.threshold, r.risk, r.retention, r.feasible) == (0.85, 0.0, 0.0, False)
