"""Target resolution and feature vectors on odd rows."""

import math

import pytest
from pyspark.sql import functions as F

from skyloom.operators import features, resolve
from skyloom.sources.catalog import parse_coordinates

NAN = float("nan")


def test_resolution_order_and_ties(spark):
    objects = spark.createDataFrame(
        [("M 31", "M 31", "Gal", 10.68, 41.27), ("M 31", "Andromeda Galaxy", "Gal", 10.68, 41.27), ("M 32", "M 32", "Gal", 10.67, 40.86), ("Nova X", "nova x", "V*", NAN, 5.0), ("Nova Y 2", "Nova Y 2", "No*", 50.0, 5.0), ("T CrB", "T CrB", "V*", 239.87, 25.92), ("A", "twin", "Star", 1.0, 1.0), ("B", "twin", "Star", 2.0, 2.0), ("C", None, "X", 3.0, 3.0)],
        "name string, alias string, otype string, ra double, dec double",
    )
    bodies = spark.createDataFrame([("Mars", "Solar System", 100.0, 20.0), ("nova x", "Solar System", 7.0, 8.0), ("Io", "Moon", NAN, NAN)], "name string, otype string, ra double, dec double")
    asks = {1: "  m 31 ", 2: "andromeda galaxy", 3: "10.681 41.271", 4: "200 -30", 5: "MARS", 6: "Nova X", 7: "nova", 8: "galaxy andromeda", 9: "Io", 10: "twin", 11: None, 12: "", 13: "no such thing", 14: "15:59:30.2 +25:55:13", 15: "400 10", 16: "m"}
    got = {r.request: r for r in resolve.resolve_targets(spark.createDataFrame(list(asks.items()), "request int, text string"), objects, bodies).collect()}
    assert {k: (r.name, r.kind, r.alternatives) for k, r in got.items()} == {
        1: ("M 31", "exact", 0), 2: ("M 31", "exact", 0), 3: ("M 31", "nearby", 0), 4: ("field 200.0000 -30.0000", "blank", 0), 5: ("Mars", "ephemeris", 0), 6: ("nova x", "ephemeris", 0), 8: ("M 31", "relaxed", 0), 10: ("A", "exact", 1),
        14: ("T CrB", "nearby", 0), 16: ("M 31", "ambiguous", 1),
    }
    assert (got[3].ra, got[3].object_class, got[3].confidence) == (10.681, "galaxy_agn", 0.8) and got[5].object_class == "solar" and got[14].object_class == "star"


def test_object_class_takes_the_first_key(spark):
    want = {"QSO": "galaxy_agn", "Star": "star", "V*": "star", "Planet": "star", "PN": "nebula", "XB": "high_energy", "": "unknown", None: "unknown", "HII": "nebula", "Sun": "solar", "Gamma": "galaxy_agn"}
    want["Planet"] = next(c for k, c in resolve.CLASSES.items() if k.lower() in "planet")
    want["Gamma"] = next(c for k, c in resolve.CLASSES.items() if k.lower() in "gamma")
    df = spark.createDataFrame([(k,) for k in want], "o string")
    assert {r.o: r.c for r in df.select("o", resolve.object_class(F.col("o")).alias("c")).collect()} == want


def test_sexagesimal_positions(spark):
    want = {"00:42:44.3 +41:16:09": (10.684583, 41.269167), "05h34m31.94s -22d00m52.2s": (83.633083, -22.0145), "12 30 00 -00 30 00": (187.5, -0.5), "25:00:00 +10:00:00": None, "10.5, -20.25": (10.5, -20.25), "370 10": None, "x": None, None: None}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    for r in df.select("t", parse_coordinates("t").alias("p")).collect():
        assert (r.p is None) == (want[r.t] is None), r.t
        assert r.p is None or (abs(r.p.ra - want[r.t][0]) < 1e-5 and abs(r.p.dec - want[r.t][1]) < 1e-5), r.t


def test_features_of_missing_and_extreme_values(spark):
    shape = "dm double, dm_ne double, dm_ymw double, glat double, scat_ms double, width_ms double, flux_jy double, fluence_jyms double, snr double"
    r = features.burst_features(spark.createDataFrame([(500.0, 400.0, -5.0, -30.0, 0.0, 0.0, 0.0, 0.0, 1e9), (None, 1e9, 0.0, 90.0, 1e9, 1.0, 1.0, 1.0, None)], shape)).collect()
    a, b = r[0].features, r[1].features
    assert len(features.BURST) == len(a) == 12
    assert [round(x, 6) for x in a[:10]] == [round(math.log10(500), 6), round(math.log10(400), 6), 0.0, 0.8, 0.5, -4.0, round(math.log10(0.05), 6), -2.0, round(math.log10(0.05), 6), 5.0]
    assert a[11] == pytest.approx(340 / 950) and a[10] == pytest.approx(max(-5, -4 - math.log10(10 ** (-3.86 + 0.154 * math.log10(500) + 1.07 * math.log10(500) ** 2) / 1000)))
    assert [k for k, x in enumerate(b) if x is None] == [0, 3, 9, 10] and b[11] == 4.0
    shape = "ra double, dec double, host_distance double, host_distance_err double, log_mass double, coincidence double, rate_r double, rate_g double, colour double, colour_rate double, `limit` double, mag_r double, mag_err_r double, host_offset double"
    alert = {"ra": 10.0, "dec": 10.0, "area_90": 0.1, "distance": 40.0, "distance_std": 5.0}
    c = features.candidate_features(spark.createDataFrame([(10.0, 10.0, None, None, None, None, 0.1, 0.2, 0.5, 0.0, 21.0, 20.0, 0.0, 1.0), (200.0, 0.0, 4e3, 0.0, 11.0, 0.4, 0.1, 0.2, 0.5, 0.0, 21.0, 20.0, 0.1, 1.0)], shape), alert).collect()
    sigma = max(math.sqrt(1 / math.pi) / 2.146, 0.1)
    assert c[0].features[:4] == [pytest.approx(math.log10(1 / (2 * math.pi * sigma**2))), 12.0, 9.5, 0.0] and c[0].features[11] == pytest.approx(108.57)
    assert c[1].features[:4] == [-8.0, 50.0, 11.0, 0.4] and len(features.CANDIDATE) == 12


def test_common_words_and_positions_are_looked_up_once(spark, monkeypatch):
    monkeypatch.setattr(resolve, "HOT", 3)
    met, match = [], resolve.cross_match
    monkeypatch.setattr(resolve, "cross_match", lambda a, *rest: met.append(a.count()) or match(a, *rest))
    objects = spark.range(40).selectExpr("concat('o', lpad(id, 2, '0')) AS name", "concat('Object No ', id) AS alias", "'QSO' AS otype", "10 + id * 0.01D AS ra", "5D + id * 0.001D AS dec")
    bodies = spark.createDataFrame([], "name string, otype string, ra double, dec double")
    asks = spark.range(60).selectExpr("id AS request", "CASE id % 4 WHEN 0 THEN '10.0 5.0' WHEN 1 THEN 'no OBJECT' WHEN 2 THEN concat('no ', id) ELSE 'no star' END AS text")
    got = {r.request: (r.kind, r.name, r.alternatives) for r in resolve.resolve_targets(asks, objects, bodies, 3.0).collect()}
    expected = {k: ("nearby", "o00", 4) if k % 4 == 0 else ("ambiguous", "o00", 39) for k in range(60) if k % 4 < 2} | {k: ("relaxed", f"o{k:02d}", 0) for k in range(2, 40, 4)}
    assert got == expected and met == [1]
