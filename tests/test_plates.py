"""Plate rows, assembled light curves, windows and controls on small odd tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skyloom.operators import plates, skymap, timeseries

NAN = float("nan")
RAW = "id long, date_jd double, gsc_bin_index double, sextractor_number double, magcal_magdep double, magcal_local_rms double, limiting_mag_local double, aflags long, bflags long, series string"


def test_tidy_of_odd_rows(spark):
    a = plates.AFLAGS
    rows = [
        (1, 2451545.0, 1.0, None, 12.0, 0.2, 14.0, a["case_b_blend"] | a["close_to_limit"], 4, "a"), (2, 2451545.0, 0.0, NAN, 12.0, 0.2, 14.0, 0, 4, "a"), (3, 2451910.25, None, 3.0, NAN, NAN, 4.9, None, None, "b"),
        (4, 2451545.0, 1.0, 1.0, 9.0, 9.0, NAN, a["multiple_exposure_unmatched"], 1 << 10, None), (5, 2451545.0, 0.0, 0.0, None, None, 14.0, a["multiple_exposure_unmatched"], None, "c"), (6, 2451545.0, 0.0, 0.0, None, None, 14.0, a["pickering_wedge"], None, "c"),
        (7, 2451545.0, 5.0, 0.0, 12.0, 0.0, None, a["large_drad"], 2, "d"),
    ]
    got = {r.id: r for r in plates.tidy(spark.createDataFrame(rows, RAW)).collect()}
    assert [(k, r.det, r.good, r.sat, r.near_limit) for k, r in sorted(got.items())] == [
        (1, True, True, True, True), (2, False, True, False, False), (3, False, False, False, False), (4, True, False, True, False), (5, False, True, False, False), (6, False, False, False, False), (7, True, True, False, False),
    ]
    errors = {1: math.sqrt(0.04 + 0.09 + 0.25), 2: 0.2, 3: 0.25, 4: 1.5, 5: 0.25, 7: math.hypot(0.25, 0.5)}
    assert all(abs(got[k].err - e) < 1e-12 for k, e in errors.items()) and got[2].mag is None and abs(got[3].t - 2001.0) < 1e-12


def test_assemble_rules(spark):
    shape = "t long, target_ra double, target_dec double, ra_deg double, dec_deg double, mag double, series string, plate double, solution double, row long"
    sec = 1 / 3600
    at = lambda row, north, mag, plate, solution=0.0: (1, 10.0, 0.0, 10.0, north * sec, mag, "s", plate, solution, row)
    own = [at(1, 1.0, 12.0, 1.0), at(2, 14.0, 12.1, 2.0), at(3, 16.0, 12.2, 3.0), at(4, 0.0, None, 1.0), at(5, 0.0, NAN, 4.0), at(6, 0.0, None, 5.0), at(7, 2.0, 12.0, 6.0, None)]
    far = [(*at(11, 3.0, 9.0, 2.0), "far", 10.0, 30 * sec), (*at(12, 5.0, 9.1, 5.0), "far", 10.0, 30 * sec), (*at(13, 5.9, 9.2, 7.0), "far", 10.0, 9 * sec), (*at(14, 2.0, 9.3, 6.0), "far", 10.0, 30 * sec)]
    near = [(*at(20 + k, 1.5, 14.0, 20.0 + k), "near", 10.0, 4 * sec) for k in range(3)] + [(*at(24, 1.5, 12.9, 24.0), "near", 10.0, 4 * sec), (*at(25, 1.5, 14.5, 25.0), "few", 10.0, 4 * sec)]
    a = plates.assemble(spark.createDataFrame(own, shape), spark.createDataFrame(far + near, shape + ", owner string, owner_ra double, owner_dec double"), "t")
    got = sorted((r.plate, r.mag, r.owner) for r in a.collect() if r.mag is not None)
    assert got == [(1, 12.0, None), (2, 9.0, "far"), (5, 9.1, "far"), (6, 12.0, None), (24, 12.9, "near"), (25, 14.5, "few")]
    assert sorted(r.plate for r in a.collect() if r.mag is None) == [4]


def test_rows_near_sample_and_dense_buckets(spark):
    rng = random.Random(1)
    rows = [(k, "hot" if k % 3 else "cold", rng.uniform(0, 50)) for k in range(600)]
    centres = [(k, rng.choice(["hot", "cold", "none"]), rng.uniform(-5, 55)) for k in range(40)]
    r, c = spark.createDataFrame(rows, "id long, key string, t double"), spark.createDataFrame(centres, "centre_id long, key string, centre double")
    expected = {(ci, i) for ci, ck, cc in centres for i, k, t in rows if k == ck and cc - 3 <= t < cc + 3}
    got = {(x.centre_id, x.id) for x in plates.rows_near(r, c, ["key"], "t", "centre", 3.0).collect()}
    assert got == expected
    few = [(x.centre_id, x.id) for x in plates.rows_near(r, c, ["key"], "t", "centre", 3.0, most=10).collect()]
    sizes = lambda pairs: {ci: min(10, sum(p[0] == ci for p in pairs)) for ci in {p[0] for p in pairs}}
    assert set(few) <= expected and len(few) == len(set(few)) and {ci: sum(p[0] == ci for p in few) for ci in sizes(few)} == sizes(expected)


def test_control_stars_by_plain_loops(spark):
    rng = random.Random(4)
    stars = [(k, 50 + rng.uniform(-0.3, 0.3), rng.uniform(-0.3, 0.3), rng.uniform(8, 14), rng.choice([None, 5.0, 19.0, 20.0, 100.0]), rng.choice([0.0, 0.0, 0.0, NAN, 1.0])) for k in range(700)]
    targets = [(k, *stars[k][1:5], float(rng.choice([60, 200, 299, 300, 500]))) for k in range(60)]
    s = spark.createDataFrame(stars, "star long, ra double, dec double, mag double, matches double, v_flag double")
    t = spark.createDataFrame(targets, "tid long, target_ra double, target_dec double, target_mag double, target_matches double, radius double")
    got = {}
    for r in plates.control_stars(t, s, (F.col("star") * 7919 + F.col("tid") * 104729) % 10007).collect():
        got.setdefault(r.tid, set()).add(r.star)

    def apart(a, b, c, d):
        h = math.sin(math.radians(d - b) / 2) ** 2 + math.cos(math.radians(b)) * math.cos(math.radians(d)) * math.sin(math.radians(c - a) / 2) ** 2
        return 2 * math.degrees(math.asin(math.sqrt(h))) * 3600

    number, expected = lambda x: 0.0 if x is None or math.isnan(x) else x, {}
    for tid, ra, dec, mag, n, radius in targets:
        def candidates(inner, outer):
            found = []
            for width in (0.5, 1.0):
                found = [k for k, a, d, m, j, v in stars if inner < apart(ra, dec, a, d) <= outer and abs(m - mag) < width and number(v) == 0 and (number(j) < 20 if number(n) < 20 else number(j) >= 0.5 * number(n))]
                if len(found) >= 2:
                    break
            return found

        found = candidates(0.4 * radius, radius)
        if len(found) < 2 and radius >= 300:
            found = candidates(120.0, 900.0)
        if found:
            expected[tid] = set(sorted(found, key=lambda k: ((k * 7919 + tid * 104729) % 10007, k))[:2])
    assert got == expected


def test_control_stars_of_a_turn_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(plates, "FIRST_LOOK", 4)
    monkeypatch.setattr(plates, "WIDER", 4)
    stars = [(k, 50 + rng.uniform(-0.3, 0.3), rng.uniform(-0.3, 0.3), rng.choice([rng.uniform(8, 10), 30.0 * (k % 50 == 0)]), 5.0, 0.0) for k in range(1500)]
    s = spark.createDataFrame(stars, "star long, ra double, dec double, mag double, matches double, v_flag double")
    t = s.where("star < 100").selectExpr("star AS tid", "ra AS target_ra", "dec AS target_dec", "mag AS target_mag", "matches AS target_matches", "element_at(array(60D, 200D, 300D, 500D), int(star % 4 + 1)) AS radius")
    looks, match = [], plates.cross_match
    monkeypatch.setattr(plates, "cross_match", lambda a, b, *rest, **more: looks.append((b.select("tid").distinct().count(), "on" in more)) or match(a, b, *rest, **more))
    for m in (10007, 97, 3):  # in the last two many stars share a place in the order
        star, target = F.col("star") * 7919, F.col("tid") * 104729
        looks.clear()
        turned = {tuple(r)[:2] for r in plates.control_stars(t, s, plates.Turn(star, target, m)).collect()}
        assert looks[0][1] and (m < 97 or looks[-1][0] < 60)  # most never meet all stars
        assert turned == {tuple(r)[:2] for r in plates.control_stars(t, s, (star + target) % m).collect()}


def test_compare_wants_one_prediction(spark):
    m = spark.createDataFrame([("a", 0.02, 0.01), ("b", 0.04, 0.01)], "k string, amplitude double, sigma double")
    e = spark.createDataFrame([("a", 0.01), ("b", 0.02)], "k string, amplitude double")
    with pytest.raises(ValueError):
        skymap.compare(m, e)
    assert {r.k: round(r.ratio, 9) for r in skymap.compare(m, e, ["k"]).collect()} == {"a": 2.0, "b": 2.0}


def test_quiescent_takes_the_lower_of_two_middle_values(spark):
    rows = [(1, 0.0, m, True, 9.0) for m in (1.0, 2.0, 3.0, 4.0)] + [(1, 0.0, None, True, 9.0)]
    df = spark.createDataFrame(rows, "k int, t double, mag double, det boolean, lim double").withColumn("middle", F.lit(0.0))
    assert timeseries.quiescent(df, ["k"], "middle", 1.0, 5.0).first().level == 2.0
