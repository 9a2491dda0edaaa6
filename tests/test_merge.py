"""The ordered merge of duplicates against one sequential pass."""

import math
import random

from pyspark.sql import functions as F

from skyloom.operators import merge

RADIUS = 5 / 3600
SCHEMA = "id long, ra double, dec double, src string, cls string, owner string"


def apart(p, q):
    a1, d1, a2, d2 = map(math.radians, (*p, *q))
    h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((a2 - a1) / 2) ** 2
    return math.degrees(2 * math.atan2(math.sqrt(h), math.sqrt(1 - h)))


def sequential(rows, priority):
    rows = sorted(rows, key=lambda r: (priority[r[3]], r[0]))
    ok = [r[1] is not None and r[2] is not None and not math.isnan(r[1]) for r in rows]
    keep, out = [True] * len(rows), {}
    for a, r in enumerate(rows):
        if not keep[a]:
            continue
        names, cls, n = [r[3]], r[4], 1
        for b in range(a + 1, len(rows)):
            s = rows[b]
            if keep[b] and ok[a] and ok[b] and apart(r[1:3], s[1:3]) <= RADIUS:
                keep[b] = False
                n += 1
                if s[3] not in names:
                    names.append(s[3])
                if s[4] == "rn" or (s[4] == "symbiotic" and cls == "nova"):
                    cls = "rn" if s[4] == "rn" else "nova+symbiotic"
        out[r[0]] = (r[1], r[2], cls, "|".join(names), n)
    return out


PRIORITY = {"Atlas": 0, "Index": 1, "Plates": 2}


def merged(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    p = F.when(F.col("src") == "Atlas", 0).when(F.col("src") == "Index", 1).otherwise(2)
    return {r.id: (r.ra, r.dec, r.cls, r.src, r.n_merged) for r in merge.merge_duplicates(df.drop("owner"), RADIUS, p).collect()}


def test_planted_duplicates_and_chains(spark):
    rng, rows = random.Random(2), []
    for k in range(60):
        ra, dec = rng.uniform(0, 360), rng.choice([rng.uniform(-89, 89), 89.9999, -89.9995])
        for j in range(rng.choice([1, 1, 2, 3, 7])):  # a chain: neighbours 3 arcsec apart along the meridian
            away = -1 if dec > 0 else 1
            rows.append((rng.randrange(10**6), ra, dec + away * j * 3 / 3600, rng.choice(list(PRIORITY)), rng.choice(["nova", "rn", "symbiotic", None])))
    rows += [(10**6 + k, 0.0005 if k % 2 else 359.9995, 10.0, "Index", "nova") for k in range(4)]  # over the zero meridian
    rows += [(10**7 + k, 200.0, 20.0, rng.choice(list(PRIORITY)), "nova") for k in range(150)]  # one position
    rows += [(10**8, 200.0, 20.0 + 4 / 3600, "Atlas", "symbiotic"), (10**8 + 1, None, 5.0, "Atlas", "rn"), (10**8 + 2, float("nan"), 5.0, "Plates", "rn")]
    expected = sequential(rows, PRIORITY)
    assert len(expected) < len(rows) - 150
    got = merged(spark, rows)
    assert {i: v[2:] for i, v in got.items()} == {i: v[2:] for i, v in expected.items()}


def test_a_long_run_of_waiting_sources(spark):
    rows = [(k, 50.0, 10 + 3 * k / 3600, "Atlas", "nova") for k in range(15)]  # each waits for the one before
    assert sorted(merged(spark, rows)) == [k for k in range(15) if k % 2 == 0] == sorted(sequential(rows, PRIORITY))


def test_no_rows_and_no_duplicates(spark):
    assert merged(spark, []) == {}
    assert merged(spark, [(1, 10.0, 10.0, "Atlas", None)]) == {1: (10.0, 10.0, None, "Atlas", 1)}
