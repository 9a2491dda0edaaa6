"""Connected components against union-find."""

from __future__ import annotations

import random

import pytest

from skyloom.llm.components import connected_components

RNG = random.Random(3)
CASES = {
    "empty": [],
    "loop": [(1, 1)],
    "nulls and repeats": [(None, 2), (3, 2), (3, 2), (2, 3)],
    "chain": [(i, i + 1) for i in range(40)],
    "star around the least": [(0, i) for i in range(1, 300)],
    "star around the largest": [(1000, i) for i in range(300)],
    "sparse": [(RNG.randrange(200), RNG.randrange(200)) for _ in range(130)],
}


def by_union_find(edges: list[tuple]) -> set[tuple[int, int]]:
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {(x, top(x)) for x in parent}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    rows = connected_components(spark.createDataFrame(CASES[name], "a long, b long")).collect()
    assert len(rows) == len(set(rows))
    assert {(r.node, r.component) for r in rows} == by_union_find(CASES[name])
    assert spark.conf.get("spark.sql.adaptive.enabled") == before
