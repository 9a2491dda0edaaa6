"""The filter interaction audit against plain counting, and its odd cases."""

import itertools
import re

import numpy as np
import pytest

from skyloom.llm import interaction

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, digest string, n long, first long, s string, label int"
LABELS = "doc_id long, quality int, toxic int, part string"
BASE = " ".join(f"word{k}" for k in range(60))
ROWS = [
    (1, BASE, "a"), (2, BASE, "a"), (2, BASE, "a"), (3, BASE + " #", "b"), (4, None, "b"), (5, "", None), (6, " \n\t ", ""), (7, "same " * 80, "a"), (8, "BIG LETTERS", "b"),
    (9, "same " * 80, "b"), (None, BASE, "a"), (None, BASE, "b"), (10, "ÿé😀 $ " * 3000, "a"), (11, "a b " * 50, "a"), (12, "x\x0by\x0cz\r" * 20, "b"),
]
MARKS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (2, 1, 0), (3, None, 1), (9, 1, None), (99, 1, 1), (None, 1, 1)]


def plain(rows, marks):
    def fails(i, t):
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        return {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}

    good, bad = ({m[0] for m in marks if m[k] == 1 and m[0] is not None} for k in (1, 2))
    docs = [(i, s or "", fails(i, t)) for i, t, s in rows]
    out = []
    for part in sorted({s for _, s, _ in docs}):
        own = [(i, f) for i, s, f in docs if s == part]
        shapley = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in itertools.permutations("ABCDE"):
            here = own
            for step, x in enumerate(order, 1):
                lost = [(i, f) for i, f in here if f[x]]
                here = [(i, f) for i, f in here if not f[x]]
                shapley[x] += len(lost)
                failing = [f for _, f in own if f[x]]
                lines.append([part, "".join(order), step, len(here), len(lost), len(failing) - len(lost), sum(sum(f.values()) == 1 for f in failing), sum(i in good for i, _ in lost), sum(i in bad for i, _ in lost), x])
        out += [tuple([*line[:-1], shapley[line[-1]]]) for line in lines]
    return sorted(out)


def report(spark, rows, marks, tmp_path):
    spark.createDataFrame([(i, t, "en", s, 1, "x", "y", 2, 3, "z", 4) for i, t, s in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*m, "q") for m in marks], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return sorted(tuple(r) for r in interaction.op13_interaction_audit(spark, str(tmp_path)).collect())


@pytest.mark.parametrize("most", [interaction.MOST_KEYS, 1])
def test_equals_plain_counting(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(interaction, "MOST_KEYS", most)
    assert report(spark, ROWS, MARKS, tmp_path) == plain(ROWS, MARKS)


def test_empty_tables(spark, tmp_path):
    assert report(spark, [], MARKS, tmp_path / "a") == []
    assert report(spark, ROWS[:3], [], tmp_path / "b") == plain(ROWS[:3], [])


def test_counter_holds_two_words_a_weight_and_counts_all():
    rng = np.random.default_rng(1)
    for size in (0, 1, 2, 3, 5, 64, 1000, 4097):
        words, counter = rng.integers(0, 1 << 32, size, dtype=np.uint32), interaction.Counter()
        for part in np.array_split(words, 3):
            counter.add(part)
        assert all(len(x) <= 2 for x in counter.levels)
        assert counter.counts().tolist() == [int(((words >> np.uint32(k)) & 1).sum()) for k in range(32)]


def test_survival_words():
    for n in range(6):
        for failed, word in enumerate(interaction.survival_words(n).tolist()):
            assert [word >> s & 1 for s in range(1 << n)] == [int(failed & s == 0) for s in range(1 << n)]


def test_orders_of_fewer_filters(spark):
    rows = [("p", s, sum(failed & s == 0 for failed in (0, 1, 1, 3, 2)), 0, 0) for s in range(4)]
    got = interaction.order_report(spark.createDataFrame(rows, "part string, subset int, n long, good long, toxic long"), "AB")
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got.collect()} == {
        ("AB", 1): (2, 3, 0, 2, 5), ("AB", 2): (1, 1, 1, 1, 3), ("BA", 1): (3, 2, 0, 1, 3), ("BA", 2): (1, 2, 1, 2, 5),
    }
