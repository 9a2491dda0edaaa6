"""The rule ledger against plain Python, its policies and ablations, and odd cases."""

import re

import pytest
from pyspark.sql import functions as F

from skyloom.llm import rules

SCHEMA = "doc_id long, text string, t string, w string, s string, lines string, n_words string, fail_bits string, kept string"
BASE = " ".join(f"word{k}" for k in range(60))
TEXTS = [
    (1, BASE), (2, BASE), (2, BASE), (3, None), (4, ""), (5, " \n\t\x0b "), (6, "same " * 80), (7, "a b c a b c " * 10), (8, "a b c d a b c " * 9 + "\n" + BASE), (9, "# $ % <b> | & *\n" * 30),
    (10, "line one is here\nline one is here\n\n\nline one is here \n" * 6), (None, BASE), (11, "- x\n• y\n* z\n" * 20), (12, "so it goes...\nand on…  \n" * 20), (13, "123 456 789 " * 40), (14, "ÿé😀 ß東 " * 3000),
    (15, "x" * 40 + " "), (16, ("y" * 40 + " ") * 60), (17, "one two"), (18, "a a a"), (19, "a a a a"), (20, "\r\nx\r\nx\r\n" * 3), (21, "a  b c\ta b\nc"), (22, "\x1cword\x1c \xa0   z" * 20),
]


def plain(t):
    t = t or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = {x for x in windows if windows.count(x) > 1} if len(windows) < 1000 else {x for x, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {k + j for k, x in enumerate(windows) if x in often for j in range(3)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall("[#*$%&|<>]", t)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_bullet_lines": sum(bool(re.match("[ \t]*[-*•]", x)) for x in lines), "n_ellipsis_lines": sum(bool(re.search("(\\.\\.\\.|…)[\x20\x09-\x0d]*\\Z", x)) for x in lines), "n_letters": sum(c.isalpha() for c in t),
    }


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *["x"] * 7) for i, t in TEXTS], SCHEMA)


def test_measurements_equal_plain_python(docs):
    got = sorted((tuple(r) for r in rules.measurements(docs).collect()), key=str)
    assert got == sorted(((i, *plain(t).values()) for i, t in TEXTS), key=str)


def test_bits_and_policies(docs):
    ledger = rules.failure_bits(rules.measurements(docs))
    for r in ledger.collect():
        m = r.asDict()
        for k, condition in enumerate(rules.RULES.values()):
            assert (r.fail_bits >> k & 1) == int(eval(condition.replace("AND", "and"), {}, m)), (r.doc_id, condition)  # noqa: S307  the library's own constants
    for policy in rules.POLICIES.values():
        kept = rules.apply(ledger, policy)
        assert {(r.doc_id, r.fail_bits) for r in kept.where("kept").collect()} == {(r.doc_id, r.fail_bits) for r in ledger.collect() if not r.fail_bits & policy.mask}


def test_ablations_equal_plain_counting(spark, docs):
    ledger = rules.failure_bits(rules.measurements(docs)).withColumn("part", F.col("doc_id") % 2)
    rows, policies = ledger.collect(), list(rules.POLICIES.values())
    got = {(r.part, r.policy, r.rule): (r.n_docs, r.n_kept, r.n_failed, r.n_only, r.n_kept_alone) for r in rules.ablations(ledger, policies, ["part"]).collect()}
    expected = {}
    for part in {r.part for r in rows}:
        own = [r.fail_bits for r in rows if r.part == part]
        for p in policies:
            for rule in p.rules:
                bit = 1 << list(rules.RULES).index(rule)
                expected[part, p.version, rule] = (len(own), sum(not b & p.mask for b in own), sum(bool(b & bit) for b in own), sum(b & p.mask == bit for b in own), sum(not b & bit for b in own))
    assert got == expected
    with pytest.raises(ValueError):
        rules.ablations(ledger, [])


def test_ledger_evaluates_a_batch_once(spark, docs, tmp_path):
    ledger = rules.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.record("one", docs) and not ledger.record("one", docs)
    assert ledger.record("two", docs.where("doc_id = 1"))
    assert ledger.record("none", docs.where("false"))
    assert ledger.rows().groupBy("batch").count().orderBy("batch").collect() == [("one", len(TEXTS)), ("two", 1)]


def test_query_without_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert rules.op11_quality_rules(spark, str(tmp_path)).count() == 0


def test_main_path_has_no_python_and_no_shuffle(docs):
    plan = rules.apply(rules.failure_bits(rules.measurements(docs)), rules.POLICIES[rules.CURRENT])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert plan.count("sort_array") == 2  # windows and places, each made once
