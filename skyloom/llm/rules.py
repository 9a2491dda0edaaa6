"""Quality rules as a ledger of bits.

Every rule is evaluated once for a document: the ledger keeps its measurements and one
bit for each rule that it fails. A policy is a version and a set of rules; applying it,
and asking what a rule takes away from it, are operations on the bits alone and never
read a text again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import documents, shared_dir, slim

RULES_VERSION = "1"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_bullet_lines", "n_ellipsis_lines", "n_letters")
#: Rule k sets bit k where its condition on the measurements holds. Whole numbers only, so that every engine decides alike.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_words": "n_words > 1000000",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "n_lines > 1 AND 100 * n_dup_lines > 30 * n_lines",
    "bullet_lines": "100 * n_bullet_lines > 90 * n_lines",
    "ellipsis_lines": "100 * n_ellipsis_lines > 30 * n_lines",
    "few_letters": "100 * n_letters < 60 * word_chars",
}
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]
    rules_version: str = RULES_VERSION

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in set(self.rules))


POLICIES: dict[str, Policy] = {
    p.version: p
    for p in (
        Policy("base", BASE),
        Policy("length", (*BASE, "many_words", "short_words", "long_words")),
        Policy("prose", (*BASE, "many_words", "short_words", "long_words", "symbols", "dup_lines", "bullet_lines", "ellipsis_lines", "few_letters")),
    )
}
CURRENT = "prose"


def _windows(words: str) -> Column:
    """All windows of three words with their places, sorted by the words: equal windows stand side by side."""
    n = F.size(words) - 2
    part = lambda k: F.slice(words, k, n)
    zipped = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), F.sequence(F.lit(1), n).alias("p"))
    return F.when(n > 0, F.sort_array(zipped))


def measurements(docs: DataFrame) -> DataFrame:
    """doc_id and MEASURES of every document, in one pass over the texts without a shuffle.

    n_repeat_words counts words in windows of three words that occur more than once: windows
    are sorted, places of equal neighbours collected, and each place covers as many of its
    three words as the place before left free. A step's array is a column that later steps
    read more than once, so it is made once. A null text is empty, an empty one measures 0.
    """
    text = slim(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    only = lambda kept: F.length(F.regexp_replace("t", f"[^{kept}]+", ""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = text.select("doc_id", "t", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "").alias("w"), lines.alias("lines"))
    rows = rows.select(
        "doc_id", F.size("w").alias("n_words"), F.length(F.regexp_replace("t", r"[\x20\x09-\x0D]+", "")).alias("word_chars"), only("#*$%&|<>").alias("n_symbols"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.size(F.filter("lines", lambda x: x.rlike("^[\x20\x09]*[-*•]"))).alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: x.rlike("(\\.\\.\\.|…)[\x20\x09-\x0D]*$"))).alias("n_ellipsis_lines"), only(r"\p{L}").alias("n_letters"), _windows("w").alias("s"),
    )
    rows = rows.withColumn("beside", F.arrays_zip(F.slice("s", F.lit(1), F.size("s") - 1).alias("x"), F.slice("s", F.lit(2), F.size("s") - 1).alias("y")))
    same = F.filter("beside", lambda z: (z["x"]["a"] == z["y"]["a"]) & (z["x"]["b"] == z["y"]["b"]) & (z["x"]["c"] == z["y"]["c"]))
    rows = rows.withColumn("beside", F.when(F.size("s") > 1, same))
    places = F.sort_array(F.array_distinct(F.concat(F.transform("beside", lambda z: z["x"]["p"]), F.transform("beside", lambda z: z["y"]["p"]))))
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(places, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")), lambda acc: acc["n"])
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)))
    return rows.select("doc_id", *[F.col(m).cast("long").alias(m) for m in MEASURES])


def failure_bits(measured: DataFrame) -> DataFrame:
    """Adds fail_bits: bit k is set where rule k fails."""
    bits = sum((F.when(F.expr(condition), F.lit(1 << k)).otherwise(0) for k, condition in enumerate(RULES.values())), F.lit(0))
    return measured.withColumn("fail_bits", bits.cast("long"))


def apply(ledger: DataFrame, policy: Policy) -> DataFrame:
    """Adds kept: whether a document fails none of the policy's rules. A ledger of another version of the rules keeps nothing."""
    return ledger.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(ledger: DataFrame, policies: list[Policy], by: list[str] | None = None) -> DataFrame:
    """For each policy and each of its rules: documents, kept, failed by the rule, failed by it alone (regained without it), and kept with it alone.

    Documents are counted by their bits first; at most 2^rules rows a group are left, and
    every figure is a sum over those whose bits and mask meet.
    """
    by = by or []
    counted = ledger.groupBy(*by, "fail_bits").agg(F.count(F.lit(1)).alias("n"))
    names = list(RULES)
    asked = [F.struct(F.lit(p.version).alias("policy"), F.lit(p.mask).alias("mask"), F.lit(r).alias("rule"), F.lit(1 << names.index(r)).alias("bit")) for p in policies for r in names if r in p.rules]
    if not asked:
        raise ValueError("no policy has a rule")
    rows = counted.select(*by, "fail_bits", "n", F.explode(F.array(*asked)).alias("a")).select(*by, "fail_bits", "n", "a.*")
    hit, own = F.col("fail_bits").bitwiseAND(F.col("mask")), F.col("fail_bits").bitwiseAND(F.col("bit"))
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return rows.groupBy(*by, "policy", "rule").agg(
        F.sum("n").alias("n_docs"), count(hit == 0).alias("n_kept"), count(own != 0).alias("n_failed"), count(hit == F.col("bit")).alias("n_only"), count(own == 0).alias("n_kept_alone")
    )


class Ledger:
    """Batches of evaluated documents in a folder that driver and executors share, by version of the rules."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, f"{root.rstrip('/')}/rules={RULES_VERSION}"

    def record(self, batch: str, docs: DataFrame) -> bool:
        """Evaluates and stores a batch; false, and nothing is evaluated, if it is stored already. The success mark commits it."""
        path = f"{self.root}/batch={batch}"
        mark = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
            return False
        failure_bits(measurements(docs)).write.mode("overwrite").parquet(path)
        return True

    def rows(self) -> DataFrame:
        """doc_id, the measurements, fail_bits and batch of all stored documents."""
        schema = ", ".join(f"{c} long" for c in ("doc_id", *MEASURES, "fail_bits"))
        return self.spark.read.schema(f"{schema}, batch string").parquet(self.root)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the current policy.

    Null and empty texts have no words and fail for few words; rows without an id and
    repeated rows are evaluated each; an empty table gives no rows; extra columns are not
    read; texts are evaluated whole, however long.
    """
    ledger = Ledger(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/rules-{uuid.uuid4().hex}")
    ledger.record("all", documents(spark, sf_dir))
    policy = POLICIES[CURRENT]
    found = apply(ledger.rows(), policy)
    base = F.col("fail_bits").bitwiseAND(F.lit(POLICIES["base"].mask)) != 0
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits", F.lit(policy.version).alias("policy"))


_WORD = r"[^\x20\x09-\x0D]"
_BITS = " + ".join(f"CASE WHEN {c} THEN {1 << k} ELSE 0 END" for k, c in enumerate(RULES.values()))
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
windows AS (SELECT r, p, w[p:p + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM w)),
repeated AS (SELECT r, p FROM windows SEMI JOIN (SELECT r, x FROM windows GROUP BY r, x HAVING count(*) > 1) USING (r, x)),
covered AS (SELECT r, count(DISTINCT k) AS n_repeat_words FROM (SELECT r, unnest([p, p + 1, p + 2]) AS k FROM repeated) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
   len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(list_filter(lines, lambda x: regexp_matches(x, '^[ \x09]*[-*•]'))) AS n_bullet_lines,
   len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines, length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_letters FROM w LEFT JOIN covered USING (r)),
b AS (SELECT *, {_BITS} AS bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
 (bits & {POLICIES["base"].mask}) <> 0 AS base_failed, (bits & {POLICIES[CURRENT].mask}) = 0 AS kept, bits::BIGINT AS fail_bits, '{CURRENT}' AS policy FROM b
"""
