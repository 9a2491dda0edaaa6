"""Audit of how filters act together, by truth-table survival words.

A document fails some of up to five filters. Its word has a bit for every subset of
the filters, set where the document survives that subset. Positional popcounts over
all words, by part and label, are the numbers of survivors of every subset, and from
these alone follows what each filter removes in any order. The popcounts go through
carry-save adders: three words of one weight become one of the same and one of twice
the weight, so a counter never holds more than two words a weight.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import cut, discard, documents, join_counted, slim, table

MOST_FILTERS = 5
MOST_KEYS = 4096  # counters that a task holds before it passes on what they have counted
COPIES = "E"
LETTERS = "ABCDE"


def words(text: Column) -> Column:
    """Maximal runs of anything but the space and the characters 9 to 13."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def text_filters(text: Column) -> dict[str, Column]:
    """The audited filters that look at one text; each is true where the text fails."""
    w = words(text)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(w) < 50,
        "B": 100 * F.size(F.array_distinct(w)) < 65 * F.size(w),
        "C": 100 * capitals > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def survival_words(n_filters: int) -> np.ndarray:
    """The word of each set of failed filters: bit s is set where the set and subset s have no filter in common."""
    sets = np.arange(1 << n_filters)
    alive = (sets[:, None] & sets[None, :]) == 0
    return (alive.astype(np.uint64) << sets.astype(np.uint64)).sum(1).astype(np.uint32)


class Counter:
    """Vertical counters of 32 bit positions: at most two words of each weight, after every addition."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, words: np.ndarray) -> None:
        level, coming = 0, np.asarray(words, np.uint32)
        while len(coming):
            if level == len(self.levels):
                self.levels.append(np.zeros(0, np.uint32))
            held, carries = np.concatenate([self.levels[level], coming]), []
            while len(held) > 2:
                third = len(held) // 3
                a, b, c, rest = held[:third], held[third : 2 * third], held[2 * third : 3 * third], held[3 * third :]
                half = a ^ b
                carries.append((a & b) | (half & c))
                held = np.concatenate([half ^ c, rest])
            self.levels[level] = held
            level, coming = level + 1, np.concatenate(carries) if carries else np.zeros(0, np.uint32)

    def counts(self, positions: int = 32) -> np.ndarray:
        total = np.zeros(positions, np.int64)
        for level, held in enumerate(self.levels):
            total += ((held[:, None] >> np.arange(positions, dtype=np.uint32)) & 1).sum(0, dtype=np.int64) << level
        return total


def subset_survivors(failed: DataFrame, n_filters: int) -> DataFrame:
    """part, subset, n, good and toxic: survivors of every subset of the filters.

    failed has part (string), failed (int, a bit a filter) and label (1: good, 2: toxic,
    3: both). A task counts its own rows, so the shuffle gets 2^n_filters rows for each
    task, part and label at most.
    """
    subsets = 1 << n_filters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counters = survival_words(n_filters), {}

        def passed_on() -> pa.RecordBatch:
            keys, n = list(counters), len(counters)
            counts = np.stack([counters[k].counts(subsets) for k in keys]) if n else np.zeros((0, subsets), np.int64)
            counters.clear()
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32())]
            return pa.RecordBatch.from_arrays(
                [*[c.take(pa.array(np.repeat(np.arange(n), subsets))) for c in columns], pa.array(np.tile(np.arange(subsets, dtype=np.int32), n)), pa.array(counts.ravel())],
                ["part", "label", "subset", "n"],
            )

        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            part, label = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).to_numpy(zero_copy_only=False)
            words = table[batch.column(1).to_numpy(zero_copy_only=False)]
            names, group = parts.dictionary.to_pylist(), part * 4 + label
            order = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
            for own in np.split(order, cuts[1:]) if len(order) else []:
                key = (names[part[own[0]]], int(label[own[0]]))
                counters.setdefault(key, Counter()).add(words[own])
            if len(counters) > MOST_KEYS:
                yield passed_on()
        yield passed_on()

    rows = failed.select("part", F.col("failed").cast("int"), F.col("label").cast("int")).mapInArrow(run, "part string, label int, subset int, n long")
    of = lambda bit: F.sum(F.when(F.col("label").bitwiseAND(F.lit(bit)) > 0, F.col("n")).otherwise(0))
    return rows.groupBy("part", "subset").agg(F.sum("n").alias("n"), of(1).alias("good"), of(2).alias("toxic"))


def order_report(survivors: DataFrame, names: str) -> DataFrame:
    """What every filter removes at its step of every order, by part, from the survivors of the subsets.

    names has a letter a filter; bit k of a subset is letter k. A part has 2^n rows of
    survivors, which become one array, and n! n rows of the report.
    """
    subsets, full = 1 << len(names), (1 << len(names)) - 1
    by_part = survivors.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("s"))
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(names)])
    steps = by_part.select("part", "s", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("step"))
    bit_of = F.create_map(*[x for i, letter in enumerate(names) for x in (F.lit(letter), F.lit(1 << i))])
    own = F.element_at(bit_of, F.substring("filter_order", F.col("step"), F.lit(1)))
    before = F.aggregate(F.slice(F.split("filter_order", ""), F.lit(1), F.col("step") - 1), F.lit(0), lambda acc, letter: acc + F.element_at(bit_of, letter))
    steps = steps.withColumn("own", own).withColumn("before", before)
    at = lambda subset, field: F.col("s")[subset][field]
    after = F.col("before") + F.col("own")
    lost = lambda field: at(F.col("before"), field) - at(after, field)
    # Over all orders a filter stands after exactly the subset t in |t|! (n - 1 - |t|)! of them.
    weight = [math.factorial(t.bit_count()) * math.factorial(max(0, len(names) - 1 - t.bit_count())) for t in range(subsets)]
    shapley = sum(
        (F.when(F.lit(t).bitwiseAND(F.col("own")) == 0, F.lit(weight[t]) * (at(F.lit(t), "n") - at(F.col("own").bitwiseOR(F.lit(t)), "n"))).otherwise(0) for t in range(subsets)),
        F.lit(0).cast("long"),
    )
    fails = at(F.lit(0), "n") - at(F.col("own"), "n")
    return steps.select(
        "part", "filter_order", "step", at(after, "n").alias("kept"), lost("n").alias("removed"), (fails - lost("n")).alias("redundant"),
        (at(F.lit(full) - F.col("own"), "n") - at(F.lit(full), "n")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), shapley.cast("long").alias("shapley"),
    )


def failed_filters(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """part, failed and label of every document, and the tables behind it, to be discarded once it is read.

    Texts are read once. A text's first document is the least id that has it, table-wide;
    texts are told by their SHA-256. A null text is an empty one and its copy; a row without
    an id is no copy and makes none; repeated rows of one id are not copies of each other.
    A document is good (toxic) if any of its rows in labels says so.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(text_filters(F.col("t")).values())), F.lit(0))
    rows = slim(docs, "doc_id", "text", "source").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), text.alias("t"))
    rows = cut(rows.select("doc_id", "part", F.sha2("t", 256).alias("digest"), bits.alias("failed")), "filters")
    repeated = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copied-texts")
    marked = join_counted(rows, repeated, "digest", rows.count(), "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    marked = marked.select("doc_id", "part", F.when(copy, F.col("failed") + (1 << LETTERS.index(COPIES))).otherwise(F.col("failed")).alias("failed"))
    says = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = slim(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((says("quality") + 2 * says("toxic")).alias("label")).where("label > 0")
    known = marked.where("doc_id IS NOT NULL").join(marks, "doc_id", "left")
    unknown = marked.where("doc_id IS NULL").withColumn("label", F.lit(0))
    return known.unionByName(unknown).select("part", "failed", F.coalesce("label", F.lit(0)).alias("label")), [rows, repeated]


def op13_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of the five filters over all documents, by source.

    Null texts are empty; a null source is the part ''; a document in labels several times
    counts once; labels of unknown documents and null labels count nothing; an empty table
    gives no rows; extra columns are not read; texts are read whole, however long.
    """
    failed, behind = failed_filters(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    survivors = cut(subset_survivors(failed, len(LETTERS)), "survivors")
    discard(*behind)
    return order_report(survivors, LETTERS)


_WORDS = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
w AS (SELECT r, doc_id, part, t, regexp_extract_all(t, '{_WORDS}') AS w FROM d),
f AS (SELECT w.r, w.doc_id, w.part,
   (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END) AS a, (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 1 ELSE 0 END) AS b,
   (CASE WHEN 100 * length(regexp_replace(w.t, '[^A-Z]+', '', 'g')) > 5 * length(w.t) THEN 1 ELSE 0 END) AS c,
   (CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 1 ELSE 0 END) AS d, (CASE WHEN w.doc_id > first THEN 1 ELSE 0 END) AS e FROM w JOIN firsts USING (t)),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
g AS (SELECT part, [a, b, c, d, e] AS fails, a + b + c + d + e AS n_fails, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
o AS (SELECT [x1.k, x2.k, x3.k, x4.k, x5.k] AS ks FROM x x1, x x2, x x3, x x4, x x5 WHERE len(list_distinct([x1.k, x2.k, x3.k, x4.k, x5.k])) = 5),
s AS (SELECT ks, x.k AS step, ks[x.k] AS own, CASE WHEN x.k = 1 THEN []::INTEGER[] ELSE ks[1:x.k - 1] END AS prior, array_to_string(list_transform(ks, lambda k: 'ABCDE'[k]), '') AS filter_order FROM o, x),
q AS (SELECT g.*, s.filter_order, s.step, s.own, g.fails[s.own] = 1 AS fails_own, list_sum([0::BIGINT] || list_transform(s.prior, lambda k: g.fails[k]::BIGINT)) = 0 AS here FROM g, s),
t AS (SELECT part, filter_order, step, any_value(own) AS own, coalesce(sum(n) FILTER (here AND NOT fails_own), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND fails_own), 0)::BIGINT AS removed,
   coalesce(sum(n) FILTER (NOT here AND fails_own), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails_own AND n_fails = 1), 0)::BIGINT AS unique_fails,
   coalesce(sum(n) FILTER (here AND fails_own AND good = 1), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (here AND fails_own AND bad = 1), 0)::BIGINT AS toxic_lost FROM q GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM t
"""
