"""Benchmark decontamination with DataFrame functions only.

Texts and items become lower-case words (letters and digits) and shingles of five
words, kept as 64-bit hashes. Windows of a text have the size of an item; theirs and
the items' SimHash fingerprints of 64 bits weigh a shingle by how often it occurs.
Fingerprints are cut into ten blocks; two that differ in at most 19 bits differ in at
most one bit in some block, so an index of every item's blocks and their one-bit
neighbours finds all pairs within the radius. Candidates are verified by the exact
weighted Jaccard similarity of their shingles. Windows with equal shingles are
fingerprinted and verified once.

Only windows that begin with a shingle of some item of their size, and the last of a
text, are laid. That loses none: where a window begins with a shingle that the item
doesn't hold, the next window has at least as much in common with the item. So for
each item the last of a text's most similar windows is always among those laid.

A similarity of 0.8 is an angle of 0.15 pi and so 9.7 differing bits on average,
with a spread of 2.9: the radius lies more than three spreads above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import cut, discard, documents, slim, table, without

NGRAM, SIMILARITY, RADIUS = 5, 0.8, 19
#: First bit and width of each block; the ten together are the 64 bits.
BLOCKS = tuple((k * 64 // 10, (k + 1) * 64 // 10 - k * 64 // 10) for k in range(10))
BROADCAST_ROWS = 500_000  # rows of at most six numbers


def words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingle(w: str, at: Column, k: int) -> Column:
    """Hash of the k words from a place (counted from 0)."""
    return F.xxhash64(F.lit(k), *[F.get(F.col(w), at + j) for j in range(k)])


def shingles(w: str, first: Column, count: Column, k: Column, lengths: list[int]) -> Column:
    """Hashes of ``count`` shingles of k words one after the other; k is one of lengths."""

    def of_length(x: int) -> Column:
        return F.when(k == x, F.transform(F.sequence(first, first + count - 1), lambda i: shingle(w, i, x)))

    return F.coalesce(*[of_length(x) for x in lengths])


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it has few rows; otherwise Spark joins it by a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def fingerprint(hashes: str) -> Column:
    """SimHash of an array of hashes: a bit is set where more than half of them have it."""
    h = F.col(hashes)
    ones = lambda b: F.aggregate(h, F.lit(0), lambda s, x: s + F.expr("int(1)") * F.getbit(x, b).cast("int"))
    bit = lambda b: F.when(ones(b) * 2 > F.size(h), F.expr("bigint(1)")).otherwise(F.expr("bigint(0)"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(F.call_function("shiftleft", bit(b), b)))


def block_values(fingerprint: str, near: bool) -> Column:
    """Array of (block, value): each block of a fingerprint, with near also all one-bit neighbours."""

    def of_block(k: int, first: int, width: int) -> Column:
        value = F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        flips = F.array(*[F.lit(x) for x in [0, *([1 << b for b in range(width)] if near else [])]])
        return F.transform(flips, lambda x: F.struct(F.lit(k).alias("block"), value.bitwiseXOR(x).alias("value")))

    return F.concat(*[of_block(k, *block) for k, block in enumerate(BLOCKS)])


RESULT = "doc_id long, item_id long, similarity double, start int, words int"


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that it contains: doc_id, item_id, similarity, start and words of the best window.

    An item of fewer than five words is one shingle of all its words; items without
    words match nothing. A document shorter than an item is one window. Null texts are
    empty; null ids match nothing; documents or items given twice give one row, and
    where one id has several texts all of them are compared and the best window of any
    counts; empty tables give no rows; extra columns are not read. Of equally similar
    windows the last counts. Texts are read whole, however long.
    """
    spark = docs.sparkSession
    items = slim(benchmark, "item_id", "text").where(F.col("item_id").isNotNull()).select("item_id", words("text").alias("w")).distinct()
    items = items.withColumn("size", F.size("w")).where("size > 0").withColumn("k", F.least(F.lit(NGRAM), F.col("size")))
    index = cut(
        items.select("item_id", F.xxhash64("item_id", "w").alias("item"), "size", "k", shingles("w", F.lit(0), F.col("size") - F.col("k") + 1, F.col("k"), list(range(1, NGRAM + 1))).alias("item_shingles")),
        "items",
    )
    size = index.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(F.size("item_shingles")), F.lit(0)).alias("shingles")).first()
    lengths = sorted(r.k for r in index.select("k").distinct().collect())  # at most five
    if not lengths:
        return spark.createDataFrame([], RESULT)

    # Windows: a text's shingles, found among the items', lay windows of those items' sizes.
    seeds = index.select(F.explode("item_shingles").alias("h"), "size", "k").distinct()
    rows = slim(docs, "doc_id", "text").where(F.col("doc_id").isNotNull()).select("doc_id", words("text").alias("w")).withColumn("n", F.size("w")).where(F.col("n") >= min(lengths))
    placed = rows.select("doc_id", "w", "n", F.explode(F.sequence(F.lit(0), F.col("n") - min(lengths))).alias("p"))
    hashes = F.array(*[shingle("w", F.col("p"), k) for k in lengths]) if len(lengths) > 1 else None
    placed = placed.select("doc_id", "w", "n", "p", F.explode(hashes).alias("h") if len(lengths) > 1 else shingle("w", F.col("p"), lengths[0]).alias("h"))
    hit = placed.join(_small(seeds, size.shingles), "h").where(F.col("p") + F.col("k") <= F.col("n"))
    hit = hit.withColumn("start", F.greatest(F.lit(0), F.least(F.col("p"), F.col("n") - F.col("size")))).withColumn("length", F.least("size", "n"))
    count = F.greatest(F.lit(1), F.col("length") - F.col("k") + 1)
    windows = hit.select("doc_id", "start", "length", "size", shingles("w", F.col("start"), count, F.col("k"), lengths).alias("shingles"))
    windows = cut(windows.withColumn("content", F.xxhash64("size", "shingles")).distinct(), "windows")

    # Fingerprints of different windows, and candidates from the index of the items' blocks.
    contents = cut(windows.select("content", "size", "shingles").dropDuplicates(["content"]), "contents")
    prints = contents.select("content", "size", fingerprint("shingles").alias("print")).select("*", F.inline(block_values("print", False)))
    item_prints = index.select("item", "size", fingerprint("item_shingles").alias("item_print"))
    item_blocks = item_prints.select("*", F.inline(block_values("item_print", True)))
    near = prints.join(_small(item_blocks, 80 * size["items"]), ["size", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    candidates = cut(near.select("content", "item").distinct(), "candidates")

    # The exact similarity of each candidate.
    counted = contents.select("content", F.explode("shingles").alias("h")).groupBy("content", "h").agg(F.count(F.lit(1)).alias("cw"))
    item_counts = index.select("item", F.explode("item_shingles").alias("h")).groupBy("item", "h").agg(F.count(F.lit(1)).alias("ci"))
    common = candidates.join(counted, "content").join(_small(item_counts, size.shingles), ["item", "h"]).groupBy("content", "item").agg(F.sum(F.least("cw", "ci")).alias("c"))
    totals = contents.select("content", F.size("shingles").alias("nw"))
    item_totals = index.select("item", "item_id", F.size("item_shingles").alias("ni"))
    scored = common.join(totals, "content").join(_small(item_totals, size["items"]), "item")
    scored = scored.withColumn("similarity", F.col("c") / (F.col("nw") + F.col("ni") - F.col("c"))).where(F.col("similarity") >= SIMILARITY)
    scored = cut(scored.select("content", "item_id", "similarity"), "verified")
    found = windows.select("doc_id", "start", "length", "content").join(_small(scored, scored.count()), "content")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", "start", "length")).alias("b"))
    best = cut(best.select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), F.col("b.start").alias("start"), F.col("b.length").alias("words")), "matches")
    discard(index, windows, contents, candidates, scored)
    return best


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no benchmark item, with all columns.

    Documents are told by id: where one of several texts under an id holds an item, all
    of them go. Null and empty texts and rows without an id stay; repeated rows stay or
    go together; with no items, or no documents, nothing changes; columns of any name
    are kept.
    """
    return without(docs, cut(matches(docs, benchmark).select("doc_id").distinct(), "contaminated"))


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


#: Every window of a text that has anything in common with an item, compared exactly, without fingerprints.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
i AS (SELECT item_id, len(w) AS size, least(5, len(w)) AS k, w FROM b WHERE len(w) > 0),
ish AS (SELECT item_id, size, k, unnest(list_transform(range(1, size - k + 2), lambda j: array_to_string(w[j:j+k-1], ' '))) AS s FROM i),
ks AS (SELECT DISTINCT k FROM i),
dsh AS (SELECT doc_id, k, len(w) AS n, unnest(range(0, len(w) - k + 1)) AS p, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j+k-1], ' '))) AS s FROM d, ks WHERE len(w) >= k),
ic AS (SELECT item_id, size, k, s, count(*) AS ci FROM ish GROUP BY ALL), it AS (SELECT item_id, sum(ci) AS ni FROM ic GROUP BY ALL),
hit AS (SELECT doc_id, n, p, item_id, size, k, s, ci, greatest(1, least(size, n) - k + 1) AS m FROM dsh JOIN ic USING (k, s)),
win AS (SELECT doc_id, item_id, size, n, k, m, s, ci, unnest(range(greatest(0, p - m + 1), least(p, greatest(0, n - size)) + 1)) AS start FROM hit),
c AS (SELECT doc_id, item_id, start, n, size, m, s, least(count(*), max(ci)) AS c FROM win GROUP BY ALL),
t AS (SELECT doc_id, item_id, start, least(size, n) AS length, m, sum(c) AS c FROM c GROUP BY ALL),
r AS (SELECT doc_id, item_id, CAST(c AS DOUBLE) / (m + ni - c) AS similarity, start, length FROM t JOIN it USING (item_id))
SELECT doc_id, item_id, similarity, CAST(start AS INTEGER) AS start, CAST(length AS INTEGER) AS words FROM r WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start DESC, length DESC) = 1
"""
