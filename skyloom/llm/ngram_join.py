"""N-gram Jaccard self join by MinHash banding.

Documents with the same set of word n-grams form a class and one of them stands
for all. A class has BANDS hashes of ROWS minima each; classes that agree in a
band are candidates. At a similarity of 0.8 a pair misses all 40 bands of 6 rows
with probability (1 - 0.8**6)**40 = 5e-6. Band hashes are shuffled, never pairs:
candidates are tied into groups, and a group's full n-gram sets meet in one task,
which counts common n-grams through an inverted index. Groups too large for one
task are verified band by band instead, and bands too large for one task in pairs
of blocks, so no size is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm import textnum
from skyloom.llm.common import cut, discard, documents, join_counted, slim, without
from skyloom.llm.components import connected_components

NGRAM, BANDS, ROWS = 5, 40, 6
SIMILAR = (4, 5)  # Jaccard similarity of at least 4/5, compared in integers
UNIT_MEMBERS, UNIT_GRAMS = 3000, 1_000_000  # what one task compares at once
BROADCAST_ROWS = 200_000  # ids of 8 bytes

SKETCH = "doc_id long, n_grams long, d1 long, d2 long, bands array<long>"


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _grams(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, at = textnum.words(*textnum.string_buffer(batch.column(1)))
    return textnum.shingles(hashes, at, n)


def _digest(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets of n-grams apart, whatever their order."""
    with np.errstate(over="ignore"):
        return tuple(int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (grams, textnum.mix64(grams)))


def _class() -> Column:
    """A class by the digest of its n-gram set: documents of one id may be in different classes."""
    return F.xxhash64("n_grams", "d1", "d2")


def sketch(docs: DataFrame, n: int = NGRAM, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Distinct n-grams, a 128-bit digest of their set and the band hashes of every whole text."""
    mask, factor = _constants(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textnum.slices(batches, "text", 1 << 18):
            grams, at = _grams(batch, n)
            full = np.flatnonzero(np.diff(at) > 0)
            count, d1, d2 = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            with np.errstate(over="ignore"):
                for k in full.tolist():
                    own = np.unique(grams[at[k] : at[k + 1]])
                    count[k] = len(own)
                    d1[k], d2[k] = _digest(own)
                keys = np.zeros((len(full), bands), np.uint64)
                if len(full):
                    x, starts = (grams >> np.uint64(32)).astype(np.uint32), at[:-1][full]
                    for band in range(bands):
                        key = np.full(len(full), band + 1, np.uint64)
                        for k in range(band * rows, (band + 1) * rows):
                            key = textnum.mix64(key) + np.minimum.reduceat((x ^ mask[k]) * factor[k], starts)
                        keys[:, band] = textnum.mix64(key)
            ends = np.concatenate([[0], np.cumsum(np.where(np.diff(at) > 0, bands, 0))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(count), pa.array(d1), pa.array(d2), lists], ["doc_id", "n_grams", "d1", "d2", "bands"])

    return slim(docs, "doc_id", "text").mapInArrow(run, SKETCH)


def gram_sets(docs: DataFrame, ids: DataFrame, n: int = NGRAM) -> DataFrame:
    """rep and its sorted n-gram hashes, for the classes in ids (rep, doc_id of one of its documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textnum.slices(batches, "text", 1 << 20):
            grams, at = _grams(batch, n)
            sets = [np.unique(grams[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            columns = [pa.array([len(x) for x in sets], pa.int64()), *[pa.array([_digest(x)[k] for x in sets], pa.int64()) for k in range(2)], pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["n_grams", "d1", "d2", "grams"])

    few = ids.count() <= BROADCAST_ROWS  # else the ids are shuffled like the texts
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    found = slim(docs, "doc_id", "text").join(small(ids.select("doc_id").distinct()), "doc_id", "left_semi")
    found = found.mapInArrow(run, "n_grams long, d1 long, d2 long, grams binary").select(_class().alias("rep"), "grams")
    return found.join(small(ids.select("rep")), "rep", "left_semi").dropDuplicates(["rep"])


def _compare(members: list[dict]) -> Iterator[tuple[int, int, int]]:
    """rep, least rep tied to it within the unit, and the copies of all its similar partners."""
    m = len(members)
    sets = [np.frombuffer(x["grams"], np.uint64) for x in members]
    sizes = np.asarray([len(s) for s in sets])
    owner = np.repeat(np.arange(m), sizes)
    _, gram = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(gram, kind="stable")
    postings, first = owner[order], np.concatenate([[0], np.cumsum(np.bincount(gram))])
    at = np.concatenate([[0], np.cumsum(sizes)])
    copies = np.asarray([x["copies"] for x in members])
    key, block = members[0]["key"], np.asarray([x["block"] for x in members])
    bands = np.asarray([x["bands"] for x in members]) if key is not None else None
    two_blocks = members[0]["unit"]["i"] != members[0]["unit"]["j"]  # by the unit, not the members: one of its blocks may be empty
    reps = np.asarray([x["rep"] for x in members])
    links, label = np.zeros(m, np.int64), np.arange(m)
    ties: list[tuple[np.ndarray, int]] = []
    for i in range(m):
        own = gram[at[i] : at[i + 1]]
        length = first[own + 1] - first[own]
        where = np.arange(length.sum()) + np.repeat(first[own] - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        common = np.bincount(postings[where], minlength=m)
        common[: i + 1] = 0
        near = np.flatnonzero(common * (SIMILAR[0] + SIMILAR[1]) >= SIMILAR[0] * (sizes[i] + sizes))
        if key is not None:  # a pair counts in the first band it shares
            same = bands[near] == bands[i]
            near = near[same.any(1)]
            same = bands[near] == bands[i]
            near = near[bands[near, same.argmax(1)] == key]
            if two_blocks:
                near = near[block[near] != block[i]]
        links[i] += copies[near].sum()
        links[near] += copies[i]
        if len(near):
            ties.append((near, i))
    changed = True
    while changed:
        changed = False
        for near, i in ties:
            low = min(label[i], label[near].min())
            if label[i] != low or (label[near] != low).any():
                label[i] = low
                label[near] = low
                changed = True
    least = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(least, label, reps)
    yield from zip(reps.tolist(), least[label].tolist(), links.tolist(), strict=True)


def verify(units: DataFrame) -> DataFrame:
    """Compares the members of each unit; rows (unit, key, block, rep, copies, bands, grams), a task holds one unit at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["rep", "root", "links"])

        unit, members, done = None, [], []
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for row in batch.slice(lo, 256).to_pylist():
                    if row["unit"] != unit:
                        done += _compare(members) if len(members) > 1 else []
                        unit, members = row["unit"], []
                        if len(done) > 5000:
                            yield out(done)
                            done = []
                    members.append(row)
        done += _compare(members) if len(members) > 1 else []
        yield out(done)

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "rep long, root long, links long")


def similar_classes(docs: DataFrame) -> DataFrame:
    """One row per document: class_id, the least doc_id reachable over links, and n_links.

    A link joins two documents whose n-gram sets have a Jaccard similarity of 0.8 or
    more; copies are linked. A text of fewer than five words is one n-gram. Documents
    without words and null ids have no links and class_id doc_id; repeated rows are
    copies of each other; different texts under one id are told apart, and each has its
    own row; an empty table gives no rows; extra columns are not read; texts are compared
    whole, however long.
    """
    sketched = cut(sketch(docs).select("doc_id", "n_grams", _class().alias("rep"), "bands"), "sketch")
    usable = sketched.where((F.col("n_grams") > 0) & F.col("doc_id").isNotNull())
    classes = cut(
        usable.groupBy("rep").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("n_grams").alias("n_grams")),
        "classes",
    )
    keys = cut(classes.select("rep", F.explode("bands").alias("key")), "keys")
    shared = cut(keys.groupBy("key").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-keys")
    member = cut(join_counted(keys, shared, "key", shared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n).select("key", "rep", "least"), "members")
    discard(keys, shared)
    group = cut(connected_components(member.select(F.col("rep").alias("a"), F.col("least").alias("b"))), "groups")

    known = cut(classes.join(group.withColumnRenamed("node", "rep"), "rep").select("rep", "doc_id", "copies", "bands", "component", "n_grams"), "grouped")
    sets = cut(gram_sets(docs, known.select("rep", "doc_id")), "gram-sets")
    size = known.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("g"))
    sized = cut(join_counted(known, size, "component", known.count()).withColumn("fits", (F.col("n") <= UNIT_MEMBERS) & (F.col("g") <= UNIT_GRAMS)), "sized")
    units = sized.where("fits").select(F.struct(F.col("component").alias("x"), F.lit(0).alias("i"), F.lit(0).alias("j")).alias("unit"), F.lit(None).cast("long").alias("key"), F.lit(0).alias("block"), "rep", "copies", F.array().cast("array<long>").alias("bands"))
    large = sized.where("NOT fits")
    any_large = not large.isEmpty()
    if any_large:
        rows = cut(member.select("key", "rep").join(large.select("rep", "copies", "bands", "n_grams"), "rep"), "large-members")
        blocks = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.greatest(2 * F.count(F.lit(1)) / F.lit(UNIT_MEMBERS), 2 * F.sum("n_grams") / F.lit(UNIT_GRAMS))).cast("int").alias("nb"))
        blocks = cut(blocks.withColumn("nb", F.when(F.col("nb") <= 2, 1).otherwise(F.col("nb"))), "blocks")
        rows = join_counted(rows, blocks, "key", rows.count()).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        unit = F.struct(F.col("key").alias("x"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        units = units.unionByName(rows.select(unit.alias("unit"), "key", "block", "rep", "copies", "bands"))
    verified = cut(verify(units.join(sets, "rep")), "verified")
    discard(sets)
    found = verified.groupBy("rep").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    if any_large:  # units of large groups overlap: what they tied is joined up
        tied = verified.join(large.select("rep"), "rep", "left_semi").select(F.col("rep").alias("a"), F.col("root").alias("b"))
        final = connected_components(tied).select(F.col("node").alias("rep"), "component")
        found = found.join(final, "rep", "left").withColumn("root", F.coalesce("component", "root")).drop("component")
    # The least document of each tied group of classes; all that a document needs to know of its class, a row a class that has copies or partners.
    found = cut(found.join(classes.select("rep", "doc_id"), "rep"), "found")
    roots = found.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    tied = join_counted(found, roots, "root", found.count()).select("rep", "links", "class_id")
    noted = classes.select("rep", F.col("doc_id").alias("least"), F.col("copies").alias("n")).join(tied, "rep", "left").where("n > 1 OR class_id IS NOT NULL")
    noted = cut(noted.select("rep", "n", F.coalesce("class_id", "least").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "noted")
    rows = usable.select("doc_id", "rep", "n_grams")
    joined = join_counted(rows, noted, "rep", rows.count(), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_grams")
    rest = sketched.where((F.col("n_grams") <= 0) | F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "n_grams")
    return joined.unionByName(rest)


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay: the one with the least doc_id of each class, with all columns.

    Rows without an id and texts without words stay; of rows with one id and text, one
    stays. Where an id has several texts, they stay if one of them stays. An empty table
    gives no rows.
    """
    classes = cut(similar_classes(docs), "classes-of-documents")
    stays = classes.where("class_id = doc_id").select("doc_id").distinct()
    gone = without(docs, classes.where("class_id <> doc_id").select("doc_id").distinct().join(stays, "doc_id", "left_anti"))
    again = classes.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id")
    if again.isEmpty():
        return gone
    return without(gone, again).unionByName(gone.join(again, "doc_id", "left_semi").select(*gone.columns).dropDuplicates(["doc_id", "text"]))


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_classes(documents(spark, sf_dir))


#: Exact join on the strings themselves: links are counted from an inverted index.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS s
  FROM w WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE p.c * 9 >= 4 * (x.n + y.n)
), r AS (
  WITH RECURSIVE t(a, b) AS (SELECT a, b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a) SELECT a, min(b) AS b FROM t GROUP BY a
)
SELECT d.doc_id, least(d.doc_id, coalesce(r.b, d.doc_id)) AS class_id,
  coalesce((SELECT count(*) FROM l WHERE l.a = d.doc_id), 0) AS n_links, coalesce(n.n, 0) AS n_grams
FROM documents d LEFT JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
