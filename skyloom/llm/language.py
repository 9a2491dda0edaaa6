"""Language identification by prediction by partial matching.

For every language a context tree of order three over bytes is filled from a
bounded sample and frozen. A byte is coded in its longest seen context; the escape
to the next shorter one has probability distinct / (total + distinct), and bytes
already seen in the longer context are excluded, so the probabilities of a context
sum to one. Trees are sparse: a byte that its context hasn't seen takes the escapes
of that context and the cost in the next shorter one, and the shortest codes all 256
bytes alike. Code lengths of a text are then sums of table entries, which numpy looks
up for all documents of a batch and all languages at once.

What is coded is the text's own bytes but for two foldings that say nothing about a
language: capitals (ASCII, and Latin-1 letters in UTF-8) become small letters, and a
run of ASCII characters that aren't letters becomes one space. All other bytes stay
as they are, in any script.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import textnum
from skyloom.llm.common import documents, fold, held_out, slim

SYMBOLS, GAP, ORDER = 256, 32, 3
SAMPLE_DOCS, SAMPLE_BYTES, LONGEST, SEED = 1500, 8 << 20, 1 << 20, 77  # of each language: documents, bytes of text, bytes of a document


def fold_bytes(raw: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters in UTF-8, a space for other ASCII characters; other bytes unchanged."""
    out = textnum.FOLD[raw]
    lead = np.zeros(len(raw), bool)
    lead[1:] = raw[:-1] == 0xC3
    upper = lead & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
    out[upper] += 0x20
    out[~textnum.LETTER[raw]] = GAP
    return out


def symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes of all documents with repeated gaps dropped, their offsets, and four-byte codes.

    A code holds the three bytes before and the byte itself; before a document's start there are gaps.
    """
    s = fold_bytes(raw)
    starts = np.zeros(len(raw) + 1, bool)
    starts[offsets[:-1]] = True
    again = np.zeros(len(s), bool)
    again[1:] = (s[1:] == GAP) & (s[:-1] == GAP)
    keep = ~again | starts[:-1] if len(s) else again
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    s = s[keep].astype(np.uint32)
    code = s.copy()
    place = np.arange(len(s)) - np.repeat(at[:-1], np.diff(at)) if len(s) else np.zeros(0, np.int64)
    for back in range(1, ORDER + 1):
        before = np.full(len(s), GAP, np.uint32)
        before[back:] = s[:-back] if len(s) > back else s[:0]
        before[place < back] = GAP
        code |= before << np.uint32(8 * back)
    return s, at, code


@dataclass
class Tree:
    """One language's context tree. By order k from 0 to ORDER: the (k + 1)-byte codes that were
    seen, sorted, with the cost in bits of the last byte; and the k-byte contexts, with the cost of escaping."""

    codes: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def cost(self, code: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each code after the bytes before it."""
        out = np.zeros(len(code))
        left = np.arange(len(code))
        for k in range(len(self.codes) - 1, -1, -1):
            own = code[left] & np.uint32((1 << (8 * (k + 1))) - 1)
            place, hit = _find(self.codes[k], own)
            out[left[hit]] += self.costs[k][place[hit]]
            left, own = left[~hit], own[~hit] >> np.uint32(8)
            place, hit = _find(self.contexts[k], own)
            out[left[hit]] += self.escapes[k][place[hit]]
        out[left] += np.log2(SYMBOLS)
        return out


def _find(ordered: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in a sorted array, and whether it is there."""
    place = np.searchsorted(ordered, x)
    hit = np.append(ordered, 0)[place] == x
    return place, hit & (place < len(ordered))


@dataclass
class ContextTrees:
    languages: list[str]
    trees: list[Tree]

    def code_lengths(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits to code each document in each language."""
        _, at, code = symbols(raw, offsets)
        out = np.zeros((len(at) - 1, len(self.languages)))
        different, place = np.unique(code, return_inverse=True)
        full = np.flatnonzero(np.diff(at) > 0)
        if len(full):
            for k, tree in enumerate(self.trees):
                out[full, k] = np.add.reduceat(tree.cost(different)[place], at[:-1][full])
        return out


def build_tree(codes: np.ndarray, counts: np.ndarray) -> Tree:
    """A frozen tree from the different four-byte codes of a sample and how often each occurs."""
    tree = Tree([], [], [], [])
    for k in range(ORDER + 1):
        own, place = np.unique(codes & np.uint32((1 << (8 * (k + 1))) - 1), return_inverse=True)
        n = np.bincount(place, counts, len(own))
        contexts, context = np.unique(own >> np.uint32(8) if k else np.zeros(len(own), np.uint32), return_inverse=True)
        total, distinct = np.bincount(context, n), np.bincount(context).astype(float)
        lower = tree.cost(own & np.uint32((1 << (8 * k)) - 1)) if k else np.full(len(own), np.log2(SYMBOLS))
        rest = 1 - np.bincount(context, 2.0**-lower)  # of the shorter context's probability, for bytes not seen in this one
        escape = np.where(distinct < SYMBOLS, distinct / (total + distinct), 0.0)
        tree.codes.append(own)
        tree.costs.append(-np.log2(n / total[context] * (1 - escape[context])))
        tree.contexts.append(contexts)
        tree.escapes.append(-np.log2(np.maximum(escape, 1e-300) / np.maximum(rest, 1e-12)))
    return tree


def training_sample(docs: DataFrame, most: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """text and lang of documents of each language outside the held-out fold, by a hash of the id: about
    ``most`` of them and ``most_bytes`` of text in expectation."""
    own = docs.where(F.col("lang").isNotNull() & (F.octet_length("text") <= LONGEST) & (fold("doc_id", 5) != 0))
    sizes = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # a row a language
    chance = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) / float(1 << 20)
    keep = F.lit(False)
    for r in sizes:
        keep = keep | ((F.col("lang") == r.lang) & (chance < min(most / r.n, most_bytes / max(r.bytes, 1))))
    return own.where(keep).select("text", "lang")


def fit(docs: DataFrame, most: int = SAMPLE_DOCS) -> ContextTrees:
    """Counts the sample's four-byte codes on Spark; the driver gets sums of a bounded sample only."""

    def count_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textnum.slices(batches, "text"):
            _, at, code = symbols(*textnum.string_buffer(batch.column(0)))
            names = batch.column(1).dictionary_encode()
            lang = np.repeat(np.asarray(names.indices), np.diff(at)).astype(np.int64)
            keys, counts = np.unique(lang << 32 | code, return_counts=True)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(keys >> 32)).cast(pa.string()), pa.array(keys & 0xFFFFFFFF), pa.array(counts)], ["lang", "code", "n"])

    sample = training_sample(slim(docs, "doc_id", "text", "lang"), most)
    rows = sample.mapInArrow(count_codes, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    rows = rows.sort_values(["lang", "code"])
    found = {k: build_tree(g["code"].to_numpy(np.uint32), g["n"].to_numpy(float)) for k, g in rows.groupby("lang")}
    return ContextTrees(sorted(found), [found[k] for k in sorted(found)])


def identify(docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """doc_id, held_out, lang_pred and score (posterior under equal priors) of every document.

    Null texts and texts without a letter are ``und`` with score 0, as is everything
    if nothing was learned. Ties go to the first language by name. Repeated rows are
    predicted each, alike; a row without an id is never learned from and counts as held
    out; an empty table gives no rows; extra columns are not read; texts are coded whole,
    however long.
    """
    model = docs.sparkSession.sparkContext.broadcast([vars(t) for t in trees.trees])  # at most SAMPLE_BYTES codes a language
    names = trees.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ContextTrees(names, [Tree(**t) for t in model.value])
        labels = pa.array([*names, "und"])
        for batch in textnum.slices(batches, "text", 1 << 20):
            bits = own.code_lengths(*textnum.string_buffer(batch.column(1)))
            known = np.asarray(batch.column(2).fill_null(False))
            best = np.argmin(bits, 1)
            gap = np.clip((bits - bits.min(1, keepdims=True)) * np.log(2), 0, 700)
            score = np.where(known, 1 / np.exp(-gap).sum(1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), labels.take(pa.array(np.where(known, best, len(names)))), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = slim(docs, "doc_id", "text")
    if names:
        found = rows.withColumn("letters", F.col("text").rlike(r"\p{L}")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    else:
        found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs))
