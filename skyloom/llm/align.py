"""Alignment of two tokenizers on the same texts, and how often their tokens end together.

Both tokenizers cut the bytes of a text with one space in front. Where a token of each
ends at the same byte the text is cut into groups. The cuts are found by divide and
conquer: near the middle of an interval a common end is looked for by bisection, and
both halves are searched in turn; an interval without one is a leaf, a group. All
intervals of a level, over all texts of a slice, are searched at once in numpy.

Every cut links the two tokens that end there. Links are counted over the corpus by
pair of ids, and each text is then measured by the counts of its own links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import textnum, tokens
from skyloom.llm.common import cut, documents, join_counted, slim

PIECES = "piece_bpe_32k.model"
SLICE_BYTES = 1 << 20  # of text aligned at once
MOST_HELD = 1 << 20  # pairs that a task counts before it passes them on
BROADCAST_PAIRS = 1 << 20  # of 13 bytes; with more the links are joined to the counts
SPACE_MARK = "▁"


def piece_file(name: str = PIECES) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def byte_side(path: str):
    """Encoding function and the bytes of every id of a byte-level vocabulary (a rank file)."""
    encoding = tokens.encoder(path)
    by_id = [b""] * encoding.n_vocab
    for token in encoding.token_byte_values():
        by_id[encoding.encode_single_token(token)] = token
    return lambda texts: [encoding.encode_to_numpy(" " + t, allowed_special=set(), disallowed_special=()).astype(np.int64) for t in texts], by_id


@lru_cache(maxsize=4)
def piece_side(path: str):
    """The same of a sentence-piece model, which adds the space itself."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    piece = lambda i: bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(SPACE_MARK, " ").encode()
    by_id = [piece(i) for i in range(model.get_piece_size())]
    return lambda texts: [np.asarray(ids, np.int64) for ids in model.encode(texts, num_threads=1)], by_id


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... for each k, counts[k] of them, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _near_middle(low: np.ndarray, high: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each interval low..high of tokens one whose end is in other, as near to the middle as there is; -1 without any.

    Tokens are tried at distances from the middle that double from round to round, each by bisection.
    """
    middle, found = (low + high) // 2, np.full(len(low), -1, np.int64)
    open_, near = np.arange(len(low)), 0
    far = 0
    while len(open_):
        m, lo, hi = middle[open_], low[open_], high[open_]
        left, right = np.maximum(lo, m - far), np.minimum(hi, m + far)
        before, after = np.maximum(0, m - near + 1 - left) if near else np.ones(len(m), np.int64), np.maximum(0, right - (m + near) + 1) if near else np.zeros(len(m), np.int64)
        owner = np.repeat(np.arange(len(open_)), before + after)
        tried = _ranges(np.stack([left, m + near], 1).ravel(), np.stack([before, after], 1).ravel())
        place = np.searchsorted(other, ends[tried])
        hit = other[np.minimum(place, len(other) - 1)] == ends[tried]
        own, tried = owner[hit], tried[hit]
        order = np.lexsort((np.abs(tried - m[own]), own))
        own, tried = own[order], tried[order]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        found[open_[own[first]]] = tried[first]
        near, far = far + 1, 2 * far + 1
        open_ = open_[(found[open_] < 0) & ((m - near >= lo) | (m + near <= hi))]
    return found


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, last_a: np.ndarray) -> np.ndarray:
    """Whether each token of the first side ends where one of the second does.

    Ends run on from text to text; last_a has the last token of every text, which always does.
    """
    cuts = np.zeros(len(ends_a), bool)
    cuts[last_a] = True
    low, high = np.concatenate([[0], last_a[:-1] + 1]), last_a - 1
    while len(low := low[inside := low <= high]):
        high = high[inside]
        found = _near_middle(low, high, ends_a, ends_b)
        whole = found >= 0  # the others are leaves
        low, high, found = low[whole], high[whole], found[whole]
        cuts[found] = True
        low, high = np.concatenate([low, found + 1]), np.concatenate([found - 1, high])
    return cuts


@lru_cache(maxsize=1)
def _decimal() -> tuple[np.ndarray, np.ndarray]:
    """Digits of the numbers below 10^5, to the right of five places, and how many they are."""
    n = np.arange(100_000)
    digits = np.stack([n // 10**k % 10 for k in (4, 3, 2, 1, 0)], 1).astype(np.uint8) + ord("0")
    return digits, np.searchsorted([10, 100, 1000, 10_000], n, side="right") + 1


def group_digests(ids_a, ids_b, cuts_a, cuts_b, at_a, at_b) -> list[str]:
    """SHA-256 of each text's groups, written ``a1,a2|b1;a3|b2,b3``; at_a and at_b are token offsets by text."""
    group_a, group_b = np.cumsum(cuts_a) - cuts_a, np.cumsum(cuts_b) - cuts_b
    place_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)
    place_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, side="right")
    digits, width = _decimal()
    cells = np.empty((len(ids_a) + len(ids_b), 6), np.uint8)
    cells[place_a, :5], cells[place_b, :5] = digits[ids_a], digits[ids_b]
    cells[place_a, 5] = np.where(cuts_a, ord("|"), ord(","))
    cells[place_b, 5] = np.where(cuts_b, ord(";"), ord(","))
    widths = np.empty(len(cells), np.int64)
    widths[place_a], widths[place_b] = width[ids_a], width[ids_b]
    text = cells[np.arange(6) >= (5 - widths)[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(widths + 1)])[at_a + at_b]
    return [hashlib.sha256(text[a : b - 1]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def aligned(docs: DataFrame, ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """Token, group and link numbers of every text, the digest of its groups, and its different links.

    A link is written a * size of the second vocabulary + b. Texts that are null or empty, or
    that the tokens of either side don't spell, have no tokens: numbers 0, an empty digest
    and no links. Repeated rows are aligned each, alike.
    """
    ranks, pieces = ranks or tokens.rank_file(), pieces or piece_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_a, bytes_a = byte_side(ranks)
        encode_b, bytes_b = piece_side(pieces)
        size_a, size_b = np.asarray([len(x) for x in bytes_a]), np.asarray([len(x) for x in bytes_b])
        for batch in textnum.slices(batches, "text", SLICE_BYTES):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            some = [k for k, t in enumerate(texts) if t]
            both = []
            for k, a, b in zip(some, encode_a([texts[k] for k in some]), encode_b([texts[k] for k in some]), strict=True):
                wanted = (" " + texts[k]).encode()
                if b"".join([bytes_a[x] for x in a.tolist()]) == wanted and b"".join([bytes_b[x] for x in b.tolist()]) == wanted:
                    both.append((k, a, b))
            numbers = np.zeros((len(texts), 4), np.int64)
            digests, pairs, times = [""] * len(texts), [[]] * len(texts), [[]] * len(texts)
            if both:
                at_a, at_b = (np.concatenate([[0], np.cumsum([len(x[side]) for x in both])]) for side in (1, 2))
                ids_a, ids_b = np.concatenate([x[1] for x in both]), np.concatenate([x[2] for x in both])
                ends_a, ends_b = np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])
                cuts_a = common_ends(ends_a, ends_b, at_a[1:] - 1)
                cuts_b = np.zeros(len(ids_b), bool)
                cuts_b[np.searchsorted(ends_b, ends_a[cuts_a])] = True
                links = ids_a[cuts_a] * len(bytes_b) + ids_b[cuts_b]
                cut_at = np.concatenate([[0], np.cumsum(cuts_a)])[at_a]
                for n, ((k, a, b), digest) in enumerate(zip(both, group_digests(ids_a, ids_b, cuts_a, cuts_b, at_a, at_b), strict=True)):
                    own = links[cut_at[n] : cut_at[n + 1]]
                    numbers[k] = len(a), len(b), len(own), len(own)
                    digests[k] = digest
                    pairs[k], times[k] = np.unique(own, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c) for c in numbers.T], pa.array(digests), pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )

    return slim(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ALIGNED)


def _flat(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind)


def pair_counts(texts: DataFrame) -> DataFrame:
    """pair and n: the number of links of every id pair over all aligned texts.

    A task adds up the pairs of its own texts first, so a frequent pair is one row of each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])
        for batch in batches:
            pairs, inverse = np.unique(np.concatenate([pairs, _flat(batch.column(0), np.int64)]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, _flat(batch.column(1), np.int64)]), len(pairs)).astype(np.int64)
            if len(pairs) > MOST_HELD:
                yield out()
                pairs, counts = pairs[:0], counts[:0]
        yield out()

    return texts.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def with_best(counts: DataFrame, size_b: int) -> DataFrame:
    """Marks the pairs whose count is the highest of their second id; that side has a row an id of the vocabulary."""
    second = F.pmod("pair", F.lit(size_b))
    highest = counts.groupBy(second.alias("b")).agg(F.max("n").alias("highest"))
    return counts.withColumn("b", second).join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def measured(texts: DataFrame, counts: DataFrame, most: int | None = None) -> DataFrame:
    """Adds n_best and count_sum to written aligned texts: links whose pair is its second id's most frequent, and the sum of counts.

    Up to ``most`` different pairs are broadcast; with more, the links of each text are
    joined to the counts, hot pairs by broadcast, the rest by shuffle.
    """
    spark = texts.sparkSession
    numbers = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    size = counts.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("links")).first()
    if size.pairs > (BROADCAST_PAIRS if most is None else most):
        links = texts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
        found = join_counted(links, counts, "pair", size.links)
        found = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return texts.join(found, "row", "left").select(*numbers, zero("n_best"), zero("count_sum"), "groups_sha256")
    known = counts.toArrow().sort_by("pair")  # at most ``most`` rows
    model = spark.sparkContext.broadcast([known.column(c).to_numpy() for c in ("pair", "n", "best")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = model.value
        for batch in batches:
            at = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(batch.column(6)).to_numpy(zero_copy_only=False).astype(np.int64))])
            times, place = _flat(batch.column(7), np.int64), np.searchsorted(pair, _flat(batch.column(6), np.int64))
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in ((best[place] * times, n[place] * times) if len(place) else (times, times))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *[pa.array(s[at[1:]] - s[at[:-1]]) for s in sums], batch.column(5)], [*numbers, "n_best", "count_sum", "groups_sha256"])

    shape = ", ".join(f"{c} long" for c in [*numbers, "n_best", "count_sum"]) + ", groups_sha256 string"
    return texts.select(*numbers, "groups_sha256", "pairs", "times").mapInArrow(run, shape)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of all documents under the two public vocabularies, with corpus-wide link counts.

    Rows without an id and repeated rows count as texts of their own; an empty table gives
    no rows; extra columns are not read; texts are encoded whole, however long. Ties for the
    highest count of an id all count as highest.
    """
    texts = cut(aligned(documents(spark, sf_dir)).withColumn("row", F.monotonically_increasing_id()), "aligned", "zstd")
    counts = cut(pair_counts(texts), "pair-counts")
    return measured(texts, with_best(counts, len(piece_side(piece_file())[1])))
