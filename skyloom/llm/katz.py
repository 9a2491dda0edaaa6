"""Language-model scoring: Katz back-off over words, of any order (three words by default).

Counts are gathered in blocks. A chunk of documents is tokenised once and written
with its own sorted vocabulary. It asks the owners of its words, partitions by word
hash, for numbers and training counts. Then, order by order, it asks the owners of
its n-grams, partitions by the hash of the context, and says how often each occurs
in its own training texts. An owner adds up what all chunks say: that is its part of the count
table of the order, and its back-off sums are its part of the back-off table; each chunk
gets the counts and sums of what it asked. The replies are written; the merged tables
are only on request (``gather(store=True)``), partitioned by context: the query doesn't
ask for them, as with them its disk passed the limit (README).
So every order is shuffled once, as packed arrays rather than a row a token. N-grams
of contexts that occur more than HOT times are spread over all owners by their last
word, and the back-off sums of such contexts are added up.

Low counts are discounted by Good-Turing in Katz's way, with the counts of counts of
each order. The probability of a token is evaluated recursively: the discounted
share of its n-gram where that was seen, else the context's back-off weight times
the probability after the shorter context. Weights are normalised exactly over the
training vocabulary and one unknown word, so the probabilities of any context sum
to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import textnum
from skyloom.llm.common import FEW_ROWS, cut, cut_by, discard, documents, held_out, settings, slim

ORDER = 3
K = 5  # counts above it are not discounted
CHUNK_BYTES = 3 << 20
WORDS_PER_OWNER, GRAMS_PER_OWNER = 500_000, 500_000
HOT = 100_000  # training occurrences of a context whose n-grams are spread over all owners
END = np.uint64(2)  # hash of the end token
START, NO_WORD, FIRST = (np.uint64(k) for k in range(3))  # numbers of what stands before a text, of an unknown word, and of the first known one
_OTHER = np.uint64(0x5851F42D4C957F2D)


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers as planes of their bytes, as many as the largest needs: leading zeros cost nothing and alike bytes stand together."""
    x = np.ascontiguousarray(x, np.uint64)
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return b"".join([bytes([width]), *[(x >> np.uint64(8 * k)).astype(np.uint8).tobytes() for k in range(width)]])


def unpack(b: bytes, length: int, at: int = 0) -> np.ndarray:
    out = np.zeros(length, np.uint64)
    for k in range(b[at]):
        out |= np.frombuffer(b, np.uint8, length, at + 1 + k * length).astype(np.uint64) << np.uint64(8 * k)
    return out


def pack_all(columns: list[np.ndarray]) -> bytes:
    """Columns of one length, packed and compressed together."""
    planes = b"".join([pack(c) for c in columns])
    return len(planes).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack_all(b: bytes, length: int) -> list[np.ndarray]:
    planes = pa.decompress(memoryview(b)[4:], int.from_bytes(b[:4], "little"), "zstd", asbytes=True)
    found, at = [], 0
    while at < len(planes):
        found.append(unpack(planes, length, at))
        at += 1 + planes[at] * length
    return found


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, where one of each stands, and the place of each key among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(keys) else np.zeros(0, bool)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], order[new], place


def discounts(n: list[float]) -> np.ndarray:
    """Katz's discount by count 0..K from the counts of counts n[1..K+1].

    Where the counts of counts give none between 0 and 1, as on tiny inputs, a
    count r keeps (r - 1/2) / r.
    """
    d = np.ones(K + 1)
    n = [float(x) for x in n]
    shared = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        found = ((r + 1) * n[r + 1] / (r * n[r]) - shared) / (1 - shared) if n[r] and shared != 1 else 0.0
        d[r] = found if 0 < found < 1 else (r - 0.5) / r
    return d


def kept(d: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Counts after the discount."""
    c = count.astype(np.int64)
    return d[np.where(c > K, 0, c)] * c


class Unigrams:
    """Discounted word probabilities over the training vocabulary and one unknown word."""

    def __init__(self, total: int, types: int, n: list[float]):
        self.total, self.types, self.d = total, types, discounts(n)
        lost = sum((1 - self.d[r]) * r * n[r] for r in range(1, K + 1))
        self.scale = max(total if lost > 0 else total + 1, 1)
        self.unknown = (lost if lost > 0 else 1.0) / self.scale if total else 1.0

    def __call__(self, count: np.ndarray) -> np.ndarray:
        return np.where(count == 0, self.unknown, kept(self.d, count) / self.scale)


CHUNKS = "chunk long, n_words long, n_tokens long, n_texts long, ids array<long>, train binary, sizes binary, tokens binary, vocabulary binary"


def chunk_documents(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, train) as chunks: token numbers in the chunk's vocabulary, sorted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in textnum.slices(batches, "text", CHUNK_BYTES):
            raw, offsets = textnum.string_buffer(batch.column(1))
            hashes, at = textnum.words(textnum.FOLD[raw], offsets)
            hashes = np.insert(hashes, at[1:], END)  # one end after each document's words
            train = np.asarray(batch.column(2).fill_null(False))
            vocabulary, tokens = np.unique(hashes, return_inverse=True)
            row = [[chunk], [len(vocabulary)], [len(tokens)], [int(train.sum())], [batch.column(0).to_pylist()], [train.tobytes()], [(np.diff(at) + 1).astype(np.uint32).tobytes()], [pack(tokens)], [vocabulary.tobytes()]]
            types = [*[pa.int64()] * 4, pa.list_(pa.int64()), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["chunk", "n_words", "n_tokens", "n_texts", "ids", "train", "sizes", "tokens", "vocabulary"])
            chunk += 1

    return docs.mapInArrow(run, CHUNKS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row after the other as Python values: a row is a few large arrays."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _by_owner(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each owner; the partition is sorted by owner and an owner's rows fit a task by construction."""
    for owner, own in groupby(_rows(batches), lambda r: r["owner"]):
        yield owner, list(own)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)


def _counts_of_counts(c: np.ndarray) -> list[float]:
    return [float((c == r).sum()) for r in range(1, K + 2)]


class Document:
    """Tokens of a chunk, from its row in the chunk table."""

    def __init__(self, r: dict):
        self.sizes = np.frombuffer(r["sizes"], np.uint32).astype(np.int64)
        self.train = np.frombuffer(r["train"], bool)
        self.tokens = unpack(r["tokens"], int(self.sizes.sum())).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def own_counts(self, ids: np.ndarray, n: int) -> np.ndarray:
        """How often each of n things occurs in the chunk's training texts."""
        return np.bincount(ids, np.repeat(self.train, self.sizes), n).astype(np.int64)


# --- words ---

_WORD_ASK = pa.schema([("owner", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])
_WORD_REPLY = pa.schema([("kind", pa.int32()), ("owner", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("numbers", pa.binary()), ("counts", pa.binary()), ("stats", pa.list_(pa.float64()))])


def ask_words(chunks: DataFrame, owners: int) -> DataFrame:
    """Number and training count of each word of each chunk (kind 1), and sums of the counts (kind 0).

    Numbers are ranks by count, so frequent words have short numbers.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            words, d = np.frombuffer(r["vocabulary"], np.uint64), Document(r)
            counts = d.own_counts(d.tokens, len(words))
            owner = ((words >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
            edge = np.searchsorted(owner, np.arange(owners + 1).astype(np.uint64))
            yield _batch([(k, r["chunk"], words[i:j].tobytes(), pack(counts[i:j])) for k, (i, j) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) if j > i], _WORD_ASK)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, rows in _by_owner(batches):
            asked = [np.frombuffer(r["words"], np.uint64) for r in rows]
            words, place = np.unique(np.concatenate(asked), return_inverse=True)
            total = np.bincount(place, np.concatenate([unpack(r["counts"], len(w)) for r, w in zip(rows, asked, strict=True)]), len(words)).astype(np.int64)
            rank = np.empty(len(words), np.uint64)
            rank[np.argsort(-total, kind="stable")] = np.arange(len(words), dtype=np.uint64)
            number = np.where(total > 0, rank * np.uint64(owners) + np.uint64(owner) + FIRST, NO_WORD)
            at = 0
            for r, own in zip(rows, asked, strict=True):
                here = place[at : at + len(own)]
                at += len(own)
                yield _batch([(1, owner, r["chunk"], len(own), pack(number[here]), pack(total[here]), None)], _WORD_REPLY)
            yield _batch([(0, owner, None, 0, None, None, [float(total.sum()), float((total > 0).sum()), *_counts_of_counts(total)])], _WORD_REPLY)

    asked = chunks.select("chunk", "vocabulary", "sizes", "train", "tokens").mapInArrow(ask, "owner int, chunk long, words binary, counts binary")
    reply = "kind int, owner int, chunk long, n int, numbers binary, counts binary, stats array<double>"
    return asked.repartition(owners, "owner").sortWithinPartitions("owner", "chunk").mapInArrow(answer, reply)


# --- n-grams ---


@dataclass
class Level:
    """The distinct n-grams of a chunk for one n, sorted by context and last word.

    ``keys`` and ``columns`` have one entry more: the n-gram of nothing but starts,
    which is a context only.
    """

    ids: np.ndarray  # n-gram of each token
    context: np.ndarray  # its place in the level below
    word: np.ndarray
    suffix: np.ndarray  # the n-gram without its first word, in the level below
    columns: list[np.ndarray]  # numbers of its words
    keys: np.ndarray  # hash of the numbers
    count: np.ndarray | None = None  # training count, once known
    asked: tuple[np.ndarray, np.ndarray] | None = None


def chained(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of rows of word numbers."""
    key = textnum.mix64(columns[0])
    for c in columns[1:]:
        key = textnum.mix64(key + textnum.mix64(c ^ _OTHER))
    return key


class Chunk(Document):
    """A chunk's n-grams, level by level. Its vocabulary is in the order of the words' numbers."""

    def __init__(self, r: dict, texts: int):
        super().__init__(r)
        words = sorted(r["words"], key=lambda x: x["owner"])  # owners hold ranges of hashes: the vocabulary's order
        number = np.concatenate([unpack(x["numbers"], x["n"]) for x in words])
        count = np.concatenate([unpack(x["counts"], x["n"]) for x in words]).astype(np.int64)
        order = np.argsort(number, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.texts, self.tokens = texts, place[self.tokens]
        column = np.append(number[order], START)
        none = np.zeros(0, np.int64)
        self.levels = [Level(self.tokens, none, none, none, [column], chained([column]), count[order])]

    def extend(self) -> Level:
        """The next level, its counts unknown."""
        last = self.levels[-1]
        n, v = len(last.count), len(self.levels[0].count)
        before = np.empty_like(last.ids)
        before[1:] = last.ids[:-1]
        before[self.starts] = n
        key, first, ids = distinct(before * v + self.tokens)
        context, word, suffix = key // v, key % v, last.ids[first]
        number = self.levels[0].columns[0]
        columns = [np.append(c[context], START) for c in last.columns] + [np.append(number[word], START)]
        level = Level(ids, context, word, suffix, columns, textnum.mix64(np.append(last.keys[context], last.keys[-1]) + textnum.mix64(columns[-1] ^ _OTHER)))
        self.levels.append(level)
        return level

    def context_count(self, k: int) -> np.ndarray:
        """Training tokens after the context of each n-gram of level k; where it is 0 there is nothing to ask."""
        return np.append(self.levels[k - 1].count, self.texts)[self.levels[k].context]

    def question(self, k: int, owners: int) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of level k that are asked for, by owner, and 2 * owner + whether the context is hot."""
        level, below = self.levels[k], self.levels[k - 1]
        if level.asked is not None:
            return level.asked
        count = self.context_count(k)
        asked = np.flatnonzero(count > 0)
        hot = count[asked] > HOT
        spread = below.keys[level.context[asked]] + np.where(hot, textnum.mix64(level.columns[-1][asked]), np.uint64(0))
        cell = (textnum.mix64(spread) % np.uint64(owners)).astype(np.int64) * 2 + hot
        order = np.argsort(cell.astype(np.uint16) if owners < 1 << 15 else cell, kind="stable")
        level.asked = asked[order], cell[order]
        return level.asked

    def learn(self, k: int, replies: list[dict], owners: int) -> None:
        """Counts of level k from the owners' answers."""
        order, _ = self.question(k, owners)
        level = self.levels[k]
        level.count = np.zeros(len(level.word), np.int64)
        if len(order):
            level.count[order] = np.concatenate([unpack(x["counts"], x["n"]) for x in sorted(replies, key=lambda x: x["cell"])])


def _edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    edge = _edges(x).tolist()
    return list(zip(edge, edge[1:] + [len(x)][: len(edge)], strict=True))


_ASK = pa.schema([("owner", pa.int32()), ("cell", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("question", pa.binary())])
_REPLY = pa.schema([
    ("kind", pa.int32()), ("cell", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("counts", pa.binary()), ("runs", pa.binary()), ("sums", pa.binary()),
    ("context", pa.int64()), ("stats", pa.list_(pa.float64())), ("table", pa.binary()),
])
REPLY = "kind int, cell int, chunk long, n int, counts binary, runs binary, sums binary, context long, stats array<double>, table binary"


def ask_grams(joined: DataFrame, order: int, texts: int, owners: int, below: np.ndarray, store: bool) -> DataFrame:
    """Counts the n-grams of one order; ``below`` has the discounts of the order below.

    Rows by kind: 1 a chunk's counts, in the order of its question, with the back-off
    sums of contexts that it needs; 2 sums of a hot context in one owner; 3 a hot
    context that a chunk needs; 0 counts of counts; 4, with store, the owner's part of
    the count table and of the back-off table. Back-off sums of a context are how many
    of its n-grams have each count up to K, and the discounted counts of their suffixes.
    """
    k = order - 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            c = Chunk(r, texts)
            for level in range(1, k):
                c.extend()
                c.learn(level, r[f"level{level}"] or [], owners)
            level = c.extend()
            own, lower = c.own_counts(level.ids, len(level.word)), c.levels[k - 1].count[level.suffix]
            question, cell = c.question(k, owners)
            values, own, lower = [x[question] for x in level.columns], own[question], lower[question]
            yield _batch([(int(cell[i] >> 1), int(cell[i]), r["chunk"], j - i, pack_all([x[i:j] for x in (*values, own, lower)])) for i, j in _runs(cell)], _ASK)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, rows in _by_owner(batches):
            sizes = np.asarray([r["n"] for r in rows])
            *columns, own_count, lower = (np.concatenate(c) for c in zip(*[unpack_all(r.pop("question"), r["n"]) for r in rows], strict=True))
            context = chained(columns[:-1])
            _, first, place = distinct(textnum.mix64(context + textnum.mix64(columns[-1] ^ _OTHER)))
            total, lower = np.bincount(place, own_count).astype(np.int64), lower[first]
            contexts, _, context_of = distinct(context[first])
            seen = total > 0
            sums = np.stack([np.bincount(context_of, total == c, len(contexts)) for c in range(1, K + 1)] + [np.bincount(context_of, np.where(seen, kept(below, lower), 0.0), len(contexts))], 1)
            bare = sums[:, :K].sum(1) == 0
            hot_here: list[np.ndarray] = []
            out: list[tuple] = []
            for r, i, j in zip(rows, (np.cumsum(sizes) - sizes).tolist(), np.cumsum(sizes).tolist(), strict=True):
                here, mine = place[i:j], context[i:j]
                counts, own = total[here], context_of[here]
                run = _edges(mine)
                need = np.logical_or.reduceat((counts == 0) | bare[own], run)  # contexts before something unseen, or without a discounted n-gram
                which = own[run[need]]
                if r["cell"] & 1:
                    hot_here.append(own[run])
                    out.append((1, r["cell"], r["chunk"], j - i, pack(counts), None, None, None, None, None))
                    out += [(3, r["cell"], r["chunk"], 0, None, None, None, x, None, None) for x in contexts[which].view(np.int64).tolist()]
                else:
                    out.append((1, r["cell"], r["chunk"], j - i, pack(counts), pack(np.flatnonzero(need)), sums[which].T.tobytes(), None, None, None))
                if len(out) > 100:
                    yield _batch(out, _REPLY)
                    out = []
            yield _batch(out, _REPLY)
            if hot_here:
                these = np.unique(np.concatenate(hot_here))
                yield _batch([(2, owner * 2 + 1, None, 0, None, None, None, x, s, None) for x, s in zip(contexts[these].view(np.int64).tolist(), sums[these].tolist(), strict=True)], _REPLY)
            yield _batch([(0, owner * 2, None, 0, None, None, None, None, _counts_of_counts(total), None)], _REPLY)
            if store:
                found = first[seen]
                found = found[np.lexsort([c[found] for c in reversed(columns)])]
                lower_of = lower[place[found]]
                yield _batch([(4, owner * 2, None, len(found), None, None, None, None, None, pack_all([*[c[found] for c in columns], total[place[found]], lower_of]))], _REPLY)

    asked = joined.mapInArrow(ask, "owner int, cell int, chunk long, n int, question binary")
    return asked.repartition(owners, "owner").sortWithinPartitions("owner", "chunk", "cell").mapInArrow(answer, REPLY)


def evaluate(joined: DataFrame, order: int, texts: int, owners: int, unigrams: Unigrams, d: dict[int, np.ndarray]) -> DataFrame:
    """Scores every document of every chunk from the answers, recursively from the shortest context to the longest."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def probabilities(c: Chunk, k: int, r: dict) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each n-gram's last word after its context, and what the context's counts are divided by."""
        if k == 0:
            return unigrams(c.levels[0].count), np.full(len(c.levels[0].count), float(unigrams.scale))
        lower, lower_scale = probabilities(c, k - 1, r)
        level, after = c.levels[k], c.context_count(k)
        question, cell = c.question(k, owners)
        sums = np.zeros((len(c.levels[k - 1].keys), K + 1))  # by context
        known = np.zeros(len(sums), bool)
        replies = sorted(r[f"level{k}"] or [], key=lambda x: x["cell"])
        for x, (i, j) in zip(replies, _runs(cell), strict=True):
            if x["runs"] is not None:
                q = level.context[question[i:j]]
                found = np.frombuffer(x["sums"], np.float64).reshape(K + 1, -1).T
                own = q[_edges(q)][unpack(x["runs"], len(found)).astype(np.int64)]
                sums[own], known[own] = found, True
        if r[f"hot{k}"]:
            by_key = {np.int64(x["context"]).view(np.uint64): x["stats"] for x in r[f"hot{k}"]}
            keys = np.asarray(list(by_key), np.uint64)
            for own in np.flatnonzero(np.isin(c.levels[k - 1].keys, keys)).tolist():
                sums[own], known[own] = by_key[c.levels[k - 1].keys[own]], True
        lost = (sums[:, :K] * ((1 - d[k + 1][1:]) * np.arange(1, K + 1))).sum(1)
        bare = known & (lost <= 0)  # such a context keeps back one count for unseen words
        scale = after + bare[level.context].astype(float)
        share = np.where(lost > 0, lost, 1.0)[level.context] / np.maximum(scale, 1)
        left = share / np.maximum(1 - sums[level.context, K] / lower_scale[level.suffix], 1e-300)
        p = np.where(level.count > 0, kept(d[k + 1], level.count) / np.maximum(scale, 1), np.where(after > 0, left, 1.0) * lower[level.suffix])
        return p, np.maximum(scale, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            c = Chunk(r, texts)
            for k in range(1, order):
                c.extend()
                c.learn(k, r[f"level{k}"] or [], owners)
            p, _ = probabilities(c, order - 1, r)
            score = np.add.reduceat(np.log10(np.maximum(p, 1e-300))[c.levels[-1].ids], c.starts)
            counts = c.levels[0].count[c.tokens]
            base = np.add.reduceat(np.log10((counts + 1.0) / (unigrams.total + unigrams.types + 1.0)), c.starts)
            known = np.add.reduceat((counts > 0).astype(np.int64), c.starts)
            out = [pa.array(r["ids"], pa.int64()), pa.array(~c.train), pa.array(c.sizes), pa.array(known), pa.array(np.full(len(score), unigrams.total)), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(out, names)

    return joined.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _summed(replies: DataFrame, n: int) -> list[float]:
    """Sums of the owners' statistics rows."""
    row = replies.where("kind = 0").agg(*[F.coalesce(F.sum(F.col("stats")[k]), F.lit(0.0)).alias(f"s{k}") for k in range(n)]).first()
    return list(row)


def _with_level(joined: DataFrame, replies: DataFrame, k: int, sums: bool) -> DataFrame:
    """Chunks with the answers for level k; with sums also what back-off needs."""
    fields = ["cell", "n", "counts", *(["runs", "sums"] if sums else [])]
    own = replies.where("kind = 1").groupBy("chunk").agg(F.collect_list(F.struct(*fields)).alias(f"level{k}"))
    joined = joined.join(own, "chunk", "left")
    if sums:
        total = replies.where("kind = 2").groupBy("context").agg(F.array(*[F.sum(F.col("stats")[i]) for i in range(K + 1)]).alias("stats"))
        need = replies.where("kind = 3").select("chunk", "context").distinct().join(total, "context")
        joined = joined.join(need.groupBy("chunk").agg(F.collect_list(F.struct("context", "stats")).alias(f"hot{k}")), "chunk", "left")
    return joined


@dataclass
class Tables:
    """The written tables of a corpus: chunks, and for each order what its owners answered and its discounts."""

    order: int
    chunks: DataFrame
    words: DataFrame
    replies: dict[int, DataFrame]
    unigrams: Unigrams
    d: dict[int, np.ndarray]
    scores: DataFrame

    def discard(self) -> None:
        discard(self.chunks, self.words, *self.replies.values())


def gather(docs: DataFrame, order: int = ORDER, store: bool = True) -> Tables:
    """Counts all orders, scores all documents and returns the tables; without store, count tables are not kept beside the answers."""
    rows = slim(docs, "doc_id", "text").select("doc_id", "text", (~held_out("doc_id", 7, 2)).alias("train"))
    chunks = cut_by(chunk_documents(rows), "chunk", "chunks")
    size = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_tokens", "n_texts")]).first()
    texts, owners = int(size.n_texts), max(4, int(size.n_tokens // GRAMS_PER_OWNER) + 1)
    with settings(docs.sparkSession, FEW_ROWS):
        words = cut(ask_words(chunks, max(4, int(size.n_words // WORDS_PER_OWNER) + 1)), "words", "zstd")
        total, types, *n = _summed(words, 2 + K + 1)
        unigrams = Unigrams(int(total), int(types), [0, *n])
        d, replies = {1: unigrams.d}, {}
        answers = words.where("kind = 1").groupBy("chunk").agg(F.collect_list(F.struct("owner", "n", "numbers", "counts")).alias("words"))
        joined = chunks.drop("vocabulary").join(answers, "chunk")
        for k in range(1, order):
            asked = joined.drop("ids")
            for lower in range(1, k):
                asked = _with_level(asked, replies[lower], lower, False)
            replies[k] = cut(ask_grams(asked, k + 1, texts, owners, d[k], store), f"grams-{k + 1}", "zstd")
            d[k + 1] = discounts([0, *_summed(replies[k], K + 1)])
        for k in range(1, order):
            joined = _with_level(joined, replies[k], k, True)
        scores = cut(evaluate(joined, order, texts, owners, unigrams, d), "scores")
    return Tables(order, chunks, words, replies, unigrams, d, scores)


def count_table(tables: Tables, k: int) -> DataFrame:
    """The count table of an order over 1: context (hash), word (its number), count, and lower, the count of the n-gram's suffix."""
    order = k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            columns = unpack_all(r["table"], r["n"])
            values = (chained(columns[: order - 1]), *columns[order - 1 :])
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in values], ["context", "word", "count", "lower"])

    return tables.replies[k - 1].where("kind = 4").select("n", "table").mapInArrow(run, "context long, word long, count long, lower long")


def backoff_table(tables: Tables, k: int) -> DataFrame:
    """The back-off table of an order over 1: context (hash), the count that discounts take from its n-grams, and the discounted counts of their suffixes."""
    kept_of = lambda c, d: F.element_at(F.array(*[F.lit(float(x)) for x in d]), F.when(F.col(c) > K, 0).otherwise(F.col(c)).cast("int") + 1) * F.col(c)
    rows = count_table(tables, k)
    return rows.groupBy("context").agg(F.sum(F.col("count") - kept_of("count", tables.d[k])).alias("lost"), F.sum(kept_of("lower", tables.d[k - 1])).alias("lower"))


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores every whole text, learning from those outside the held-out fold.

    Null and empty texts are the end token alone. A null doc_id is held out. Repeated
    rows count and are scored each. An empty table gives no rows; with no training
    text every token is unknown and every score 0 (base scores are log10(1 / 1)). Extra
    columns are not read. A document is never cut: one of over CHUNK_BYTES is a chunk of
    its own.
    """
    tables = gather(docs, order, store=False)
    tables.discard()
    return tables.scores


def op10_katz(spark, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


def brute_force(texts: list[tuple[int, str | None, bool]], order: int = ORDER) -> tuple[list[tuple[int, bool, int, int, int, float, float]], object]:
    """The same scores by plain dictionaries and recursion, and the probability itself, for tests on small tables."""
    import math
    import re
    from collections import Counter, defaultdict

    fold_case = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(i, [w for w in re.split(r"[ \t-\r]+", (t or "").translate(fold_case)) if w] + [None], train) for i, t, train in texts]
    count = {n: Counter() for n in range(1, order + 1)}
    for _, words, train in docs:
        padded = [0] * (order - 1) + words
        for k in range(len(words) if train else 0):
            for n in count:
                count[n][tuple(padded[k + order - n : k + order])] += 1
    after = {n: defaultdict(list) for n in count}
    for n in count:
        for gram, c in count[n].items():
            after[n][gram[:-1]].append((gram[-1], c))
    d = {n: discounts([0.0, *[float(sum(v == r for v in count[n].values())) for r in range(1, K + 2)]]) for n in count}
    total, types = sum(count[1].values()), len(count[1])
    model = Unigrams(total, types, [0.0, *[float(sum(v == r for v in count[1].values())) for r in range(1, K + 2)]])
    left: dict = {}

    def p(history: tuple, w) -> float:
        if not history:
            return float(model(np.asarray([count[1][w,]]))[0])
        n = len(history) + 1
        own = after[n].get(history)
        if own is None:
            return p(history[1:], w)
        if history not in left:
            lost = sum((1 - d[n][c]) * c for _, c in own if c <= K)
            scale = sum(c for _, c in own) + (0 if lost > 0 else 1)
            left[history] = scale, (lost if lost > 0 else 1) / scale / (1 - sum(p(history[1:], x) for x, _ in own))
        scale, alpha = left[history]
        c = count[n][(*history, w)]
        return (d[n][c] if c <= K else 1) * c / scale if c else alpha * p(history[1:], w)

    out = []
    for i, words, train in docs:
        padded = [0] * (order - 1) + words
        score = sum(math.log10(p(tuple(padded[k : k + order - 1]), w)) for k, w in enumerate(words))
        base = sum(math.log10((count[1][w,] + 1) / (total + types + 1)) for w in words)
        out.append((i, not train, len(words), sum(count[1][w,] > 0 for w in words), total, base, score))
    return out, (p, count)
