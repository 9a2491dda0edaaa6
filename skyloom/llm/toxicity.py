"""Toxicity: a convolutional text classifier trained and run in numpy.

Words and their beginnings are hashed into embedding tables whose rows are added, filters of one,
two and three words slide over the text, each filter keeps its maximum and a
logistic layer scores the maxima. Only positions of maxima carry gradients, so
training touches few rows. The network learns from every labelled document: they are dealt
over shards, a task trains the common network on a shard, and the networks of all shards are
averaged, ROUNDS times. Only averaged networks, of a fixed size, come to the driver.
In each step only a part of a document's words is there, so what one word tells isn't
learned by heart from another. A threshold is calibrated for each language on all labelled documents, each fold scored
by a network that the others trained, and the logit is shifted by it, so one half is the calibrated threshold
everywhere. At scoring time the language is told from the text alone, by sums of
hashed-word log odds; the lang column is never read.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import textnum
from skyloom.llm.common import cut, discard, documents, fold, held_out, slim, table

BUCKET_BITS, DIM, WIDTHS, FILTERS = 15, 8, (1, 2, 3), 8
SAMPLE_DOCS, SAMPLE_BYTES, LONGEST = 6000, 24 << 20, 1 << 20  # of sample(), for trials; fit() learns from all
SHARD_DOCS, SHARD_BYTES, ROUNDS = 8000, 24 << 20, 2  # documents that one task learns from, and how often the tasks' networks are averaged
GRID, EDGE = 64, 40  # logits set thresholds in steps of 1 / GRID up to EDGE, so their counts are of a fixed size
BROADCAST_LABELS = 200_000  # more labels than these are joined by a shuffle
BLOCK = 1 << 14  # values of a network that are averaged together
FOLDS = 3  # of the labelled documents: each sets thresholds by a network that the others trained
STEPS, BATCH, RATE, SEED = 300, 64, 0.08, 20240  # steps of gradients, however many documents there are
LANG_BITS = 12
SLICE_BYTES = 1 << 19  # of text scored at once: some forty times as much in arrays
PREFIXES = (4, 6)  # bytes of a word's beginnings
KEEP = 0.5  # of the words of a document in each step: what only one word tells must not be learned by heart from another


def word_ids(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word (a run of letters, ASCII case folded) the 32-bit hashes of the word
    and of its beginnings, and word offsets by document."""
    raw = textnum.FOLD[raw]
    starts, ends = textnum.runs(textnum.LETTER[raw], offsets)
    parts = [ends, *[np.minimum(ends, starts + k) for k in PREFIXES]]
    ids = np.stack([(textnum.run_hashes(raw, starts, e) >> np.uint64(32)).astype(np.uint32) for e in parts], 1)
    return ids, np.searchsorted(starts, offsets)


def _rows(ids: np.ndarray) -> list[np.ndarray]:
    """The embedding rows of each word: two of the word itself, one of each beginning."""
    mask = (1 << BUCKET_BITS) - 1
    whole = ids[:, 0]
    found = [(whole & mask).astype(np.int64), (whole >> (32 - BUCKET_BITS)).astype(np.int64) + (1 << BUCKET_BITS)]
    return found + [(ids[:, k] & mask).astype(np.int64) + ((1 + k) << BUCKET_BITS) for k in range(1, ids.shape[1])]


@dataclass
class Network:
    embedding: np.ndarray  # the tables one after the other
    filters: list[np.ndarray]  # by width: (width, dim, filters)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    languages: list[str]
    odds: np.ndarray  # (2 ** LANG_BITS, languages) log odds of a hashed word
    shift: np.ndarray  # by language: threshold logit

    def pooled(self, ids: np.ndarray, at: np.ndarray, want_argmax: bool = False):
        """Maximum of each filter over each document (ReLU applied), and where it is."""
        n, counts = len(at) - 1, np.diff(at)
        full = np.flatnonzero(counts > 0)
        result = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        where = np.zeros((n, len(WIDTHS) * FILTERS), np.int64) if want_argmax else None
        if len(full) == 0:
            return result, where
        _, first_at, inverse = np.unique(ids[:, 0], return_index=True, return_inverse=True)
        vectors = sum(self.embedding[r] for r in _rows(ids[first_at]))
        left = np.repeat(at[1:], counts) - np.arange(len(ids))
        for k, w in enumerate(WIDTHS):
            total = np.zeros((len(ids), FILTERS), np.float32)
            for j in range(w):
                part = (vectors @ self.filters[k][j])[inverse]
                if j:
                    part = np.concatenate([part[j:], np.zeros((j, FILTERS), np.float32)])
                    part[left <= j] = 0
                total += part
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            top = np.maximum.reduceat(total, at[:-1][full], axis=0)
            result[full, own] = np.maximum(top + self.bias[k], 0)
            if want_argmax:
                hit = total == np.repeat(top, counts[full], axis=0)
                for f in range(FILTERS):
                    pos = np.flatnonzero(hit[:, f])
                    doc = np.searchsorted(at, pos, side="right") - 1
                    first = np.r_[True, doc[1:] != doc[:-1]]
                    where[doc[first], k * FILTERS + f] = pos[first]
        return result, where

    def language(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Index of the likeliest language of each document, from its words."""
        if not len(ids) or len(self.languages) < 2:
            return np.zeros(len(at) - 1, np.int64)
        total = np.concatenate([np.zeros((1, len(self.languages)), np.float32), np.cumsum(self.odds[ids[:, 0] >> np.uint32(32 - LANG_BITS)], 0, dtype=np.float64)])
        return np.argmax(total[at[1:]] - total[at[:-1]], 1)

    def logits(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.pooled(ids, at)[0] @ self.out + self.out_bias

    def score(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = self.logits(ids, at) - self.shift[self.language(ids, at)]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def gradients(net: Network, ids: np.ndarray, at: np.ndarray, x: np.ndarray, where: np.ndarray, g: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Gradients of filters, biases and embedding rows (rows, their gradients) from the logits' gradient g."""
    dx = np.outer(g, net.out) * (x > 0)
    rows_of = _rows(ids)
    d_filters, d_bias, touched, grads = [], [], [np.zeros(0, np.int64)], [np.zeros((0, DIM), np.float32)]
    for k, w in enumerate(WIDTHS):
        own_cols = slice(k * FILTERS, (k + 1) * FILTERS)
        dk, pos = dx[:, own_cols], where[:, own_cols]
        d_f = np.zeros_like(net.filters[k])
        for j in range(w):
            at_j = pos + j
            doc, f = np.nonzero((dk != 0) & (at_j < at[1:, None]))
            if not len(doc):
                continue
            p, gr = at_j[doc, f], dk[doc, f]
            vec = sum(net.embedding[r[p]] for r in rows_of)
            np.add.at(d_f[j].T, f, vec * gr[:, None])
            ge = net.filters[k][j].T[f] * gr[:, None]
            touched += [r[p] for r in rows_of]
            grads += [ge] * len(rows_of)
        d_filters.append(d_f)
        d_bias.append(dk.sum(0))
    rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
    total = np.zeros((len(rows), DIM), np.float32)
    np.add.at(total, inverse, np.concatenate(grads))
    return d_filters, d_bias, rows, total


def train(docs: list[np.ndarray], labels: np.ndarray, langs: list[str | None]) -> Network:
    """Fits the network on all documents, and thresholds on logits that networks of the other folds give each fold.

    So every document sets thresholds and none by a network that learned from it, at every size.
    """
    net = _fit(docs, labels, langs)
    if len(docs) == 0 or labels.min() == labels.max():
        return net
    z, lang, fold_of = np.zeros(len(docs)), np.zeros(len(docs), np.int64), np.arange(len(docs)) % FOLDS
    for k in range(FOLDS):
        rest, own = np.flatnonzero(fold_of != k), np.flatnonzero(fold_of == k)
        other = _fit([docs[i] for i in rest], labels[rest], [langs[i] for i in rest])
        for lo in range(0, len(own), 256):
            part = own[lo : lo + 256]
            ids, at = np.concatenate([docs[i] for i in part]), np.concatenate([[0], np.cumsum([len(docs[i]) for i in part])])
            z[part], lang[part] = other.logits(ids, at), net.language(ids, at)
    net.shift[:] = thresholds(z, lang, labels, len(net.languages))
    return net


def _initial(rng: np.random.Generator, names: list[str]) -> Network:
    return Network(
        (rng.standard_normal(((2 + len(PREFIXES)) << BUCKET_BITS, DIM)) * 0.05).astype(np.float32),
        [(rng.standard_normal((w, DIM, FILTERS)) * 0.5).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.5).astype(np.float32),
        -1.0, names, np.zeros((1 << LANG_BITS, len(names)), np.float32), np.zeros(len(names)),
    )


def _start(names: list[str]) -> Network:
    """The network that training begins with."""
    return _initial(np.random.default_rng(SEED), names)


def _fit(docs: list[np.ndarray], labels: np.ndarray, langs: list[str | None], start: Network | None = None, steps: int = STEPS) -> Network:
    """Fits from the beginning, or goes on from a network that other shards share."""
    rng = np.random.default_rng(SEED)
    net = _initial(rng, sorted({x for x in langs if x is not None}) or [""]) if start is None else Network(**{k: [a.copy() for a in v] if k in ("filters", "bias") else v.copy() if isinstance(v, np.ndarray) else v for k, v in vars(start).items()})
    names = net.languages
    if len(docs) == 0 or labels.min() == labels.max():
        if start is not None:
            return net
        net.out[:] = 0
        net.out_bias = 0.0 if len(docs) == 0 else (4.0 if labels[0] else -4.0)
        return net
    sizes = np.asarray([len(d) for d in docs])
    positive = max(1, int(labels.sum()))
    weight = np.where(labels == 1, min(4.0, (len(labels) - positive) / positive), 1.0)
    past_e = np.full((len(net.embedding), 1), 1e-2, np.float32)
    past_f = [np.full_like(f, 1e-2) for f in net.filters]
    past_b = [np.full_like(b, 1e-2) for b in net.bias]
    past_o, past_ob = np.full_like(net.out, 1e-2), 1e-2
    done = 0
    while done < steps:
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), BATCH):
            own = order[lo : lo + BATCH]
            done += 1
            ids = np.concatenate([docs[i] for i in own]) if sizes[own].sum() else np.zeros((0, 1 + len(PREFIXES)), np.uint32)
            stays = rng.random(len(ids)) < KEEP
            ids, at = ids[stays], np.concatenate([[0], np.cumsum(stays)])[np.concatenate([[0], np.cumsum(sizes[own])])]
            x, where = net.pooled(ids, at, True)
            z = x @ net.out + net.out_bias
            g = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[own]) * weight[own] / len(own)).astype(np.float32)
            d_out, d_ob = x.T @ g + 1e-4 * net.out, float(g.sum())
            d_filters, d_bias, rows, total = gradients(net, ids, at, x, where, g)
            for k in range(len(WIDTHS)):
                past_f[k] += d_filters[k] ** 2
                net.filters[k] -= RATE * d_filters[k] / np.sqrt(past_f[k])
                past_b[k] += d_bias[k] ** 2
                net.bias[k] -= RATE * d_bias[k] / np.sqrt(past_b[k])
            past_e[rows] += (total**2).sum(1, keepdims=True)
            net.embedding[rows] -= RATE * total / np.sqrt(past_e[rows])
            past_o += d_out**2
            past_ob += d_ob**2
            net.out -= RATE * d_out / np.sqrt(past_o)
            net.out_bias -= RATE * d_ob / np.sqrt(past_ob)
    counts = np.full((len(names), 1 << LANG_BITS), 0.5)
    for d, lang in zip(docs, langs, strict=True):
        if lang is not None:
            counts[names.index(lang)] += np.bincount(d[:, 0] >> np.uint32(32 - LANG_BITS), minlength=1 << LANG_BITS)
    logs = np.log(counts / counts.sum(1, keepdims=True))
    net.odds = (logs - logs.mean(0)).T.astype(np.float32)
    return net


def thresholds(z: np.ndarray, lang: np.ndarray, labels: np.ndarray, languages: int, weight: np.ndarray | None = None) -> np.ndarray:
    """For each language the middle of the cuts with the fewest errors among its logits.

    A language with fewer than 20 documents of either class takes the cut of all documents.
    A weight is a number of documents that share a logit.
    """
    weight = np.ones(len(z), np.int64) if weight is None else weight

    def best(own: np.ndarray) -> float:
        order = np.argsort(z[own])
        zs, ys, ws = z[own][order], labels[own][order], weight[own][order]
        # errors when everything from position k on is called toxic
        errors = np.concatenate([[0], np.cumsum((ys == 1) * ws)]) + np.concatenate([np.cumsum(((ys == 0) * ws)[::-1])[::-1], [0]])
        cuts = np.concatenate([[zs[0] - 1], (zs[1:] + zs[:-1]) / 2, [zs[-1] + 1]])
        good = errors == errors.min()
        return float(np.median(cuts[good]))

    overall, out = best(np.ones(len(z), bool)), np.zeros(languages)
    for k in range(languages):
        own = lang == k
        enough = own.any() and min(weight[own & (labels == 1)].sum(), weight[own & (labels == 0)].sum()) >= 20
        out[k] = best(own) if enough else overall
    return out


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Text, label, lang and doc_id of all labelled documents outside the held-out fold, however long."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where(F.col("label").isin(0, 1) & (fold("doc_id", 5) != 0)).distinct()
    few = marks.count() <= BROADCAST_LABELS
    return slim(docs, "doc_id", "text", "lang").join(F.broadcast(marks) if few else marks, "doc_id").select("text", "label", "lang", "doc_id")


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Text, label, lang and doc_id of labelled documents outside the held-out fold.

    Both classes are sampled at their own rate, by a hash of the id, half of ``most``
    rows and of ``most_bytes`` each in expectation; a class with less is taken whole.
    """
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where(F.col("label").isin(0, 1) & (fold("doc_id", 5) != 0)).distinct()
    rows = slim(docs, "doc_id", "text", "lang").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST)
    sizes = rows.select("doc_id", F.octet_length("text").alias("size")).join(marks, "doc_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).collect()
    chance = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) / float(1 << 20)
    keep = F.lit(False)
    for r in sizes:  # a row a class
        keep = keep | ((F.col("label") == r.label) & (chance < min(most / 2 / r.n, most_bytes / 2 / max(r.bytes, 1))))
    marks = marks.where(keep)
    few = marks.count() <= 100_000
    return rows.join(F.broadcast(marks) if few else marks, "doc_id").select("text", "label", "lang", "doc_id")


def _flat(net: Network) -> np.ndarray:
    return np.concatenate([a.ravel() for a in [net.embedding, *net.filters, *net.bias, net.out, np.asarray([net.out_bias])]]).astype(np.float32)


def _shaped(values: np.ndarray, names: list[str], odds: np.ndarray) -> Network:
    sizes = [((2 + len(PREFIXES)) << BUCKET_BITS, DIM), *[(w, DIM, FILTERS) for w in WIDTHS], *[(FILTERS,)] * len(WIDTHS), (len(WIDTHS) * FILTERS,)]
    *parts, last = np.split(values, np.cumsum([np.prod(x) for x in sizes]))
    e, *rest = (x.reshape(shape) for x, shape in zip(parts, sizes, strict=True))
    return Network(e, rest[: len(WIDTHS)], rest[len(WIDTHS) : -1], rest[-1], float(last[0]), names, odds, np.zeros(len(names)))


def _read(batches: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], np.ndarray, list[str | None]]:
    """Words, labels and languages of a shard's documents, in an order that doesn't depend on that of the rows."""
    found = []
    for batch in textnum.slices(batches, "text"):
        ids, at = word_ids(*textnum.string_buffer(batch.column(0)))
        found += [(i, ids[a:b].tobytes(), y, lang or "") for i, a, b, y, lang in zip(batch.column(3).to_pylist(), at[:-1].tolist(), at[1:].tolist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
    found.sort()
    return [np.frombuffer(r[1], np.uint32).reshape(-1, 1 + len(PREFIXES)) for r in found], np.asarray([r[2] for r in found], np.int64), [r[3] or None for r in found]


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task's blocks by network and place, so that a task sends a network once, however many shards it had."""
    total: dict[tuple[int, int], list] = {}
    for batch in batches:
        for k, b, n, v in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            own = total.setdefault((k, b), [0, 0.0])
            own[0] += n
            own[1] = own[1] + np.frombuffer(v, np.float32).astype(np.float64)
    for (k, b), (n, values) in total.items():
        yield _block(k, b, n, values)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Fold and documents (text, label, lang, doc_id) of each shard in rows sorted by shard."""
    now, own = None, []
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        ends = [*(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)] if len(shard) else []
        for a, b in zip([0, *ends], ends, strict=False):
            if shard[a] != now and own:
                yield fold_of, own
                own = []
            now, fold_of = shard[a], batch.column("fold")[a].as_py()
            own.append(batch.slice(a, b - a).select(["text", "label", "lang", "doc_id"]))
    if own:
        yield fold_of, own


def _changes(rows: DataFrame, names: list[str], shared) -> DataFrame:
    """The changes that a task's shards make to the networks, in blocks; shared has the networks before, or is None in the first round.

    One Python function trains and adds up, so that a task has one worker: an executor keeps the idle
    ones for a minute, beside the memory of the stage that follows.
    """

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold_of, own in _shards(batches):
            words, y, lang = _read(own)
            odds = np.zeros((1 << LANG_BITS, len(names)), np.float32)
            for k in [j for j in range(1 + FOLDS) if j != 1 + fold_of] if shared else [fold_of]:
                values = shared.value[k] if shared else _flat(_start(names))
                change = (_flat(_fit(words, y, lang, _shaped(values, names, odds), STEPS // ROUNDS)) - values) * len(y)
                yield from (_block(k, b, len(y), change[b : b + BLOCK]) for b in range(0, len(change), BLOCK))
            if not shared:  # as network -1
                counts = np.zeros((len(names), 1 << LANG_BITS))
                for d, x in zip(words, lang, strict=True):
                    if x is not None:
                        counts[names.index(x)] += np.bincount(d[:, 0] >> np.uint32(32 - LANG_BITS), minlength=1 << LANG_BITS)
                yield from (_block(-1, b, 1, counts.ravel()[b : b + BLOCK]) for b in range(0, counts.size, BLOCK))

    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(lambda batches: _added(go_on(batches)), BLOCKS)


BLOCKS = "k int, b int, n long, values binary"


def _averaged(rows: DataFrame, names: list[str], before: list[np.ndarray] | None) -> tuple[list[np.ndarray], np.ndarray]:
    """One round of all shards; the common network and those that leave a fold out, and in the first round the words by language.

    rows have fold and shard. In the first round a shard trains once, as all networks begin alike;
    later it goes on from the common network and from each that leaves another fold out. Only the
    changes are sent, in blocks, and networks come to the driver one after the other.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(before) if before else None

    def mean(key, parts):
        n, total = sum(parts.column("n").to_pylist()), sum(np.frombuffer(v.as_py(), np.float32).astype(np.float64) for v in parts.column("values"))
        return pa.Table.from_batches([_block(key[0].as_py(), key[1].as_py(), n, total if key[0].as_py() < 0 else total / n)])

    blocks = cut(_changes(rows, names, shared).groupBy("k", "b").applyInArrow(mean, BLOCKS), "networks")

    def whole(k: int) -> tuple[np.ndarray, int]:
        found = sorted(blocks.where(F.col("k") == k).collect(), key=lambda r: r.b)  # one network or the words by language, of a fixed size
        return (np.concatenate([np.frombuffer(r["values"], np.float32) for r in found]), found[0].n) if found else (np.zeros(1, np.float32), 0)

    if shared:
        nets, counts = [x + whole(k)[0] for k, x in enumerate(before)], np.zeros(0)
        shared.destroy()
    else:
        changes, n = zip(*[whole(k) for k in range(FOLDS)], strict=True)
        start, counts = _flat(_start(names)), whole(-1)[0]
        nets = [start + sum(np.float32(n[j] / max(1, sum(n) - (n[k] if k >= 0 else 0))) * x for j, x in enumerate(changes) if j != k) for k in range(-1, FOLDS)]
    discard(blocks)
    return nets, counts


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """Learns from all labelled documents; without labelled rows of both classes every score is constant.

    The documents lie in shards by a hash of their id, and every shard belongs to a fold. In a round
    every shard goes on from the common networks, the one of all folds and those that leave another
    fold out, and blocks of their weights are averaged by a shuffle; more shards are more tasks
    and no more work for any of them. Then each document gets the logit of the network that
    didn't learn its fold, and the counts of logits set the thresholds. One shard alone
    trains in one task, as train() does.
    """
    spark = docs.sparkSession
    rows = cut(labelled(docs, slim(labels, "doc_id", "toxic")), "labelled", "zstd")
    found = rows.groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).collect()  # a row a language and class
    n, size, names = sum(r.n for r in found), sum(r.bytes for r in found), sorted({r.lang for r in found} - {None}) or [""]
    shards = max(1, -(-n // SHARD_DOCS), -(-size // SHARD_BYTES))
    if shards == 1 or len({r.label for r in found}) < 2:

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(train(*_read(batches))))], pa.binary())], ["net"])

        one = rows.repartition(1).mapInArrow(alone, "net binary").first() if shards == 1 else None
        discard(rows)
        if shards > 1:  # one class: every score is the same, whatever the texts
            return train([np.zeros((0, 1 + len(PREFIXES)), np.uint32)], np.asarray([found[0].label]), [names[0]])
        return Network(**pickle.loads(one.net)) if one else train([], np.zeros(0, np.int64), [])

    shards = -(-shards // FOLDS) * FOLDS
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(shards)).cast("int")).withColumn("fold", F.col("shard") % FOLDS)
    nets, counts = _averaged(dealt, names, None)
    for _ in range(1, ROUNDS):
        nets, _ = _averaged(dealt, names, nets)
    logs = np.log(counts.reshape(len(names), -1).astype(np.float64) + 0.5)
    logs -= np.log(np.exp(logs).sum(1, keepdims=True))
    odds = (logs - logs.mean(0)).T.astype(np.float32)
    shared = spark.sparkContext.broadcast(nets[1:])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [_shaped(x, names, odds) for x in shared.value]
        for batch in textnum.slices(batches, "text", SLICE_BYTES):
            ids, at = word_ids(*textnum.string_buffer(batch.column(0)))
            z = np.choose(batch.column(2).to_numpy(zero_copy_only=False), [x.logits(ids, at) for x in own])
            z = np.rint(np.clip(z, -EDGE, EDGE) * GRID).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(own[0].language(ids, at).astype(np.int32)), batch.column(1).cast(pa.int32()), pa.array(z)], ["lang", "label", "z"])

    logits = slim(dealt, "text", "label", "fold").mapInArrow(judged, "lang int, label int, z int").groupBy("lang", "label", "z").agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most 2 * EDGE * GRID a language and class
    shared.destroy()
    discard(rows)
    lang, y, z, w = (c.to_numpy() for c in logits.columns)
    net = _shaped(nets[0], names, odds)
    net.shift[:] = thresholds(z / GRID, lang, y, len(names), w)
    return net


def _block(k: int, b: int, n: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b], pa.int32()), pa.array([n], pa.int64()), pa.array([values.astype(np.float32).tobytes()], pa.binary())], ["k", "b", "n", "values"])


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; only the text is an input.

    Null, empty and letterless texts get the score of a text without words; repeated
    rows are scored each, alike; a row without an id is scored, never trained on and
    counts as held out; an empty table gives no rows; extra columns are not read; texts
    are scored whole, however long.
    """
    model = docs.sparkSession.sparkContext.broadcast(vars(net))  # size fixed by the constants above, about 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(**model.value)
        for batch in textnum.slices(batches, "text", SLICE_BYTES):
            s = own.score(*word_ids(*textnum.string_buffer(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = slim(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def score_column(spark, net: Network, text: str = "text"):
    """The score as a column, for filters that keep all other columns."""
    model = spark.sparkContext.broadcast(vars(net))

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        own, out = Network(**model.value), [np.zeros(0)]
        for batch in textnum.slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text", SLICE_BYTES):
            out.append(own.score(*word_ids(*textnum.string_buffer(batch.column(0)))))
        return pa.array(np.concatenate(out))

    return scored(F.col(text))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
