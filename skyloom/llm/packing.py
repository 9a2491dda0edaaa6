"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

Documents are tokenised once and cut into pieces; full pieces are sequences of their
own. The rest is dealt by hash into shards of bounded size. On each shard several
islands evolve small populations of packings, wherever best fit alone has more bins than the total length asks for: crossover injects well-filled bins of
one parent into the other, bins that hold a duplicate are dissolved, and displaced
pieces go back by best fit in falling length. After an epoch each island's elite
moves to the next island of its shard. Poorly filled bins of all shards are then
dealt anew, whole, and packed together once more, so what sharding loses is won back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm import tokens
from skyloom.llm.common import cut, documents, slim

CAPACITY, SEPARATOR = 2048, 0
SHARD_ITEMS = 4096  # pieces in a shard, on average: hashing deals them evenly
ISLANDS, EPOCHS, POPULATION = 3, 2, 6
LEAST_GENERATIONS, MOST_GENERATIONS, EFFORT = 4, 60, 200_000  # generations of an epoch; items placed in one, about
BLURS = (0.03, 0.1, 0.3)  # of lengths, in the beginnings of a population
WELL_FILLED, POOR, SEED = 0.995, 0.97, 11

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenise(docs: DataFrame, capacity: int = CAPACITY, rank_file: str | None = None) -> DataFrame:
    """The pieces of every document: its ids and then the separator, cut only where longer than capacity.

    Null and empty texts are the separator alone. uid numbers the rows of this frame
    and holds only once it is written.
    """
    path = rank_file or tokens.rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from array import array

        from pyspark import TaskContext

        encoding = tokens.encoder(path)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out: list[list] = [[] for _ in range(6)]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = tokens.token_ids(encoding, text.as_py() or "", added=True) + array("I", [SEPARATOR])
                    start, piece = 0, 0
                    while start < len(ids):
                        size = (len(ids) - start) % capacity or capacity
                        row = (uid, doc_id, piece, start, size, zlib.crc32(ids[start : start + size].tobytes()))
                        for column, x in zip(out, row, strict=True):
                            column.append(x)
                        uid, piece, start = uid + 1, piece + 1, start + size
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return slim(docs, "doc_id", "text").mapInArrow(run, PIECES)


# --- the grouping genetic algorithm on the lengths of one shard ---


@dataclass
class Packing:
    """bin_of: bin of each item, numbered from 0 without gaps; fill: items' total by bin."""

    bin_of: np.ndarray
    fill: np.ndarray

    def fitness(self, capacity: int) -> float:
        """Fewer bins first; among equals, fuller full bins (mean squared fill)."""
        return -len(self.fill) + float(np.mean((self.fill / capacity) ** 2)) if len(self.fill) else 0.0


def best_fit(lengths: np.ndarray, order: np.ndarray, bin_of: np.ndarray, fill: list[int], capacity: int) -> None:
    """Places the items of order one by one into the fullest bin that has room; opens bins as needed.

    Open bins are kept by free room, and the rooms that occur as bits of one integer.
    """
    stacks: dict[int, list[int]] = {}
    rooms = 0
    for b, f in enumerate(fill):
        room = capacity - f
        if room:
            stacks.setdefault(room, []).append(b)
            rooms |= 1 << room
    for item, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = stacks[room]
            b = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
            fill[b] += size
        else:
            room, b = capacity, len(fill)
            fill.append(size)
        bin_of[item] = b
        left = room - size
        if left:
            if stacks.get(left):
                stacks[left].append(b)
            else:
                stacks[left] = [b]
                rooms |= 1 << left


def _falling(lengths: np.ndarray, rng: np.random.Generator | None, items: np.ndarray, blur: float = BLURS[0]) -> np.ndarray:
    """Items by falling length; with rng, lengths are blurred."""
    size = lengths[items].astype(float)
    if rng is not None:
        size = size * (1 + blur * rng.standard_normal(len(items)))
    return items[np.argsort(-size, kind="stable")]


def fresh(lengths: np.ndarray, rng: np.random.Generator | None, capacity: int, blur: float = BLURS[0]) -> Packing:
    bin_of, fill = np.zeros(len(lengths), np.int32), []
    best_fit(lengths, _falling(lengths, rng, np.arange(len(lengths)), blur), bin_of, fill, capacity)
    return Packing(bin_of, np.asarray(fill, np.int64))


def crossover(a: Packing, b: Packing, lengths: np.ndarray, rng: np.random.Generator, capacity: int) -> Packing:
    """A child of a with some of b's well-filled bins."""
    good = np.flatnonzero(b.fill >= WELL_FILLED * capacity)
    if not len(good):
        good = np.argsort(-b.fill)[: max(1, len(b.fill) // 4)]
    taken = rng.permutation(good)[: max(1, int(len(good) * rng.uniform(0.05, 0.25)))]
    injected = np.zeros(len(b.fill), bool)
    injected[taken] = True
    moved = injected[b.bin_of]
    hit = np.zeros(len(a.fill), bool)
    hit[a.bin_of[moved]] = True
    if not hit.all():  # one poor bin more is opened, as mutation
        hit[np.argmin(np.where(hit, capacity + 1, a.fill))] = True
    displaced = np.flatnonzero(hit[a.bin_of] & ~moved)
    number_a, number_b = np.cumsum(~hit) - 1, np.cumsum(injected) - 1 + int((~hit).sum())
    bin_of = np.where(moved, number_b[b.bin_of], number_a[a.bin_of]).astype(np.int32)
    fill = np.concatenate([a.fill[~hit], b.fill[injected]]).tolist()
    best_fit(lengths, _falling(lengths, None, displaced), bin_of, fill, capacity)
    return Packing(bin_of, np.asarray(fill, np.int64))


def generations_for(items: int) -> int:
    """Generations of an epoch: as many as place about EFFORT items, between the least and the most."""
    return max(LEAST_GENERATIONS, min(MOST_GENERATIONS, EFFORT // max(1, items * POPULATION)))


def evolve(lengths: np.ndarray, population: list[Packing], generations: int, rng: np.random.Generator, capacity: int) -> list[Packing]:
    """Steady-state evolution; the best stays. Stops where no packing can have fewer bins."""
    least = -(-int(lengths.sum()) // capacity)
    for _ in range(generations):
        population.sort(key=lambda p: -p.fitness(capacity))
        if len(population[0].fill) <= least or len(population) < 2:
            break
        children = [crossover(population[0], population[k], lengths, rng, capacity) for k in range(1, len(population))]
        children.append(crossover(population[-1], population[0], lengths, rng, capacity))
        population = sorted(population + children, key=lambda p: -p.fitness(capacity))[: len(population)]
    return sorted(population, key=lambda p: -p.fitness(capacity))


ISLAND = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("island", T.IntegerType()),
    T.StructField("uids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())),
    T.StructField("elite", T.ArrayType(T.IntegerType())), T.StructField("fitness", T.DoubleType()),
])


def epoch(islands: DataFrame, number: int, capacity: int) -> DataFrame:
    """One epoch on every island. An island that comes without elite begins afresh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lengths = np.asarray(r["lengths"], np.int64)
                rng = np.random.default_rng([SEED, number, r["shard"] & 0x7FFFFFFF, r["island"]])
                start = []
                for elite in (r["elite"], r["migrant"]):
                    if elite is not None:
                        bins = np.asarray(elite, np.int32)
                        start.append(Packing(bins, np.bincount(bins, lengths).astype(np.int64)))
                if not start:
                    start = [fresh(lengths, None if r["island"] == 0 else rng, capacity)]
                while len(start) < POPULATION and len(start[0].fill) * capacity - int(lengths.sum()) >= capacity:
                    start.append(fresh(lengths, rng, capacity, BLURS[len(start) % len(BLURS)]))
                best = evolve(lengths, start, generations_for(len(lengths)), rng, capacity)[0]
                out = {k: r[k] for k in ("shard", "island", "uids", "lengths")} | {"elite": best.bin_of.tolist(), "fitness": best.fitness(capacity)}
                yield pa.RecordBatch.from_pylist([out], schema=_ARROW)

    return islands.mapInArrow(run, ISLAND)


_ARROW = pa.schema([
    ("shard", pa.int64()), ("island", pa.int32()), ("uids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("elite", pa.list_(pa.int32())), ("fitness", pa.float64()),
])


def _pack(shards: DataFrame, capacity: int) -> DataFrame:
    """Best packing found for each shard (shard, uids, lengths)."""
    state = shards.select("shard", "uids", "lengths", F.explode(F.array([F.lit(i) for i in range(ISLANDS)])).alias("island"))
    state = state.withColumn("elite", F.lit(None).cast("array<int>")).withColumn("migrant", F.lit(None).cast("array<int>"))
    state = state.repartition("shard", "island")
    for number in range(EPOCHS):
        state = cut(epoch(state, number, capacity), "islands")
        if number + 1 < EPOCHS:
            arriving = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite").alias("migrant"))
            state = state.join(arriving, ["shard", "island"])
    best = state.groupBy("shard").agg(F.max_by("island", F.struct("fitness", -F.col("island"))).alias("island"))
    return state.join(best, ["shard", "island"]).select("shard", "uids", "lengths", "elite")


def _bins(packed: DataFrame, capacity: int) -> DataFrame:
    """A row per bin: the uids and lengths of its items, in order, and its fill."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                uids, lengths, bins = np.asarray(r["uids"], np.int64), np.asarray(r["lengths"], np.int64), np.asarray(r["elite"], np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(bins))])
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[order])) for x in (uids, lengths)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array(np.bincount(bins, lengths).astype(np.int64))], ["uids", "lengths", "fill"])

    return packed.mapInArrow(run, "uids array<long>, lengths array<long>, fill long")


def _shards(rows: DataFrame, count: int, key: str, per_row: float) -> DataFrame:
    """Rows of uids and lengths arrays dealt by a hash of key into shards of about SHARD_ITEMS items."""
    n = max(1, round(count * per_row / SHARD_ITEMS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(n)).cast("long"))
    grouped = dealt.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("uids", "lengths"))).alias("r"))
    return grouped.select("shard", F.flatten(F.col("r.uids")).alias("uids"), F.flatten(F.col("r.lengths")).alias("lengths"), F.transform("r", lambda x: F.size(x["uids"])).alias("were"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset of each piece (uid, length) of a written table."""
    full = pieces.where(F.col("length") >= capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose = pieces.where(F.col("length") < capacity).select(F.array("uid").alias("uids"), F.array("length").alias("lengths"), F.col("uid").alias("key"))
    first = cut(_bins(_pack(_shards(loose, loose.count(), "key", 1.0), capacity), capacity), "bins")
    poor = first.where(F.col("fill") < POOR * capacity).withColumn("key", F.element_at("uids", 1))
    left = poor.agg(F.count(F.lit(1)).alias("bins"), F.coalesce(F.sum(F.size("uids")), F.lit(0)).alias("items")).first()
    bins = first.where(F.col("fill") >= POOR * capacity)
    if left.bins:
        again = cut(_shards(poor, left.bins, "key", left["items"] / left.bins), "poor")
        packed = _pack(again, capacity).join(again.select("shard", "were"), "shard")
        # A shard whose new packing has more bins than it came with keeps the old ones.
        old = F.flatten(F.transform(F.arrays_zip(F.sequence(F.lit(0), F.size("were") - 1).alias("i"), F.col("were").alias("n")), lambda x: F.array_repeat(x["i"].cast("int"), x["n"])))
        packed = packed.withColumn("elite", F.when(F.array_max("elite") + 1 <= F.size("were"), F.col("elite")).otherwise(old))
        bins = bins.unionByName(_bins(packed.drop("were"), capacity))
    # Offsets: lengths of the items before, in the bin's order.
    spread = bins.select(F.element_at("uids", 1).alias("sequence_id"), "lengths", F.posexplode("uids").alias("k", "uid"))
    before = F.aggregate(F.slice("lengths", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda s, x: s + x)
    return full.unionByName(spread.select("uid", "sequence_id", before.alias("offset")))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document and its place in a sequence.

    Null and empty texts are one piece, the separator; texts are tokenised whole, however long,
    and only those of more than ``capacity`` ids are cut. Repeated rows are packed like any
    others; a null doc_id stays null; an empty table gives no rows; extra columns are not read.
    Pieces of one length are taken in the order of their rows, and of several bins with the
    same room the one that got it last is filled.
    """
    pieces = cut(tokenise(docs, capacity), "pieces")
    placed = pack(pieces.select("uid", "length"), capacity)
    return pieces.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
