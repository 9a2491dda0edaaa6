"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas: an
insert adds a document and its tokens, a delete takes them away, a revision does
both. A batch of changes is reduced to one row a key and written to a folder named
after the batch; Spark's success mark commits it. A batch that is committed already
is left alone, one that broke off is written anew, so every batch counts once
however often it is sent. Compaction replaces committed batches by their sum.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import tokens
from skyloom.llm.common import cut, discard, documents, join_counted, shared_dir, slim

KEY = ("source", "lang", "tokenizer")
VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k")
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, versions: tuple[str, ...] = VERSIONS) -> DataFrame:
    """doc_id, source, lang, digest of the text, and tokens: an array with a count for each version.

    Null and empty texts have no tokens.
    """
    paths = [tokens.rank_file(v) for v in versions]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encodings = [tokens.encoder(p) for p in paths]
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(4)]
            counts = [[len(e.encode_ordinary(t)) if t else 0 for e in encodings] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "source", "lang", "digest", "tokens"])

    rows = slim(docs, "doc_id", "source", "lang", "text")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, lang string, digest string, tokens array<long>")


def by_version(counts: DataFrame, versions: tuple[str, ...] = VERSIONS) -> DataFrame:
    """A row per document and tokenizer version."""
    names = F.array(*[F.lit(v) for v in versions])
    return counts.select("doc_id", "source", "lang", F.inline(F.arrays_zip(names.alias("tokenizer"), F.col("tokens").alias("tokens"))))


def inserts(rows: DataFrame) -> DataFrame:
    return rows.select(*KEY, F.lit(1).alias("docs"), "tokens")


def deletes(rows: DataFrame) -> DataFrame:
    return rows.select(*KEY, F.lit(-1).alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(rows: DataFrame, new_tokens: str) -> DataFrame:
    """Rows with their old count in tokens and the new one in another column."""
    return rows.select(*KEY, F.lit(0).alias("docs"), (F.col(new_tokens) - F.col("tokens")).alias("tokens"))


class TokenRollup:
    """Committed deltas in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        path, fs = self._path(f"batch={batch}/_SUCCESS")
        return fs.exists(path)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of signed changes (key columns, docs, tokens); false if it was committed before."""
        if not batch or any(c in batch for c in "/=\\ "):
            raise ValueError(f"a batch name is one word without /, = and spaces: {batch!r}")
        if self.committed(batch):
            return False
        delta = changes.groupBy(*KEY).agg(F.sum("docs").cast("long").alias("n_docs"), F.sum("tokens").cast("long").alias("n_tokens"))
        delta.write.mode("overwrite").parquet(f"{self.root}/batch={batch}")
        return True

    def _committed(self) -> list[str]:
        path, fs = self._path("")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in names if n.startswith(("batch=", "sum=")) and fs.exists(self._path(f"{n}/_SUCCESS")[0]))

    def _held(self, total: str) -> set[str]:
        """Names of the batches that a sum holds: a name a batch."""
        return {r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.root}/held={total[4:]}").collect()}

    def _live(self, done: list[str]) -> list[str]:
        """Of what is committed the newest sum and the batches that it doesn't hold."""
        sums = [n for n in done if n.startswith("sum=")]
        held = self._held(sums[-1]) if sums else set()
        return sums[-1:] + [n for n in done if n.startswith("batch=") and n[6:] not in held]

    def _rows(self, names: list[str]) -> DataFrame:
        rows = self.spark.read.schema(DELTA).parquet(*[f"{self.root}/{n}" for n in names]) if names else self.spark.createDataFrame([], DELTA)
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """Sums over all committed batches; keys without any document left are gone."""
        return self._rows(self._live(self._committed())).where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self) -> None:
        """Replaces the committed batches by their sum. The success mark of the sum commits it; before that the
        batches count, after it the sum does. One listing says what the sum holds: a batch committed meanwhile
        stays beside it. Names of batches stay, so that none is taken twice. Rows that this sum replaces are
        kept, as totals asked for before may still read them; those that the sum before replaced are deleted.
        One compaction runs at a time.
        """
        done = self._committed()
        sums = [n for n in done if n.startswith("sum=")]
        name = f"{int(sums[-1][4:]) + 1 if sums else 0:012d}"
        self.spark.createDataFrame([(n[6:],) for n in done if n.startswith("batch=")], "batch string").write.mode("overwrite").parquet(f"{self.root}/held={name}")
        self._rows(self._live(done)).write.mode("overwrite").parquet(f"{self.root}/sum={name}")
        replaced = self._held(sums[-1]) if sums else set()
        for n in sums[:-1]:
            for old in (n, f"held={n[4:]}"):
                path, fs = self._path(old)
                fs.delete(path, True)
        for n in replaced:  # an empty folder with its success mark remains
            path, fs = self._path(f"batch={n}")
            for s in fs.listStatus(path):
                if s.getPath().getName() != "_SUCCESS":
                    fs.delete(s.getPath(), True)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches over all documents: all are inserted; exact copies of a text but the
    one with the least id are deleted; the counts of the rest are revised to hold the end token.

    The second batch is sent twice and counts once; after it the batches are compacted.
    Null and empty texts have no tokens but the end; rows without an id are never copies,
    repeated rows of one id are none either; null sources and languages are keys of their
    own; an empty table gives no totals; extra columns are not read; texts are counted
    whole, however long.
    """
    counts = cut(count_tokens(documents(spark, sf_dir)), "token-counts")
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/rollup-{uuid.uuid4().hex}")
    rollup.commit("load", inserts(by_version(counts)))
    first = counts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = cut(first.where("n > 1"), "repeated-texts")
    marked = join_counted(counts, repeated, "digest", counts.count(), "left")
    marked = cut(marked.withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("digest", "first", "n"), "marked")
    for _ in range(2):
        rollup.commit("copies", deletes(by_version(marked.where("copy"))))
    rollup.compact()
    kept = by_version(marked.where("NOT copy")).withColumn("with_end", F.col("tokens") + 1)
    rollup.commit("end-token", revisions(kept, "with_end"))
    discard(counts, repeated, marked)
    return rollup.totals()
