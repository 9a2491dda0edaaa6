"""Reading inputs, cutting lineage, folds and small helpers of the operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master (one machine, as in tests) gets a temporary
    folder; on a cluster executors couldn't read one, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    The table ends the lineage: a lost executor costs only the tasks after it. The
    write's own shuffle files go with its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    with settings(spark, CLEAN_UP):
        df.write.option("compression", compression).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written = (None, path)
    return found


def cut_by(df: DataFrame, key: str, label: str) -> DataFrame:
    """As cut, but bucketed by key: a later join on key reads the table without a shuffle."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    with settings(spark, CLEAN_UP):
        df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(name)
    found = spark.table(name)
    found.written = (name, path)
    return found


def discard(*frames: DataFrame) -> None:
    """Deletes the tables behind frames that cut or cut_by returned, once nothing reads them any more."""
    for df in frames:
        spark, (name, path) = df.sparkSession, df.written
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus: the held-out fold of a document."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column | str, modulus: int, remainder: int) -> Column:
    """Whether an id is in the held-out fold; a row without an id is never learned from, so it is."""
    return F.coalesce(fold(doc_id, modulus) == remainder, F.lit(True))


def slim(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns: extra columns, whatever their names, stay out."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the jobs that run inside; what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: For rows that are large arrays: only a few of them in memory at a time.
FEW_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}
#: Shuffle files of a query are deleted when it ends.
CLEAN_UP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def without(docs: DataFrame, ids: DataFrame, most: int = 200_000) -> DataFrame:
    """docs but for the rows whose doc_id is in ids; up to ``most`` ids are broadcast, more are shuffled."""
    gone = free_name(docs, "gone")
    ids = ids.select(F.col("doc_id").alias(gone))
    few = ids.count() <= most
    return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids[gone], "left_anti")


def join_counted(rows: DataFrame, counted: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to counted, which has one row a key and in n the key's number of rows.

    Keys of more than 1000 rows and a hundred-thousandth of the total, of which there can
    be 100,000 at most, are broadcast; so no task gets all rows of a hot key.
    """
    limit = max(1000, total // 100_000)
    hot = F.broadcast(counted.where(F.col("n") > limit))
    cold = rows.join(hot.select(key), key, "left_anti").join(counted.where(F.col("n") <= limit), key, how)
    return rows.join(hot, key).unionByName(cold)
