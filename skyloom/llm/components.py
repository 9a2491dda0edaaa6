"""Connected components of a distributed edge list, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import cut, discard, settings


def _settled(edges: DataFrame) -> bool:
    """Whether every component is a star around its least node: nobody has two smaller neighbours, nobody a smaller and a larger one."""
    ends = edges.select(F.inline(F.array(*[F.struct(F.col(c).alias("node"), F.lit(up).alias("smaller"), F.lit(1 - up).alias("larger")) for c, up in (("hi", 1), ("lo", 0))])))
    told = ends.groupBy("node").agg(F.sum("smaller").alias("smaller"), F.sum("larger").alias("larger"))
    return told.where("smaller > 1 OR (smaller > 0 AND larger > 0)").agg(F.count(F.lit(1)).alias("n")).first().n == 0


#: A round is one job: its hot keys are salted, and planning it anew after each shuffle fills the driver with plans and threads.
ONE_JOB = {"spark.sql.adaptive.enabled": "false"}
SALTS = 16  # parts of a node's neighbours that are joined apart


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of every node of the edges (a, b).

    Rounds of large star and small star until all components are stars: each node is tied
    to the least node it knows. A round shuffles the edges; none is collected. A node's
    least neighbour is found by partial aggregation and joined to SALTS parts of its
    neighbours, so the centre of a large star isn't one task's. Nodes with nulls and
    loops are left out; repeated edges count once.
    """
    salts = F.array(*[F.lit(k) for k in range(SALTS)])
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    with settings(edges.sparkSession, ONE_JOB):
        now = cut(
            edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
            "edges",
        )
        while not _settled(now):
            both = now.select(F.inline(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in (("hi", "lo"), ("lo", "hi"))])))
            least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1 OR m < u").select("u", F.least("u", "m").alias("m"), F.explode(salts).alias("salt"))
            above = both.where("v > u").withColumn("salt", salt("v"))
            large = above.join(least, ["u", "salt"], "left").select(F.col("v").alias("hi"), F.coalesce("m", "u").alias("lo")).distinct()
            small = large.groupBy("hi").agg(F.min("lo").alias("m"))
            spread = small.select("hi", "m", F.explode(salts).alias("salt"))
            moved = large.withColumn("salt", salt("lo")).join(spread, ["hi", "salt"]).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            last, now = now, cut(moved.unionByName(small.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
            discard(last)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
