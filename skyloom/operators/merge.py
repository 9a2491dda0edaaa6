"""Merging catalogues: sources that stand for the same object, by an ordered greedy rule.

In order of priority each source that is still there is kept and takes away all later
ones within the radius. That is one sequential pass, and it is not the same as
connected components: in a chain a - b - c, b goes to a and c is kept. Spark gets it by
rounds: a source without an earlier neighbour in doubt is kept, its later neighbours go,
and what is left in doubt is asked again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import missing
from skyloom.operators.match import cross_match
from skyloom.sources.shared import written


def earlier_neighbours(places: DataFrame, radius: float, ra: str, dec: str) -> DataFrame:
    """a and b: orders of two places within radius degrees, a the earlier. places has a column order."""
    left = places.select(F.col("order").alias("a"), F.col(ra).alias("__ra_a"), F.col(dec).alias("__dec_a"))
    right = places.select(F.col("order").alias("b"), F.col(ra).alias("__ra_b"), F.col(dec).alias("__dec_b"))
    return cross_match(left, right, radius, ("__ra_a", "__dec_a"), ("__ra_b", "__dec_b")).where("a < b").select("a", "b")


def removed_by_rounds(edges: DataFrame) -> DataFrame:
    """b: every place that an earlier kept one takes away. edges (a, b) are read again in each round: write them first.

    A round is two joins over the pairs in doubt. It settles at least the first place of
    every group of places in doubt; there are as many rounds as the longest run of places
    that wait for each other. Each round's rest is written, so a lost executor repeats one round.
    """
    doubt, gone = edges, []
    while doubt.head(1):
        kept = doubt.select(F.col("a").alias("kept")).distinct().join(doubt.select(F.col("b").alias("kept")).distinct(), "kept", "left_anti")
        taken = written(doubt.join(kept, doubt["a"] == kept["kept"], "left_semi").select("b").distinct(), "taken")
        gone.append(taken)
        rest = doubt.join(kept, doubt["a"] == kept["kept"], "left_anti")
        rest = rest.join(taken.select(F.col("b").alias("a")), "a", "left_anti").join(taken, "b", "left_anti").select("a", "b")
        doubt = written(rest, "in-doubt")
    out = edges.select("b").limit(0)
    for taken in gone:
        out = out.unionByName(taken)
    return out


def merged_into(rows: DataFrame, radius: float, priority: Column, id: str, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """rows with owner: the id of the kept source that takes each in, its own where it is kept.

    Order is by priority, then id; ids are unique. Rows of exactly one position act as their
    first: any source that takes it takes all of them, so a position that holds many rows
    enters the pairs once. Rows without a finite position stay as they are.
    """
    rows = rows.withColumn("__order", F.struct(priority.alias("p"), F.col(id).alias("i")))
    good = missing.is_finite(F.col(ra)) & missing.is_finite(F.col(dec)) & F.coalesce(F.col(dec).between(-90, 90), F.lit(False))
    places = written(rows.where(good).groupBy(F.col(ra).alias("__ra"), F.col(dec).alias("__dec")).agg(F.min("__order").alias("order")), "places")
    edges = written(earlier_neighbours(places, radius, "__ra", "__dec"), "neighbours")
    gone = written(removed_by_rounds(edges), "taken-in")
    # A place goes to the first kept one before it.
    owners = edges.join(gone.select(F.col("b").alias("a")), "a", "left_anti").groupBy("b").agg(F.min("a").alias("owner"))
    owned = places.join(owners, places["order"] == owners["b"], "left").select("__ra", "__dec", F.coalesce("owner", "order").alias("__owner"))
    found = rows.where(good).join(owned, (rows[ra] == owned["__ra"]) & (rows[dec] == owned["__dec"])).drop("__ra", "__dec")
    return found.unionByName(rows.where(~good).withColumn("__owner", F.col("__order"))).withColumn("owner", F.col("__owner.i")).drop("__order", "__owner")


def merge_duplicates(rows: DataFrame, radius: float, priority: Column, id: str = "id", source: str = "src", kind: str = "cls", ra: str = "ra", dec: str = "dec") -> DataFrame:
    """The kept sources: id, position, class, sources in order of appearance joined by "|", and the number of rows merged.

    A source that takes in a recurrent one ("rn") becomes one; a nova that takes in a
    symbiotic star becomes "nova+symbiotic". A catalogue that gives several of the merged
    rows is named once, so a kept source holds a name per catalogue, not per row.
    """
    owned = merged_into(rows.select(id, ra, dec, source, kind, priority.alias("__p")), radius, F.col("__p"), id, ra, dec)
    own = F.col(id) == F.col("owner")
    parts = owned.groupBy("owner", source).agg(
        F.min(F.struct("__p", id)).alias("first"), F.count(F.lit(1)).alias("n"), F.max(F.when(own, F.struct(ra, dec, kind))).alias("keeper"),
        F.max(F.when(own, F.lit(False)).otherwise(F.col(kind) == "rn")).alias("rn"), F.max(F.when(own, F.lit(False)).otherwise(F.col(kind) == "symbiotic")).alias("symbiotic"),
    )
    merged = parts.groupBy("owner").agg(
        F.max("keeper").alias("k"), F.concat_ws("|", F.transform(F.sort_array(F.collect_list(F.struct("first", F.col(source).alias("s")))), lambda x: x["s"])).alias(source), F.sum("n").alias("n_merged"),
        F.max("rn").alias("rn"), F.max("symbiotic").alias("symbiotic"),
    )
    new = F.when(F.col("rn"), "rn").when(F.col("symbiotic") & (F.col(f"k.{kind}") == "nova"), "nova+symbiotic").otherwise(F.col(f"k.{kind}"))
    return merged.select(F.col("owner").alias(id), F.col(f"k.{ra}").alias(ra), F.col(f"k.{dec}").alias(dec), new.alias(kind), source, "n_merged")
