"""Target names and positions resolved against catalogues, the first way that gives a finite position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.functions import missing
from skyloom.operators.match import cross_match
from skyloom.sources.catalog import parse_coordinates
from skyloom.sources.shared import written

# Confidence by kind of match, and classes by what an object type holds, the first that fits.
CONFIDENCE = {"exact": 1.0, "ephemeris": 0.95, "coordinate": 0.9, "nearby": 0.8, "relaxed": 0.5, "ambiguous": 0.4, "blank": 0.3}
CLASSES = {
    "G": "galaxy_agn", "Gal": "galaxy_agn", "AGN": "galaxy_agn", "QSO": "galaxy_agn", "Sy1": "galaxy_agn", "Sy2": "galaxy_agn", "Blaz": "galaxy_agn", "BLL": "galaxy_agn",
    "ClG": "cluster", "Group": "cluster", "SubG": "cluster", "Star": "star", "*": "star", "PM*": "star", "V*": "star", "WD*": "star", "X": "high_energy", "gamma": "high_energy",
    "pulsar": "high_energy", "PSR": "high_energy", "SNR": "nebula", "PN": "nebula", "HII": "nebula", "Solar System": "solar", "Sun": "solar", "Planet": "solar", "Asteroid": "solar",
}

HOT, SALTS = 1000, 32  # aliases of a word from which on it is common, and into how many parts those are dealt


def object_class(otype: Column) -> Column:
    """Class of an object type: that of the first key it contains in any case, in the table's order; else unknown."""
    low = F.lower(otype)
    out = F.lit("unknown")
    for key, name in reversed(CLASSES.items()):
        out = F.when(low.contains(key.lower()), name).otherwise(out)
    return out


def resolve_targets(requests: DataFrame, objects: DataFrame, ephemerides: DataFrame, radius_arcmin: float = 3.0) -> DataFrame:
    """One row a request that is resolved: request, name, ra, dec, otype, object_class, kind, confidence, alternatives.

    requests: request (any unique key) and text. objects: name, alias, otype, ra, dec; ephemerides: name, otype,
    ra, dec. A text that is a position is that field, with the nearest object within the radius
    if there is one ("nearby", else "blank"). Any other text is looked up as an alias ("exact"), as
    a body with an ephemeris, and as a part of an alias ("relaxed", with several objects "ambiguous"),
    in any case and without outer spaces; the first way whose best row has a finite position counts.
    Of several objects the one with the least name is taken and the others are counted. Lookups
    are joins: by alias, by name, by sky cell, and for parts by the rarest word of the text, all of whose
    words an alias must hold.
    """
    # Written once: the position is parsed from the text once, not wherever a plan refers to it.
    asked = written(requests.select("request", F.trim("text").alias("text"), parse_coordinates("text").alias("at")), "requests")
    fields, names = asked.where("at IS NOT NULL"), asked.where("at IS NULL AND text <> ''").withColumn("low", F.lower("text"))
    known = objects.select("name", F.lower(F.trim("alias")).alias("low"), "otype", "ra", "dec")

    near = fields.select("request", F.col("at.ra").alias("at_ra"), F.col("at.dec").alias("at_dec"))
    # Requests of one position look once; objects are counted by name, so no task holds the names of a position.
    places = written(near.select("at_ra", "at_dec").distinct(), "places")
    found = cross_match(places, objects.select("name", "otype", "ra", "dec").distinct(), radius_arcmin / 60, ("at_ra", "at_dec"), ("ra", "dec"))
    found = found.groupBy("at_ra", "at_dec", "name").agg(F.min(F.struct("separation", "name", "otype")).alias("best"))
    found = found.groupBy("at_ra", "at_dec").agg(F.min("best").alias("best"), (F.count(F.lit(1)) - 1).alias("alternatives"))
    label = F.format_string("field %.4f %+.4f", "at_ra", "at_dec")
    fields = near.join(found, ["at_ra", "at_dec"], "left").select(
        "request", F.coalesce("best.name", label).alias("name"), F.col("at_ra").alias("ra"), F.col("at_dec").alias("dec"), F.coalesce("best.otype", F.lit("")).alias("otype"),
        F.when(F.col("best").isNull(), "blank").otherwise("nearby").alias("kind"), F.coalesce("alternatives", F.lit(0)).alias("alternatives"),
    )

    def ranked(pairs: DataFrame, rank: int, kind: Column) -> DataFrame:
        rows = pairs.groupBy("request", "name").agg(F.min(F.struct("otype", "ra", "dec")).alias("o")).groupBy("request")
        rows = rows.agg(F.min(F.struct("name", "o")).alias("b"), F.count(F.lit(1)).alias("n"))
        return rows.select("request", F.lit(rank).alias("rank"), "b.name", "b.o.ra", "b.o.dec", "b.o.otype", kind.alias("kind"), (F.col("n") - 1).alias("alternatives"))

    exact = ranked(names.join(known, "low"), 0, F.lit("exact"))
    moving = ranked(names.join(ephemerides.select("name", F.lower(F.trim("name")).alias("low"), "otype", "ra", "dec"), "low"), 1, F.lit("ephemeris"))
    word = lambda c: F.array_distinct(F.array_remove(F.split(c, r"\s+"), ""))
    # A text is looked up by its rarest word alone, and each text once, so a word that fills the catalogue meets only texts that are nothing else.
    held = known.select("name", "otype", "ra", "dec", word("low").alias("words"))
    frequency = written(held.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    # Words of many aliases, at most total / HOT of them, are joined by broadcast, and their aliases are dealt over SALTS.
    limit = max(HOT, (frequency.agg(F.sum("n")).first()[0] or 0) // 100_000)
    hot = F.broadcast(frequency.where(F.col("n") > limit))
    texts = names.select("low", word("low").alias("asked")).distinct()
    parts = texts.select("low", "asked", F.explode("asked").alias("word"))
    parts = parts.join(hot, "word").unionByName(parts.join(hot, "word", "left_anti").join(frequency.where(F.col("n") <= limit), "word"))
    parts = parts.groupBy("low", "asked").agg(F.min(F.struct("n", "word")).alias("rarest"), F.count(F.lit(1)).alias("n")).where(F.col("n") == F.size("asked"))
    parts = written(parts.select("low", "asked", "rarest.word", (F.col("rarest.n") > limit).alias("common")), "parts")
    named = held.withColumn("word", F.explode("words"))
    plain = parts.where("NOT common").join(named.join(hot, "word", "left_anti"), "word")
    wanted = F.broadcast(parts.where("common").select("word").distinct())
    salted = named.join(wanted, "word", "left_semi").withColumn("salt", F.pmod(F.xxhash64("name", "ra", "dec"), F.lit(SALTS)))
    common = parts.where("common").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).join(salted, ["word", "salt"]).drop("salt")
    relaxed = plain.unionByName(common).where(F.size(F.array_except("asked", "words")) == 0)
    # By text: the least name, and how many.
    told = relaxed.groupBy("low", "name").agg(F.min(F.struct("otype", "ra", "dec")).alias("o")).groupBy("low").agg(F.min(F.struct("name", "o")).alias("b"), F.count(F.lit(1)).alias("n"))
    relaxed = names.select("request", "low").join(told, "low").select(
        "request", F.lit(2).alias("rank"), "b.name", "b.o.ra", "b.o.dec", "b.o.otype", F.when(F.col("n") > 1, "ambiguous").otherwise("relaxed").alias("kind"), (F.col("n") - 1).alias("alternatives"),
    )
    every = exact.unionByName(moving).unionByName(relaxed).where(missing.is_finite(F.col("ra")) & missing.is_finite(F.col("dec")))
    first = every.withColumn("k", F.row_number().over(W.partitionBy("request").orderBy("rank"))).where("k = 1").drop("k", "rank")
    out = fields.unionByName(first.select(*fields.columns))
    confidence = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    return out.withColumn("otype", F.coalesce("otype", F.lit(""))).withColumn("object_class", object_class(F.col("otype"))).withColumn("confidence", F.element_at(confidence, F.col("kind")))
