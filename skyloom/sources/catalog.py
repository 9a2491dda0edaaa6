"""Archives as view namespaces, recipes, readers of nested records, named lists and text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.functions import missing
from skyloom.operators.tabular import latest_per_key

# Column names under which catalogues give positions, in order of preference.
RA_NAMES = ("ra", "RA", "ra_deg", "RA_ICRS", "RAJ2000", "_RAJ2000", "raj2000", "RAdeg")
DEC_NAMES = ("dec", "DEC", "dec_deg", "DE_ICRS", "DEJ2000", "_DEJ2000", "dej2000", "DEdeg")


def position_columns(df: DataFrame) -> tuple[str, str]:
    """The position columns of a table: the first known alias that it has."""
    for names in (RA_NAMES, DEC_NAMES):
        if not any(n in df.columns for n in names):
            raise KeyError(f"no position column among {df.columns}")
    return next(n for n in RA_NAMES if n in df.columns), next(n for n in DEC_NAMES if n in df.columns)


class Archive:
    """Tables of one archive as temporary views ``<archive>_<table>``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def register(self, table: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(f"{self.name}_{table}")

    def discover(self, text: str = "") -> list[str]:
        """Names of the archive's tables that contain the text, case ignored."""
        head = f"{self.name}_".lower()
        return sorted(t.name for t in self.spark.catalog.listTables() if t.name.lower().startswith(head) and text.lower() in t.name[len(head) :].lower())

    def healthy(self) -> bool:
        return bool(self.discover())


def records_to_table(df: DataFrame, column: str, schema: T.StructType, rename: dict[str, str]) -> DataFrame:
    """JSON objects as typed columns under new names; missing numbers are NaN and missing texts empty."""
    j = df.select(F.from_json(column, schema).alias("j"))
    out = []
    for f in schema:
        x = F.col(f"j.{f.name}")
        fill = F.lit(float("nan")) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.lit("") if isinstance(f.dataType, T.StringType) else None
        out.append((x if fill is None else F.coalesce(x, fill)).alias(rename.get(f.name, f.name)))
    return j.select(*out)


def field_matrix(df: DataFrame, column: str) -> DataFrame:
    """{"fields": [...], "data": [[...], ...]} records as rows of a map from field to value."""
    schema = "fields array<string>, data array<array<string>>"
    return df.select(F.from_json(column, schema).alias("j")).select(F.col("j.fields").alias("f"), F.explode("j.data").alias("d")).select(F.map_from_arrays("f", "d").alias("row"))


def three_line_elements(lines: DataFrame, number: str = "n", text: str = "value") -> DataFrame:
    """Orbital elements from a text of three-line records, by line number from 0."""
    own = lines.withColumn("k", F.floor(F.col(number) / 3)).withColumn("p", F.col(number) % 3)
    got = own.groupBy("k").agg(*[F.max(F.when(F.col("p") == i, F.trim(text))).alias(c) for i, c in enumerate(("name", "line1", "line2"))])
    return got.where(F.col("line1").startswith("1 ") & F.col("line2").startswith("2 ")).withColumn("inclination", F.substring("line2", 9, 8).cast("double"))


def wide_to_long(df: DataFrame, keys: list[str], bands: dict[str, tuple[str, str]]) -> DataFrame:
    """Epoch arrays of several bands (times, magnitudes) as one row per epoch and band."""
    parts = [df.select(*keys, F.lit(b).alias("band"), F.inline(F.arrays_zip(F.col(t).alias("t"), F.col(m).alias("mag")))) for b, (t, m) in bands.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(missing.is_finite(F.col("mag")))


def sampled_photometry(df: DataFrame, bands: dict[str, str]) -> DataFrame:
    """Observers' records: exploded results, one per id, limits dropped, band codes mapped, by date."""
    r = df.select(F.explode("results").alias("r")).select("r.*").dropDuplicates(["id"]).where("NOT coalesce(fainterthan, false)")
    codes = F.create_map(*[F.lit(x) for kv in bands.items() for x in kv])
    return r.select(F.col("jd_dbl").alias("jd"), F.col("magnitude").alias("mag"), F.col("uncertainty").alias("err"), F.try_element_at(codes, F.col("band")).alias("band"), "obscode", "obstype").where(F.col("band").isNotNull()).orderBy("jd")


class NamedLists:
    """Candidate lists: tables under a folder, and a log of which is current."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @staticmethod
    def slug(name: str) -> str:
        import re

        return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-") or "list"

    def save(self, name: str, df: DataFrame, utc: str, origin: str = "", note: str = "") -> str:
        path = f"{self.root}/lists/{self.slug(name)}"
        df.write.mode("overwrite").parquet(path)
        log = self.spark.createDataFrame([(self.slug(name), utc, origin, note, False)], "slug string, utc string, origin string, note string, dropped boolean")
        log.coalesce(1).write.mode("append").json(f"{self.root}/log")
        return path

    def index(self) -> DataFrame:
        log = self.spark.read.schema("slug string, utc string, origin string, note string, dropped boolean").json(f"{self.root}/log")
        return latest_per_key(log, ["slug"], "utc").where("NOT dropped")

    def exists(self, name: str) -> bool:
        return not self.index().where(F.col("slug") == self.slug(name)).isEmpty()

    def load(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise KeyError(f"no list {name!r}")
        return self.spark.read.parquet(f"{self.root}/lists/{self.slug(name)}")

    def drop(self, name: str, utc: str) -> None:
        log = self.spark.createDataFrame([(self.slug(name), utc, "", "", True)], "slug string, utc string, origin string, note string, dropped boolean")
        log.coalesce(1).write.mode("append").json(f"{self.root}/log")


def calendar_entries(df: DataFrame) -> DataFrame:
    """Watch events (id, start, end, title) as iCalendar entries, one text per row."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"([\;,])", r"\\$1"), "\n", r"\\n")
    day = lambda c: F.date_format(c, "yyyyMMdd")
    end = F.date_add(F.coalesce("end", "start"), 1)
    return df.where(F.col("start").isNotNull()).select(F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), esc("id")), F.concat(F.lit("DTSTART;VALUE=DATE:"), day("start")), F.concat(F.lit("DTEND;VALUE=DATE:"), F.date_format(end, "yyyyMMdd")), F.concat(F.lit("SUMMARY:"), esc("title")), F.lit("END:VEVENT")).alias("value"))


def parse_coordinates(text: str) -> Column:
    """Decimal pair or sexagesimal position in a text column as a struct (ra, dec); NULL otherwise."""
    t = F.trim(F.col(text))
    number = r"([-+]?\d+(?:\.\d+)?)"
    pair = rf"^{number}[\s,]+{number}$"
    ra, dec = F.regexp_extract(t, pair, 1).try_cast("double"), F.regexp_extract(t, pair, 2).try_cast("double")
    sexa = r"^(\d{1,2})[:\sh]+(\d{1,2})[:\sm]+(\d{1,2}(?:\.\d+)?)s?\s+([-+]?)(\d{1,2})[:\sd]+(\d{1,2})[:\sm]+(\d{1,2}(?:\.\d+)?)s?$"
    g = lambda k: F.regexp_extract(t, sexa, k).try_cast("double")
    ra2 = 15 * (g(1) + g(2) / 60 + g(3) / 3600)
    dec2 = F.when(F.regexp_extract(t, sexa, 4) == "-", -1).otherwise(1) * (g(5) + g(6) / 60 + g(7) / 3600)
    ok = lambda r, d: r.between(0, 360) & d.between(-90, 90)
    return F.when(ok(ra, dec), F.struct(ra.alias("ra"), dec.alias("dec"))).when(ok(ra2, dec2), F.struct(ra2.alias("ra"), dec2.alias("dec")))
