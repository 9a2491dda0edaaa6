"""Personal data: base patterns and information-theoretic sanitisation, with DataFrame functions only.

Base spans (email, ip, card, phone) are found in each row by regular expressions and
checks; nothing is shuffled. Their values are the protected entities. The words in
a window around each occurrence are the terms that may reveal it. Over the corpus,
the point-wise mutual information of an entity and a term, as a share of the
entity's own information content, says how strongly the term gives the entity away:
1 means the term occurs with that entity alone. Terms above the threshold, with
enough different windows as evidence, are spans too: generalised to a placeholder,
or removed where they reveal almost everything. Everything is counted in different
texts: a text counts once however often it is copied, so repeated documents neither
make their words look revealing nor hide that they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import cut, discard, documents, free_name, slim

KINDS = ("email", "ip", "card", "phone", "term", "term")
TERM, REVEALING = 4, 5  # terms to generalise, and those that reveal almost everything
WINDOW_CHARS, WINDOW_WORDS = 80, 5
LEAST_WINDOWS = 3  # different windows with both, as evidence
GENERALISE, REMOVE = 0.80, 0.95  # shares of the entity's information content
BROADCAST_ROWS = 100_000

# The base patterns in forms that scan a text once: quantifiers are possessive and a
# match can only begin where a run of its characters does, or where the match before
# ended. Cards: a run of fewer than 12 digits is no card, so only longer ones are matched.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM_WORD = r"\p{L}[\p{L}\p{N}]{2,}"


def _folded(x: Column) -> Column:
    """Lower case, a character for each character wherever it stands: the dotted capital I and the final sigma are folded by hand."""
    return F.replace(F.lower(F.replace(x, F.lit("\u0130"), F.lit("i"))), F.lit("\u03c2"), F.lit("\u03c3"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits is right."""
    places = F.sequence(F.lit(1), F.length(digits))
    right = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(right, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _card(x: Column) -> Column:
    d = _digits(x)
    return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False))


#: By kind: pattern, a cheap necessary condition on the text, and the check of a match.
_BASE = (
    (EMAIL, lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True)),
    (IP, lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")), lambda m: F.rlike(m, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$"))),
    (CARD, lambda t: F.rlike(t, F.lit(r"[0-9][0-9\x20-]{10}")), _card),
    (PHONE, lambda t: F.contains(t, F.lit("+")), lambda m: F.length(_digits(m)).between(9, 15)),
)
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _places(text: Column, pattern: Column, kind: int, check=None) -> Column:
    """Spans of all matches of a pattern, in order: start, kind, end in code points."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), F.length(m).alias("n"), (check(m) if check else F.lit(True)).alias("ok")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def add(state: Column, m: Column) -> Column:
        begin = state["at"] + m["gap"]
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + m["n"]).alias("end")))
        return F.struct((begin + m["n"]).alias("at"), F.when(m["ok"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(pairs, start, add, lambda s: s["spans"])


def base_spans(text: str) -> Column:
    """All valid base spans of a text column, by start and then kind; null texts have none."""
    t = F.col(text)
    parts = [F.when(maybe(t), _places(t, F.lit(pattern), k, check)).otherwise(F.array().cast(_SPAN)) for k, (pattern, maybe, check) in enumerate(_BASE)]
    return F.array_sort(F.concat(*parts))


def _words_near(text: Column, span: Column) -> Column:
    """Lower-case words of the window around a span, the nearest five on each side.

    A word that the window's edge or the span cuts is no word of the text and is left
    out: one character more on each side shows it.
    """
    word = lambda s: F.regexp_extract_all(_folded(s), F.lit(TERM_WORD), F.lit(0))
    head, tail = lambda s: F.regexp_replace(s, r"^[\p{L}\p{N}]+", ""), lambda s: F.regexp_replace(s, r"[\p{L}\p{N}]+\z", "")
    before = tail(F.substring(text, F.greatest(F.lit(1), span["start"] - WINDOW_CHARS), F.least(F.lit(WINDOW_CHARS + 1), span["start"]) + 1))
    before = word(F.when(span["start"] > WINDOW_CHARS, head(before)).otherwise(before))
    after = head(F.substring(text, span["end"], F.lit(WINDOW_CHARS + 2)))
    after = word(F.when(F.length(text) - span["end"] > WINDOW_CHARS, tail(after)).otherwise(after))
    return F.concat(F.slice(before, F.greatest(F.lit(1), F.size(before) - WINDOW_WORDS + 1), F.lit(WINDOW_WORDS)), F.slice(after, F.lit(1), F.lit(WINDOW_WORDS)))


def _entity() -> Column:
    """The value of a span of the row's text."""
    return F.lower(F.substring(F.col("text"), F.col("span.start") + 1, F.col("span.end") - F.col("span.start")))


def _terms_of(text: str) -> Column:
    """The different words of a text that can be terms."""
    return F.array_distinct(F.regexp_extract_all(_folded(F.col(text)), F.lit(TERM_WORD), F.lit(0)))


def revealing_terms(texts: DataFrame, held: DataFrame) -> DataFrame | None:
    """entity, term and degree of disclosure over a corpus; None if no term has the evidence.

    texts has all texts (column text), held those with spans (text, print, spans), written once.
    """
    near = held.select("print", "text", F.explode("spans").alias("span"))
    near = near.select("print", _entity().alias("entity"), F.array_distinct(_words_near(F.col("text"), F.col("span"))).alias("terms"))
    near = cut(near.select("print", "entity", F.xxhash64("terms").alias("window"), F.explode_outer("terms").alias("term")).distinct(), "windows")
    n = texts.where(F.col("text").isNotNull()).select(F.xxhash64("text")).distinct().count()
    degree = _degree(n)
    entities = near.groupBy("entity").agg(F.count_distinct("print").alias("own"))
    pairs = near.where(F.col("term").isNotNull()).groupBy("entity", "term").agg(F.count_distinct("print").alias("joint"), F.count_distinct("window").alias("windows")).where(F.col("windows") >= LEAST_WINDOWS)
    pairs = cut(pairs.join(entities, "entity").select("entity", "term", "joint", "own"), "pairs")

    def counted(found: DataFrame, prints: Column, candidates: DataFrame) -> DataFrame:
        terms = candidates.select("term").distinct()
        few = terms.count() <= BROADCAST_ROWS
        words = found.select(prints.alias("print"), F.explode(_terms_of("text")).alias("term"))
        by_term = words.join(F.broadcast(terms) if few else terms, "term").groupBy("term").agg(F.count_distinct("print").alias("texts"))
        return candidates.join(by_term, "term").withColumn("degree", degree).where(F.col("degree") >= GENERALISE)

    # Disclosure falls as a term gets more frequent: terms that are too frequent in the texts with spans alone needn't be counted over all.
    likely = cut(counted(held, F.col("print"), pairs).select("entity", "term", "joint", "own"), "likely-pairs")
    if likely.isEmpty():
        return None
    terms = cut(counted(texts, F.xxhash64("text"), likely).select("entity", "term", "degree"), "terms")
    discard(near, pairs, likely)
    return terms


def _degree(n: int) -> Column:
    """Mutual information of entity and term as a share of the entity's information, over the texts of n that hold both near (joint), the entity (own) and the term (texts)."""
    share = lambda c: F.col(c) / F.lit(float(max(n, 1)))
    return F.log2(share("joint") / (share("texts") * share("own"))) / F.greatest(-F.log2(share("own")), F.lit(1e-9))


def find(docs: DataFrame, spans: str) -> DataFrame:
    """The rows of docs with a column ``spans``: base spans and, after them in kind, the terms that reveal an entity of the same text.

    Null and empty texts have no spans; repeated rows have equal spans; null ids and
    extra columns, whatever their names, are kept as they are; an empty table gives no rows.
    """
    rows = docs.withColumn(spans, base_spans("text"))
    texts = slim(docs, "text")
    held = cut(texts.withColumn("spans", base_spans("text")).where(F.size("spans") > 0).select(F.xxhash64("text").alias("print"), "text", "spans"), "texts-with-spans")
    terms = revealing_terms(texts, held)
    if terms is None:
        return rows
    own = held.select("print", "text", F.explode("spans").alias("span")).select("print", _entity().alias("entity")).distinct()
    own = own.join(terms, "entity").groupBy("print", "term").agg(F.max("degree").alias("degree"))
    listed = lambda these: F.sort_array(F.collect_set(F.when(these, F.col("term"))))
    own = cut(own.groupBy("print").agg(listed(F.col("degree") < REMOVE).alias("terms"), listed(F.col("degree") >= REMOVE).alias("revealing")), "terms-of-texts")
    few = own.agg(F.coalesce(F.sum(F.size("terms") + F.size("revealing")), F.lit(0)).alias("n")).first().n <= BROADCAST_ROWS  # words, each within a window
    name = free_name(rows, "found")
    own = own.select(F.col("print").alias(name), F.struct("terms", "revealing").alias(name + "_terms"))
    joined = rows.join(F.broadcast(own) if few else own, F.xxhash64("text") == F.col(name), "left")
    terms_of = lambda which: F.col(name + "_terms")[which]

    def places(terms: Column, kind: int) -> Column:
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(terms, "|"), F.lit(r")(?![\p{L}\p{N}])"))
        return F.when(F.size(terms) > 0, _places(_folded(F.col("text")), pattern, kind)).otherwise(F.array().cast(_SPAN))

    base = F.col(spans)
    extra = F.filter(F.concat(places(terms_of("terms"), TERM), places(terms_of("revealing"), REVEALING)), lambda t: ~F.exists(base, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return joined.withColumn(spans, F.when(F.col(name).isNull(), base).otherwise(F.array_sort(F.concat(base, extra)))).drop(name, name + "_terms")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(names[s["kind"]], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts by kind, digest of the base spans and the list of all spans, a row per document."""
    found = find(slim(docs, "doc_id", "text"), "spans")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < TERM)
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, remove: bool = False) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans are one.

    With remove, terms that reveal almost everything (a degree of REMOVE or more) are
    deleted; without it they get the placeholder of the others.
    All columns stay; n_chars, where there is one, is the new length. All rows stay:
    null and empty texts, rows without an id and repeated rows, alike ones alike; an empty
    table gives no rows.
    """
    spans = free_name(docs, "spans")
    found = find(docs, spans)
    names = F.array(*[F.lit("" if remove and k == REVEALING else f"[{name.upper()}]") for k, name in enumerate(KINDS)])
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("end"), F.array().cast("array<string>").alias("out"))

    def add(state: Column, s: Column) -> Column:
        inside = s["start"] < state["at"]
        piece = F.array(F.substring(text, state["at"] + 1, s["start"] - state["at"]), names[s["kind"]])
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"), F.lit(-1).alias("end"),
            F.when(inside, state["out"]).otherwise(F.concat(state["out"], piece)).alias("out"),
        )

    whole = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text)))
    new = F.when(F.size(spans) > 0, F.aggregate(spans, start, add, whole)).otherwise(text)
    out = found.withColumn("text", new).drop(spans)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNull(), None).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_pii(spark, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))
