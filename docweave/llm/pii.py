"""Personal data: pattern findings, and terms of the corpus that reveal them.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Their entities are then protected against terms
that give them away: over the whole corpus, every word of every text that holds an entity is followed up by how often the
two share a text. ``log2(p(entity | term) / p(entity))`` is the information the term discloses about the entity; terms whose
disclosure and confidence exceed the thresholds, with enough independent witnesses, are generalised wherever they occur.
Witnesses are groups of near copies: texts that agree in a band of min-hashes of their four-word shingles are one.

Everything is expressed with built-in functions. Texts are searched whole; the patterns have no ambiguous repetition
(possessive, and anchored where a run begins), so their time follows the text's length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import materialise, small_enough

LOCAL = "A-Za-z0-9._%+-"
# kind: (pattern, cheap necessary condition)
BASE = {
    "email": (rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@")),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", lambda t: t.contains(".")),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike("[0-9]")),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+")),
}
IP_PARTS = r"^(?:0*(?:[1-9]?[0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
WORD = r"[\p{L}][\p{L}\p{N}'-]*"
SPAN = "struct<start:bigint,end:bigint,value:string>"


@dataclass(frozen=True)
class Params:
    witnesses: int = 5  # groups of near copies among the texts that hold both, at least
    bands: int = 20  # texts of similarity 0.8 agree in one of 20 bands of 6 with a chance of 0.998, of 0.3 with 0.015
    rows: int = 6
    bits: float = 4.0
    confidence: float = 0.9
    broadcast_rows: int = 200_000


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


PART = 512


def _folded(items: Column, state: Column, of: str, step) -> Column:
    """An array of one ``of`` for each item: ``step(state, item)`` gives the struct (state, made), from ``state`` on.

    Items are folded in parts of 512, so that appending to an array costs no more than a part, whatever their number.
    """

    def add(acc: Column, x: Column) -> Column:
        def both(s: Column) -> Column:
            return F.struct(s["state"].alias("state"), F.concat(acc["out"], F.array(s["made"])).alias("out"))

        return F.transform(F.array(step(acc["state"], x)), both)[0]

    def part(acc: Column, i: Column) -> Column:
        start = F.struct(F.element_at(acc, -1)["state"].alias("state"), F.array().cast(f"array<{of}>").alias("out"))
        return F.concat(acc, F.array(F.aggregate(F.slice(items, i * PART + 1, F.lit(PART)), start, add)))

    first = F.array(F.struct(state.alias("state"), F.array().cast(f"array<{of}>").alias("out")))
    parts = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PART).cast("int")), first, part)
    return F.when(F.size(items) > 0, F.flatten(F.transform(parts, lambda x: x["out"]))).otherwise(F.array().cast(f"array<{of}>"))


def _matches(text: Column, pattern: Column, found: Column) -> Column:
    """The matches ``found`` with code point bounds: the gaps between matches and the matches' lengths add up to them."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("value"))
    sized = F.transform(pieces, lambda x: F.struct(F.length(x["gap"]).alias("gap"), x["value"].alias("value")))

    def step(at: Column, x: Column) -> Column:
        begin = at + x["gap"]
        end = begin + F.coalesce(F.length(x["value"]), F.lit(0))
        return F.struct(end.cast("long").alias("state"), F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"), x["value"].alias("value")).alias("made"))

    # The last gap has no match after it.
    return F.when(F.size(found) > 0, F.slice(_folded(sized, F.lit(0).cast("long"), SPAN, step), F.lit(1), F.size(found))).otherwise(_none())


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = F.reverse(_digits(value))
    place = F.sequence(F.lit(0), F.length(d) - 1)
    digit = F.transform(place, lambda i: F.substr(d, i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(digit, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), total % 10 == 0).otherwise(False)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(IP_PARTS),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def _valid(kind: str):
    return lambda x: VALID[kind](x["value"])


def _named(kinds: list[str], make) -> Column:
    """All spans of the kinds, in order, each as ``make(kind, place of the kind, span)``."""

    def of(i: int, kind: str) -> Column:
        return F.transform(f"pii_{kind}", lambda x: make(kind, i, x))

    return F.concat(*(of(i, k) for i, k in enumerate(kinds)))


def find_base(docs: DataFrame) -> DataFrame:
    """``docs`` with one array of spans (start, end, value) per kind: columns pii_email, pii_ip, pii_card, pii_phone."""
    text = F.coalesce(F.col("text"), F.lit(""))
    no_match = F.array().cast("array<string>")
    out = docs.withColumns({f"pii_{k}": F.when(needed(text), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(no_match) for k, (pattern, needed) in BASE.items()})
    return out.withColumns({f"pii_{k}": F.filter(_matches(text, F.lit(pattern), F.col(f"pii_{k}")), _valid(k)) for k, (pattern, _) in BASE.items()})


def _masked(text: Column, kinds: list[str], label) -> Column:
    """The text with its findings replaced by ``label(kind)``; overlapping findings become the first's."""
    spans = F.array_sort(_named(kinds, lambda k, i, x: F.struct(x["start"].alias("start"), F.lit(i).alias("order"), x["end"].alias("end"), F.lit(label(k)).alias("label"))))

    def step(at: Column, x: Column) -> Column:
        gap = F.substr(text, (at + 1).cast("int"), (x["start"] - at).cast("int"))
        made = F.when(x["start"] >= at, F.concat(gap, x["label"])).otherwise(F.lit(""))
        return F.struct(F.greatest(at, x["end"]).alias("state"), made.alias("made"))

    parts = F.array_join(_folded(spans, F.lit(0).cast("long"), "string", step), "")
    end = F.array_max(F.transform(spans, lambda x: x["end"]))
    return F.when(F.size(spans) > 0, F.concat(parts, F.substr(text, (end + 1).cast("int"), F.lit(2**31 - 1)))).otherwise(text)


def _groups(texts: DataFrame, p: Params) -> DataFrame:
    """(key, group) of texts (key, rest): near copies, directly or through others, have one group."""
    words = F.filter(F.split(F.lower("rest"), r"\s+"), lambda w: w != "")
    w = texts.select("key", words.alias("w")).where(F.size("w") > 0)
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 3)), lambda i: F.xxhash64(F.slice("w", i, 4)))
    w = materialise(w.select("key", F.array_distinct(shingles).alias("s")), "shingles")

    def band(b: int) -> Column:
        return F.xxhash64(F.lit(b), *(F.array_min(F.transform("s", lambda x, i=i: F.xxhash64(x, F.lit(i)))) for i in range(b * p.rows, (b + 1) * p.rows)))

    each = materialise(w.select("key", F.explode(F.array(*(band(b) for b in range(p.bands)))).alias("band")), "bands")
    least = each.groupBy("band").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("band", "first")
    edges = materialise(each.join(least, "band").where("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b")).distinct(), "copies")
    keys = texts.select("key")
    if edges.isEmpty():
        return keys.select("key", F.col("key").alias("group"))
    found = components(edges, arrow=False)
    return keys.join(found, F.col("key") == F.col("node"), "left").select("key", F.coalesce("component", "key").alias("group"))


def _vocabulary(docs: DataFrame, terms: DataFrame, p: Params) -> DataFrame:
    """(key, term): which of ``terms`` each distinct text holds; key is the text's hash."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
    each = docs.where("text is not null").select(F.xxhash64("text").alias("key"), F.explode(words).alias("term"))
    side = F.broadcast(terms) if small_enough(terms, p.broadcast_rows) else terms
    return each.join(side, "term").select("key", "term").distinct()


def _term_counts(docs: DataFrame, terms: DataFrame, p: Params) -> DataFrame:
    """(term, n_t): the number of distinct texts with each of ``terms``. Only texts that occur twice are dealt out by text and term."""
    side = F.broadcast(terms) if small_enough(terms, p.broadcast_rows) else terms
    rows = docs.where("text is not null").select("text", F.xxhash64("text").alias("key"))
    twice = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "twice")
    twice = F.broadcast(twice) if small_enough(twice, p.broadcast_rows) else twice
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("term")
    once = rows.join(twice, "key", "left_anti").select(words).join(side, "term").groupBy("term").agg(F.count("*").alias("n"))
    more = rows.join(twice, "key", "left_semi").select("key", words).join(side, "term").select("key", "term").distinct().groupBy("term").agg(F.count("*").alias("n"))
    return once.unionByName(more).groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosing_terms(docs: DataFrame, found: DataFrame, p: Params = Params()) -> DataFrame:
    """(term, entity, bits, confidence) of the terms that reveal an entity beyond the thresholds."""
    spans = _named(list(BASE), lambda k, _, x: F.concat(F.lit(f"{k}:"), F.lower(x["value"])))
    rest = _masked(F.col("text"), list(BASE), lambda k: " ")
    each = found.where("text is not null").select(F.xxhash64("text").alias("key"), rest.alias("rest"), F.array_distinct(spans).alias("entities"))
    each = materialise(each.dropDuplicates(["key"]), "entities")
    holds = each.select("key", F.explode("entities").alias("entity"))
    often = materialise(holds.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= p.witnesses), "often")
    side = F.broadcast(often) if small_enough(often, p.broadcast_rows) else often
    keys = holds.join(side.select("entity"), "entity", "left_semi").select("key").distinct()
    groups = materialise(_groups(materialise(each.join(keys, "key", "left_semi").select("key", "rest"), "candidates"), p), "groups")
    holds = holds.join(side.select("entity"), "entity", "left_semi").join(groups, "key")
    of_entity = holds.groupBy("entity").agg(F.count("*").alias("n_e"), F.countDistinct("group").alias("n_g")).where(F.col("n_g") >= p.witnesses).select("entity", "n_e")
    of_entity = materialise(of_entity, "witnessed")
    side = F.broadcast(of_entity) if small_enough(of_entity, p.broadcast_rows) else of_entity
    words = each.select("key", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("rest"), F.lit(WORD), F.lit(0)))).alias("term"))
    both = holds.join(side.select("entity"), "entity", "left_semi").join(words, "key")
    # Equal rows of a group are added up before they are dealt out by entity and term.
    both = both.groupBy("entity", "term", "group").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count("*").alias("n_g"))
    pairs = materialise(both.where(F.col("n_g") >= p.witnesses).select("entity", "term", "n_te"), "pairs")
    if pairs.isEmpty():
        return pairs.select("term", "entity", F.lit(0.0).alias("bits"), F.lit(0.0).alias("confidence"))
    where = materialise(_term_counts(docs, pairs.select("term").distinct(), p), "vocabulary")
    n = docs.where("text is not null").select(F.xxhash64("text").alias("key")).distinct().count()
    scored = pairs.join(where, "term").join(side, "entity")
    confidence = F.col("n_te") / F.col("n_t")
    scored = scored.select("term", "entity", F.log2(confidence / (F.col("n_e") / F.lit(float(n)))).alias("bits"), confidence.alias("confidence"))
    return materialise(scored.where((F.col("bits") >= p.bits) & (F.col("confidence") >= p.confidence)), "disclosing")


def find(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` with the base arrays and pii_term, the spans of disclosing terms. Null texts count as empty.

    Columns pii_email, pii_ip, pii_card, pii_phone and pii_term are replaced; others may have any name that doesn't begin with
    two underscores. Equal texts count once for the corpus statistics. An empty table gives no rows.
    """
    found = find_base(docs)
    kept = materialise(found.where(F.size(F.concat(*(F.col(f"pii_{k}") for k in BASE))) > 0).select("text", *(f"pii_{k}" for k in BASE)), "findings")
    terms = disclosing_terms(docs, kept, p)
    if terms.isEmpty():
        return found.withColumn("pii_term", _none())
    of_text = materialise(_vocabulary(docs, terms.select("term").distinct(), p).groupBy(F.col("key").alias("__key")).agg(F.collect_set("term").alias("__terms")), "terms")
    of_text = F.broadcast(of_text) if small_enough(of_text, p.broadcast_rows) else of_text
    joined = found.join(of_text, F.xxhash64("text") == F.col("__key"), "left").drop("__key")
    names = F.array_join(F.transform(F.array_sort("__terms"), lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), "|")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}'-])(?:"), names, F.lit(r")(?![\p{L}\p{N}'-])"))
    text = F.coalesce("text", F.lit(""))
    joined = joined.withColumn("__pattern", F.when(F.col("__terms").isNotNull(), pattern))
    joined = joined.withColumn("__found", F.when(F.col("__pattern").isNotNull(), F.regexp_extract_all(text, F.col("__pattern"), F.lit(0))).otherwise(F.array().cast("array<string>")))
    return joined.withColumn("pii_term", _matches(text, F.col("__pattern"), F.col("__found"))).drop("__terms", "__pattern", "__found")


KINDS = [*BASE, "term"]


def sanitise(found: DataFrame) -> DataFrame:
    """The rows of ``find`` with findings replaced by their kind in brackets; overlapping findings become the first's kind."""
    return found.withColumn("text", _masked(F.col("text"), KINDS, lambda k: f"[{k.upper()}]")).drop(*(f"pii_{k}" for k in KINDS))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of the rows of ``find``."""

    def said(kinds: list[str]) -> Column:
        return F.array_join(_named(kinds, lambda k, _, x: F.concat(F.lit(f"{k}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")

    counts = [F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(said(list(BASE)).cast("binary"), 256).alias("base_sha256"), said(KINDS).alias("spans"))
