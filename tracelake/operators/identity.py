"""Traces of a known identity (account, host, author names) in file names and text."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake import fixed
from tracelake.functions import paths
from tracelake.session import stored

#: Terms that are put into the plan; bits of the filter over the anchors of more.
FEW_TERMS, FILTER_BITS = 10_000, 1 << 20
WORD = r"(?U)\w+"
TERM_TYPE = "array<struct<term:string,category:string,pattern:string,anchor:string>>"


def identity_terms(raw: DataFrame) -> DataFrame:
    """IDT-1: trimmed terms of three or more characters, minus generic words; the last category wins.

    Input: term, category, position. Spelling variants of one term count as one.
    """
    clean = (raw.withColumn("term", F.trim("term"))
             .filter((F.length("term") >= 3) & ~F.lower("term").isin(fixed.GENERIC_IDENTITY_TERMS)))
    latest = Window.partitionBy(F.lower("term")).orderBy(F.desc("position"))
    first = F.min_by("term", "position")
    spelled = clean.groupBy(F.lower("term").alias("key")).agg(first.alias("shown"))
    kept = clean.withColumn("rank", F.row_number().over(latest)).filter("rank = 1")
    return (kept.withColumn("key", F.lower("term")).join(spelled, "key")
            .select(F.col("shown").alias("term"), "category", "position"))


def prepared_terms(terms: DataFrame) -> DataFrame:
    """Add the pattern of a term and its anchor: a word that must stand alone in any matching text.

    A whole-word term has its longest word as anchor. An address-like term (with @ or .) may sit inside
    longer words, so only its inner words are certain; it has no anchor when there are none.
    """
    literal = paths.any_of([F.col("term").contains("@"), F.col("term").contains(".")])
    quoted = F.regexp_replace("term", r"([\\\[\](){}.*+?^$|])", r"\\$1")
    words = F.regexp_extract_all(F.lower("term"), F.lit(WORD), F.lit(0))
    inner = F.when(F.size(words) > 2, F.slice(words, 2, F.size(words) - 2)).otherwise(F.array().cast("array<string>"))
    # \b only anchors next to a word character; elsewhere the edge word may run on.
    edged = F.col("term").rlike(r"(?U)^\w") & F.col("term").rlike(r"(?U)\w$")
    usable = F.when(literal | ~edged, inner).otherwise(words)
    longest = F.element_at(F.array_sort(F.transform(usable, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)
    return terms.select(
        "term", "category",
        F.concat(F.lit("(?iuU)"), F.when(literal, quoted).otherwise(
            F.concat(F.lit(r"\b"), quoted, F.lit(r"\b")))).alias("pattern"),
        F.when(F.size(usable) > 0, longest["w"]).alias("anchor"))


def content(path: Column, text: Column, max_text_bytes: int | None) -> Column:
    """File name, newline, text. Text over the byte gate is left out whole, never cut."""
    body = F.coalesce(text, F.lit(""))
    if max_text_bytes is not None:
        body = F.when(F.octet_length(body) <= max_text_bytes, body).otherwise(F.lit(""))
    return F.concat(paths.base_name(path), F.lit("\n"), body)


def identity_struct(hits: Column) -> Column:
    """Build the result from an array of (term, category, n), in dictionary order."""
    shown = F.transform(hits, lambda h: F.struct(
        h["term"].alias("term"),
        F.concat(h["category"], F.lit(" ("), h["n"].cast("string"), F.lit("x)")).alias("label")))
    total = F.aggregate(hits, F.lit(0), lambda acc, h: acc + h["n"])
    return F.struct(
        (F.size(hits) > 0).alias("has_identity_trace"), total.alias("total_mentions"),
        F.map_from_entries(shown).alias("matched_terms"),
        F.array_join(F.transform(shown, lambda s: F.concat(s["label"], F.lit(": "), s["term"])), ", ").alias("summary"))


def with_identity(docs: DataFrame, terms: DataFrame, path: str = "path", text: str = "text", out: str = "identity",
                  max_text_bytes: int | None = None, few: int = FEW_TERMS) -> DataFrame:
    """IDT-2: count every term in every document, in the row that owns the text.

    Up to `few` terms (names of one audit's people, accounts and hosts) travel inside the expression as a map from
    anchor to terms: the words of the document are intersected with the anchors and only terms whose anchor occurs
    are counted. Of more terms those are taken whose anchor stands in any text at all; only if these are more than `few`
    too, texts and terms meet in a join (`identity_by_join`), which gives the same rows.
    """
    body = paths.settled(docs, "__body", content(F.col(path), F.col(text), max_text_bytes))
    ready = prepared_terms(terms).limit(few + 1).collect()
    if len(ready) > few:
        ready = occurring(body, prepared_terms(terms)).limit(few + 1).collect()
    if len(ready) > few:
        return identity_by_join(docs, terms, path, text, out, max_text_bytes)
    known_terms: dict[str, list[dict]] = {}
    for row in ready:
        known_terms.setdefault(row["anchor"] or "", []).append(row.asDict())
    known = F.from_json(F.lit(json.dumps(known_terms)), f"map<string,{TERM_TYPE}>")
    words = F.regexp_extract_all(F.lower("__body"), F.lit(WORD), F.lit(0))
    # "" holds the terms without an anchor; they are tried on every document
    anchors = F.concat(F.array_intersect(words, F.map_keys(known)), F.array(F.lit("")))
    possible = F.flatten(F.array_compact(F.transform(anchors, lambda a: F.try_element_at(known, a))))
    return counted(body, possible, out)


def counted(body: DataFrame, possible: Column, out: str) -> DataFrame:
    """The identity of rows with the text in __body, from the terms that may occur there."""
    found = F.transform(possible, lambda t: F.struct(
        F.lower(t["term"]).alias("order"), t["term"].alias("term"), t["category"].alias("category"),
        F.regexp_count(F.col("__body"), t["pattern"]).alias("n")))
    hits = F.array_sort(F.filter(found, lambda h: h["n"] > 0))
    return (paths.settled(body, "__hits", hits).withColumn(out, identity_struct(F.col("__hits")))
            .drop("__body", "__hits"))


def word_filter(words: DataFrame, name: str) -> Callable[[Column], Column]:
    """A Bloom filter of one hash over a column of words, FILTER_BITS bits whatever their number: a test that lets
    all of them through, and few others."""
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(FILTER_BITS))
    bits = (words.select(slot(F.col(name)).alias("slot")).groupBy(F.expr("slot div 64").cast("int").alias("part"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).collect())
    flags = [0] * (FILTER_BITS // 64)
    for part, value in bits:
        flags[part] = value
    table = F.from_json(F.lit(json.dumps(flags)), "array<long>")

    def may_hold(word: Column) -> Column:
        place = slot(word)
        part = F.get(table, F.floor(place / 64).cast("int"))
        return F.call_function("shiftright", part, (place % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

    return may_hold


def filtered_words(anchored: DataFrame) -> Column:
    """The distinct words of a row's text that are likely anchors."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("__body"), F.lit(WORD), F.lit(0)))
    return F.filter(words, word_filter(anchored, "anchor"))


def occurring(body: DataFrame, ready: DataFrame) -> DataFrame:
    """The terms that may be found in the texts: those without an anchor, and those whose anchor is a word of any text. Only
    distinct words move."""
    anchored = ready.filter("anchor is not null")
    seen = body.select(F.explode(filtered_words(anchored)).alias("anchor")).distinct()
    return anchored.join(seen, "anchor", "left_semi").unionByName(ready.filter("anchor is null"))


def identity_by_join(docs: DataFrame, terms: DataFrame, path: str = "path", text: str = "text", out: str = "identity",
                     max_text_bytes: int | None = None) -> DataFrame:
    """JN-11: candidates by equi join, gathered to one list a row, then counted in the row that owns the text.

    Terms with an anchor meet the words of a document, of which a filter lets only likely anchors leave their row. The other
    terms meet the three-character pieces of a document that begin like one of them (no term is shorter). Rows are told
    apart by a number of their own, so repeated keys stay apart; the numbered rows are stored once, and texts move once.
    """
    ready = prepared_terms(terms)
    body = stored(paths.settled(docs, "__body", content(F.col(path), F.col(text), max_text_bytes))
                  .withColumn("__row", F.monotonically_increasing_id()))
    anchored = ready.filter("anchor is not null")
    tokens = body.select("__row", F.explode(filtered_words(anchored)).alias("anchor"))
    pairs = tokens.join(anchored, "anchor").select("__row", "term", "category", "pattern")
    loose = ready.filter("anchor is null").withColumn("piece", F.lower(F.substring("term", 1, 3)))
    # the first characters are bounded by the alphabet
    first = [f"\\x{{{ord(r.c):x}}}" for r in loose.select(F.substring("piece", 1, 1).alias("c")).distinct().collect()]
    if first:
        pieces = F.array_distinct(F.regexp_extract_all(F.lower("__body"), F.lit(f"(?s)(?=([{''.join(first)}]..))"), F.lit(1)))
        near = body.select("__row", F.explode(F.filter(pieces, word_filter(loose, "piece"))).alias("piece")).join(loose, "piece")
        pairs = pairs.unionByName(near.select("__row", "term", "category", "pattern"))
    lists = pairs.groupBy("__row").agg(F.collect_list(F.struct("term", "category", "pattern")).alias("__terms"))
    met = body.join(lists, "__row", "left")
    none = F.array().cast("array<struct<term:string,category:string,pattern:string>>")
    return counted(met, F.coalesce("__terms", none), out).drop("__row", "__terms")


def repaired(identity: Column) -> Column:
    """IDT-3: drop retired profile-directory terms and re-sum from the "(Nx)" suffix."""
    retired = F.map_filter(identity["matched_terms"], lambda _, v: F.lower(v).startswith("user profile directory"))
    kept = F.map_filter(identity["matched_terms"], lambda _, v: ~F.lower(v).startswith("user profile directory"))
    total = F.aggregate(
        F.map_values(kept), F.lit(0),
        lambda acc, v: acc + F.coalesce(F.regexp_extract(v, r"\((\d+)x\)$", 1).try_cast("int"), F.lit(1)))
    summary = F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["value"], F.lit(": "), e["key"])), ", ")
    rebuilt = F.struct((total > 0).alias("has_identity_trace"), total.alias("total_mentions"),
                       kept.alias("matched_terms"), summary.alias("summary"))
    return F.when(F.coalesce(F.size(retired), F.lit(0)) > 0, rebuilt).otherwise(identity)
