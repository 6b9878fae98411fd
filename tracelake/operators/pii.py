"""Personal data in text. One array expression per kind, folded in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake import fixed
from tracelake.functions import checks
from tracelake.functions.paths import settled

MATCH_TYPE = "array<struct<category:string,sample:string,confidence:double>>"
PII_TYPE = f"struct<status:string,total_matches:int,categories:array<string>,matches:{MATCH_TYPE}>"


# A text without these cannot hold an accepted match of the kind, so its full pattern need not run. They are plain
# substring or ASCII class searches, several times cheaper than the Unicode patterns.
POSSIBLE = {
    "CardRun": lambda t: t.rlike("[0-9]{13}"), "CardGroups": lambda t: t.rlike("[0-9]{4}[ -][0-9]{4}"),
    "INN": lambda t: t.rlike("[0-9]{10}"), "SNILS": lambda t: t.rlike("[0-9]{3}"),
    "Passport": lambda t: t.rlike("[0-9]{6}"), "Email": lambda t: t.contains("@"),
    "Phone": lambda t: t.contains("+") | t.contains("8"), "FIO": lambda t: t.contains("ич") | t.contains("вна"),
    "Telegram": lambda t: t.contains("://"), "IP": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "MAC": lambda t: t.rlike("[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]"), "Address": lambda t: t.rlike("[А-Яа-я]"),
}


def found(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Every match of a Unicode-aware pattern over the whole text."""
    flags = "(?iuU)" if ignore_case else "(?U)"
    matches = F.regexp_extract_all(text, F.lit(flags + fixed.PII_PATTERNS[pattern]), F.lit(0))
    return F.when(POSSIBLE[pattern](text), matches).otherwise(F.array().cast("array<string>"))


def trimmed(value: Column) -> Column:
    """Trim every kind of white space, line ends included."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\D", "")


def cards(text: Column) -> Column:
    """PII-1: runs first, then groups of four."""
    numbers = F.transform(F.concat(found(text, "CardRun"), found(text, "CardGroups")), digits)
    good = F.filter(numbers, lambda n: F.length(n).between(13, 19) & checks.card_plausible(n) & checks.luhn_ok(n))
    return F.transform(good, checks.mask_card)


def inns(text: Column) -> Column:
    """PII-2."""
    return F.filter(found(text, "INN"), checks.inn_ok)


def snils(text: Column) -> Column:
    """PII-3."""
    good = F.filter(F.transform(found(text, "SNILS"), digits), checks.snils_ok)
    return F.transform(good, lambda n: F.concat(
        F.substring(n, 1, 3), F.lit("-"), F.substring(n, 4, 3), F.lit("-"),
        F.substring(n, 7, 3), F.lit(" "), F.substring(n, 10, 2)))


def passports(text: Column) -> Column:
    """PII-4: region series 01 to 99."""
    good = F.filter(F.transform(found(text, "Passport"), digits), lambda n: n.rlike("^(?!00)[0-9]{10}$"))
    return F.transform(good, lambda n: F.concat(F.substring(n, 1, 2), F.lit(" "), F.substring(n, 3, 2),
                                                F.lit(" ******")))


ADDRESS_RUN = r"(?U)[\w.%+@-]++"
NAME_CHARACTERS = "A-Za-z0-9._%+-"
DOMAIN = r"^[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"


def emails(text: Column) -> Column:
    """PII-5: the matches of the e-mail pattern, found from each @ outwards in time linear in the text.

    Runs of the pattern's characters and other word characters that hold an @ are cut at it. To the left of an @ the
    name is the longest stretch of name characters that begins at the edge of a word and after the match before it;
    the domain is matched at the start of what follows.
    """
    def name_before(left: Column, cut: Column) -> Column:
        tail = F.regexp_replace(left, f"(?s)^.*[^{NAME_CHARACTERS}]", "")
        after_word = cut | (F.length(tail) < F.length(left))
        word_first = tail.rlike("^[A-Za-z0-9_]")
        return (F.when(after_word & word_first, F.regexp_replace(tail, "^[A-Za-z0-9_]++", ""))
                .when(~after_word & ~word_first, F.regexp_replace(tail, "^[.%+-]++", "")).otherwise(tail))

    def step(state: Column, right: Column) -> Column:
        name, domain = name_before(state["left"], state["cut"]), F.regexp_extract(right, DOMAIN, 0)
        hit = (name != "") & (domain != "")
        return F.struct(
            F.when(hit, F.substring(right, F.length(domain) + 1, F.length(right))).otherwise(right).alias("left"),
            hit.alias("cut"),
            F.when(hit, F.concat(state["found"], F.array(F.concat(name, F.lit("@"), domain)))).otherwise(state["found"])
            .alias("found"))

    def in_run(run: Column) -> Column:
        parts = F.split(run, "@")
        start = F.struct(F.get(parts, 0).alias("left"), F.lit(False).alias("cut"),
                         F.array().cast("array<string>").alias("found"))
        return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, step)["found"]

    runs = F.filter(F.regexp_extract_all(text, F.lit(ADDRESS_RUN), F.lit(0)), lambda r: r.contains("@"))
    found_ = F.flatten(F.transform(runs, in_run))
    return F.when(POSSIBLE["Email"](text), found_).otherwise(F.array().cast("array<string>"))


def phones(text: Column) -> Column:
    """PII-6."""
    good = F.filter(found(text, "Phone"), lambda m: F.length(digits(m)).between(10, 15))
    return F.transform(good, trimmed)


def full_names(text: Column) -> Column:
    """PII-7."""
    return F.transform(found(text, "FIO"), trimmed)


def telegram_links(text: Column) -> Column:
    """PII-8."""
    good = F.filter(found(text, "Telegram", ignore_case=True), lambda m: ~F.lower(m).contains("example"))
    return F.transform(good, trimmed)


def ipv4(text: Column) -> Column:
    """PII-9."""
    return F.filter(found(text, "IP"), checks.ipv4_plausible)


def macs(text: Column) -> Column:
    """PII-10."""
    return found(text, "MAC")


def addresses(text: Column) -> Column:
    """PII-11."""
    return F.transform(found(text, "Address", ignore_case=True), trimmed)


KINDS = {
    "BankCard": cards, "INN": inns, "SNILS": snils, "Passport": passports, "Email": emails, "Phone": phones,
    "FIO": full_names, "Telegram": telegram_links, "IP": ipv4, "MAC": macs, "Address": addresses,
}


def kind_matches(text: Column, kind: str) -> Column:
    return F.transform(KINDS[kind](text), lambda s: F.struct(
        F.lit(kind).alias("category"), s.alias("sample"), F.lit(fixed.PII_CONFIDENCE[kind]).alias("confidence")))


def fold_blocks(blocks: Column, cap: int | None) -> Column:
    """PII-13: one running total; a kind that starts at the cap still keeps its first match."""
    if cap is None:
        return F.flatten(blocks)
    return F.aggregate(
        blocks, F.array().cast(MATCH_TYPE),
        lambda kept, block: F.concat(kept, F.slice(block, 1, F.greatest(F.lit(1), F.lit(cap) - F.size(kept)))))


def categories_of(matches: Column) -> Column:
    """Kinds in order of appearance, then the bundle mark (PII-12)."""
    kinds = F.array_distinct(F.transform(matches, lambda m: m["category"]))
    contact = F.arrays_overlap(kinds, F.array(F.lit("Phone"), F.lit("Email"), F.lit("Passport")))
    bundle = F.array_contains(kinds, "FIO") & contact
    return F.when(bundle, F.array_append(kinds, "PII_Bundle")).otherwise(kinds)


def pii_matches(text: Column, kinds: list[str] | None = None, cap: int | None = None) -> Column:
    """Kept matches of the chosen kinds; evaluate once per row, then wrap with `pii_struct`."""
    blocks = F.array(*[kind_matches(text, kind) for kind in kinds or KINDS])
    return F.when(F.coalesce(text.rlike(r"(?U)\S"), F.lit(False)), fold_blocks(blocks, cap)) \
        .otherwise(F.array().cast(MATCH_TYPE))


def pii_struct(matches: Column) -> Column:
    return F.struct(F.lit("completed").alias("status"), F.size(matches).alias("total_matches"),
                    categories_of(matches).alias("categories"), matches.alias("matches"))


def with_pii(df, text: str = "text", out: str = "pii", kinds: list[str] | None = None,
             cap: int | None = None):
    """Add the `pii` evidence struct; the text patterns run once per row."""
    held = f"__{out}_matches"
    return (settled(df, held, pii_matches(F.col(text), kinds, cap))
            .withColumn(out, pii_struct(F.col(held))).drop(held))


def repaired(pii: Column) -> Column:
    """PII-14: drop the retired BirthDate kind and recompute the total."""
    matches = F.filter(pii["matches"], lambda m: F.lower(m["category"]) != "birthdate")
    kinds = F.filter(pii["categories"], lambda c: F.lower(c) != "birthdate")
    return F.when(pii.isNotNull(), F.struct(
        pii["status"].alias("status"), F.coalesce(F.size(matches), F.lit(0)).alias("total_matches"),
        kinds.alias("categories"), matches.alias("matches")))
