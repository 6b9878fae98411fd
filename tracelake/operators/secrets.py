"""Secrets in text: vendor token formats, named assignments, key blocks and an entropy fallback.

The vendor formats are the public ones. Samples are masked: four characters, then stars.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions import checks
from tracelake.functions.paths import any_of, contains_any, settled

# Public token formats, in order of precedence.
VENDOR_FORMATS = [
    ("OpenAI API key", r"\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}"),
    ("GitHub token", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})"),
    ("AWS access key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("JWT", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("Slack token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("Google API key", r"\bAIza[0-9A-Za-z_-]{35}"),
]
BLOCK_FORMATS = [
    ("Private key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    ("Database connection", r"\b(?:postgres|postgresql|mysql|mongodb|mongodb\+srv|redis|amqp|mssql)://[^\s:@/]+:[^\s@/]+@[^\s\"']+"),
]
# The name ends in a word with a key word in it. A word is consumed whether an assignment follows or not, so every
# character is looked at once; without an assignment the value is empty.
ASSIGNMENT = (
    r"(?i)(?:password|passwd|pwd|secret|token|api_?key|access_?key|private_?key)[A-Za-z0-9_]*+"
    r"(?:[\"']?[ \t]*+[=:][ \t]*+[\"']?([!-~&&[^\"',;]]{8,}+))?"
)
# A name has to begin at the edge of a word, and letters beyond ASCII belong to words: what follows one is no name.
INSIDE_WORD = r"(?U)[\w&&[^\x00-\x7F]][A-Za-z0-9_]++"
CODE_IDENTIFIER = r"^[A-Za-z_][A-Za-z_.]*(?:\(.*)?$"
ENTROPY_TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ENTROPY_BITS = 4.0

MATCH_TYPE = "array<struct<category:string,sample:string>>"
SECRETS_TYPE = f"struct<total_matches:int,categories:array<string>,matches:{MATCH_TYPE}>"


# Fixed substrings of each format: without one of them the pattern need not run.
HINTS = {
    "OpenAI API key": ["sk-"], "GitHub token": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"], "AWS access key": ["AKIA", "ASIA"], "JWT": ["eyJ"],
    "Slack token": ["xox"], "Google API key": ["AIza"], "Private key": ["PRIVATE KEY-----"], "Database connection": ["://"],
}
NAME_HINTS = ["passw", "pwd", "secret", "token", "key"]


def found(text: Column, name: str, pattern: str) -> Column:
    hint = any_of([text.contains(h) for h in HINTS[name]])
    hits = F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return tagged(F.coalesce(hits, F.array().cast("array<string>")), name)


def tagged(values: Column, category: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(category).alias("category"), v.alias("sample")))


def vendor_tokens(text: Column) -> Column:
    """SEC-1."""
    return F.concat(*[found(text, name, p) for name, p in VENDOR_FORMATS])


def assignments(text: Column) -> Column:
    """SEC-2: the value must follow `=` or `:` and must not read like a code identifier."""
    possible = (text.contains("=") | text.contains(":")) & contains_any(text, NAME_HINTS)
    names = F.regexp_replace(text, INSIDE_WORD, "\x01")
    values = F.when(possible, F.regexp_extract_all(names, F.lit(ASSIGNMENT), F.lit(1))).otherwise(
        F.array().cast("array<string>"))
    return tagged(F.filter(values, lambda v: (v != "") & ~v.rlike(CODE_IDENTIFIER) & ~v.startswith("$")), "Named secret")


def blocks(text: Column) -> Column:
    """SEC-3."""
    return F.concat(*[found(text, name, p) for name, p in BLOCK_FORMATS])


def entropy_tokens(text: Column, bits: float = ENTROPY_BITS) -> Column:
    """SEC-4: compact mixed-case tokens with digits, each once."""
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(ENTROPY_TOKEN), F.lit(0)))
    mixed = F.filter(tokens, lambda t: t.rlike("[a-z]") & t.rlike("[A-Z]") & t.rlike("[0-9]"))
    return tagged(F.filter(mixed, lambda t: checks.shannon_entropy(t) >= bits), "High entropy string")


def named_matches(text: Column) -> Column:
    return F.concat(vendor_tokens(text), assignments(text), blocks(text))


def masked(matches: Column) -> Column:
    return F.transform(matches, lambda m: F.struct(
        m["category"].alias("category"), F.concat(F.substring(m["sample"], 1, 4), F.lit("****")).alias("sample")))


def with_secrets(df, text: str = "text", out: str = "secrets", bits: float = ENTROPY_BITS):
    """Add the `secrets` struct: named matches first, then entropy tokens not already named."""
    empty = F.array().cast(MATCH_TYPE)
    t = F.coalesce(F.col(text), F.lit(""))
    named, spare = F.col("__named"), F.col("__spare")
    fresh = F.filter(spare, lambda s: ~F.exists(named, lambda n: n["sample"].contains(s["sample"]) | s["sample"].contains(n["sample"])))
    rows = settled(df, "__named", F.coalesce(F.array_distinct(named_matches(t)), empty))
    return (settled(rows, "__spare", entropy_tokens(t, bits))
            .withColumn("__all", masked(F.concat(named, fresh)))
            .withColumn(out, F.struct(
                F.size("__all").alias("total_matches"),
                F.array_distinct(F.transform("__all", lambda m: m["category"])).alias("categories"),
                F.col("__all").alias("matches")))
            .drop("__named", "__spare", "__all"))
