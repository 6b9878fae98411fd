"""Credential-bearing configuration files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions import paths

# Well-known file names and what they configure.
CONFIG_NAMES = [
    ("NPM registry", [".npmrc"]),
    ("Python package index", ["pip.conf", "pip.ini"]),
    ("NuGet feed", ["nuget.config"]),
    ("Gradle properties", ["gradle.properties"]),
    ("Maven settings", ["settings.xml"]),
    ("Docker Compose", ["docker-compose.yml", "docker-compose.yaml"]),
    ("Kubernetes config", ["kubeconfig"]),
    ("SSH config", ["ssh_config", "sshd_config"]),
    ("Git config", [".gitconfig", ".git-credentials"]),
    ("PostgreSQL password file", [".pgpass"]),
    ("MySQL client config", [".my.cnf"]),
]
VPN_EXTENSIONS = [".ovpn"]
SOURCE_EXTENSIONS = [
    ".py", ".js", ".ts", ".jsx", ".tsx", ".cs", ".java", ".go", ".rb", ".php", ".rs", ".cpp", ".c", ".h", ".hpp",
]
SENSITIVE_PARTS = [
    "password", "passwd", "pwd", "passphrase", "secret", "token", "credential", "credentials",
    "apikey", "api_key", "access_key", "private_key", "auth_token",
]
HARMLESS_PARTS = [
    "rate", "limit", "limits", "enabled", "enable", "ttl", "timeout", "expiry", "expires", "count",
    "max", "min", "length", "feature", "flag",
]
PLACEHOLDERS = [
    "", "changeme", "change_me", "placeholder", "example", "none", "null", "nil", "default", "todo", "undefined",
    "true", "false", "yes", "no", "on", "off",
]
ASSIGNMENT = (
    r"(?m)^[ \t]*(?:export[ \t]+|set[ \t]+)?[\"']?([A-Za-z_/][A-Za-z0-9_./:-]*)[\"']?[ \t]*[:=][ \t]*([^\r\n]*)"
)
ENVIRONMENT_READ = (
    r"(?:os\.getenv|os\.environ(?:\.get|\.setdefault)?|process\.env|system\.getenv|getenv|env)\b"
)
FALLBACK = r"(?i)(?:getenv|environ\.get|setdefault)\([^,()]+,[ \t]*[\"']([^\"']+)[\"']"
ENDPOINT = r"https?://[^\s\"'<>]+"

CONFIG_TYPE = ("struct<is_credential_config:boolean,config_type:string,exposed_parameters:array<string>,"
               "endpoints:array<string>,exposure_level:string>")


def config_type(path: Column | str) -> Column:
    """CFG-1: null when the name is not a known configuration file."""
    name = F.lower(paths.base_name(path))
    kind = F.when(name.startswith(".env"), F.lit("Environment variables"))
    for label, names in CONFIG_NAMES:
        kind = kind.when(name.isin(names), F.lit(label))
    lowered = F.lower(paths.backslashed(path))
    kind = kind.when(lowered.endswith("\\.ssh\\config"), F.lit("SSH config"))
    kind = kind.when(lowered.endswith("\\.git\\config"), F.lit("Git config"))
    return kind.when(paths.extension(path).isin(VPN_EXTENSIONS), F.lit("VPN profile"))


def is_generic_source_config(path: Column | str) -> Column:
    """CFG-4: a source module named config.*"""
    return F.lower(paths.base_name(path)).startswith("config.") & paths.extension(path).isin(SOURCE_EXTENSIONS)


def snake_name(name: Column) -> Column:
    """camelCase, PascalCase, acronyms and punctuation to snake_case."""
    split = F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(F.regexp_replace(split, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def sensitive_name(name: Column) -> Column:
    padded = F.concat(F.lit("_"), snake_name(name), F.lit("_"))
    hot = paths.any_of([padded.contains(f"_{part}_") for part in SENSITIVE_PARTS])
    cold = paths.any_of([padded.contains(f"_{part}_") for part in HARMLESS_PARTS])
    return hot & ~cold


def concrete_value(value: Column) -> Column:
    """The literal a line exposes, or null: environment reads count only through their fallback."""
    bare = F.regexp_replace(F.trim(value), r"^[\"']+|[\"',;]+$", "")
    lowered = F.lower(bare)
    fallback = F.regexp_extract(value, FALLBACK, 1)
    reads = F.lower(value).rlike("^" + ENVIRONMENT_READ)
    reference = bare.rlike(r"^(?:\$\{[A-Za-z0-9_]+\}|\$[A-Z][A-Z0-9_]*|%[A-Za-z0-9_]+%|<[^>]*>)$")
    placeholder = lowered.isin(PLACEHOLDERS) | lowered.rlike(r"^(?:your[_-].*|x+|\*+)$")
    identifier = (F.trim(value) == bare) & bare.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+(?:\(.*)?$")
    return (F.when(reads, F.nullif(fallback, F.lit("")))
            .when(~reference & ~placeholder & ~identifier, bare))


def exposed_parameters(text: Column) -> Column:
    """CFG-2: names whose assignment shows a concrete sensitive value, each once."""
    lines = F.regexp_extract_all(text, F.lit(ASSIGNMENT), F.lit(0))
    pairs = F.transform(lines, lambda m: F.struct(F.regexp_extract(m, ASSIGNMENT, 1).alias("name"),
                                                  F.regexp_extract(m, ASSIGNMENT, 2).alias("value")))
    shown = F.filter(pairs, lambda p: sensitive_name(p["name"]) & concrete_value(p["value"]).isNotNull())
    return F.array_distinct(F.transform(shown, lambda p: p["name"]))


def endpoints(text: Column) -> Column:
    """CFG-3."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ENDPOINT), F.lit(0)))


def with_config(df, path: str = "path", text: str = "text", out: str = "config"):
    t = F.coalesce(F.col(text), F.lit(""))
    exposed = F.col("__exposed")
    known = config_type(path)
    level = (F.when(F.size(exposed) > 0, F.lit("High"))
             .when(known.isNotNull() & (F.size("__endpoints") > 0), F.lit("Medium")).otherwise(F.lit("Low")))
    rows = paths.settled(paths.settled(df, "__exposed", exposed_parameters(t)), "__endpoints", endpoints(t))
    return (rows
            .withColumn(out, F.struct(
                (F.size(exposed) > 0).alias("is_credential_config"),
                F.coalesce(known, F.lit("Configuration")).alias("config_type"),
                exposed.alias("exposed_parameters"), F.col("__endpoints").alias("endpoints"),
                level.alias("exposure_level")))
            .drop("__exposed", "__endpoints"))


def reclassified(df):
    """CFG-4: a generic config module without any exposed value becomes an ordinary file. Rows are
    never removed, and unread files keep the signal of their name. Needs the columns
    path, category, subcategory, config and secrets (null structs when unread)."""
    read = F.col("config").isNotNull()
    clean = (~F.col("config.is_credential_config")
             & (F.coalesce(F.col("secrets.total_matches"), F.lit(0)) == 0))
    downgrade = F.coalesce(is_generic_source_config("path") & read & clean, F.lit(False))
    return (df.withColumn("category", F.when(downgrade, F.lit("Other")).otherwise(F.col("category")))
            .withColumn("subcategory", F.when(downgrade, F.lit("File")).otherwise(F.col("subcategory"))))
