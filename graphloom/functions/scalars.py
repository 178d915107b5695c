"""Scalar expressions: rounding, identifiers, paths, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a path as a test.
TEST_PATH = r"(?i)([._](test|spec)\.[a-z]+$)|(^|/)(test|spec)_[^/]*$|(^|/)(test|tests|__tests__|spec|specs|androidtest|testfixtures|[^/]*\.tests?)/"


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding half up on the double itself, so that both engines give one result."""
    k = 10.0**digits
    return F.floor(x.cast("double") * k + 0.5) / F.lit(k)


def path_of(c: Column) -> Column:
    """Forward slashes and no leading './'."""
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def epoch_seconds(c: Column) -> Column:
    """Commit dates in seconds; values in milliseconds are scaled down."""
    return F.when(c > 100_000_000_000, F.expr("1") * F.floor(c / 1000)).otherwise(c).cast("bigint")


def name_tokens(name: Column) -> Column:
    """Lower-case words of a camelCase or snake_case name, two letters or more, distinct and sorted."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+"), lambda w: F.length(w) >= 2)))


def words(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda w: w != "")


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def directory(path: Column) -> Column:
    """The directory of a path, '' at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_stem(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1))


def capped(x: Column, cap: float, weight: float) -> Column:
    """weight * 100 * min(x / cap, 1)."""
    return F.least(F.coalesce(x, F.lit(0)).cast("double") / F.lit(float(cap)), F.lit(1.0)) * 100 * F.lit(weight)


def band(score: Column, high: float = 66, review: float = 33) -> Column:
    return F.when(score > high, "high").when(score >= review, "review").otherwise("low")


def short_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def exported(signature: Column) -> Column:
    return signature.rlike(r"^export( |$|\n)")


#: Names of functions that start a server, and of those that a program runs.
STARTS_SERVER = ("bootstrap", "startServer", "startApp", "listenOn", "serve", "createServer")
RUNS_PROGRAM = ("main", "run", "execute", "cli", "command", "program")
BOOTS = ("main", "start", "run", "init", "boot", "bootstrap")


def entry_rules(name: Column, kind: Column, path: Column, signature: Column) -> list[tuple[str, str, str, Column]]:
    """(kind of entry point, confidence, reason, condition), in order; the first that holds decides."""
    stem, low, root = file_stem(path), F.lower(name), ~path.contains("/")
    code = kind.isin("function", "const", "method")
    return [
        ("lambda_handler", "high", "a handler that takes an event, a context or a callback", (name == "handler") & code & signature.rlike(r"\b(event|context|callback)\b")),
        ("main_function", "high", "named main", (name == "main") & code),
        ("cli_handler", "high", "named like a command, in a folder of commands", kind.isin("function", "const", "class") & path.rlike(r"(?i)(^|/)(bin|cmd|cli)/") & low.isin(*RUNS_PROGRAM)),
        ("server_startup", "medium", "named like a server's start", (kind == "function") & name.isin(*STARTS_SERVER)),
        ("server_startup", "medium", "starts something in the root's server or app file", kind.isin("function", "const", "class") & stem.isin("server", "app") & root & low.isin(*BOOTS)),
        ("script", "low", "a function in a folder of scripts", (kind == "function") & path.rlike(r"(?i)(^|/)scripts?/")),
    ]


def _first(rules: list, at: int) -> Column:
    out = F.when(rules[0][3], rules[0][at])
    for r in rules[1:]:
        out = out.when(r[3], r[at])
    return out


def entry_point(name: Column, kind: Column, path: Column, signature: Column) -> Column:
    """Kind of entry point, the first rule that holds; null if none does."""
    return _first(entry_rules(name, kind, path, signature), 0)


def entry_detail(name: Column, kind: Column, path: Column, signature: Column) -> Column:
    """struct<kind, confidence, reason> of the first rule that holds; null fields if none does."""
    rules = entry_rules(name, kind, path, signature)
    return F.struct(_first(rules, 0).alias("kind"), _first(rules, 1).alias("confidence"), _first(rules, 2).alias("reason"))
