"""Source files that do not parse (problem 1).

1. Each file is lexed once, in Arrow batches, into labelled tokens; what leaves the lexer are rows: the distinct
   adjacent token pairs of a file, and its brackets in windows, each reduced to what does not cancel inside it.
2. The windows of a file are reduced in turn to one rest (a fold over the windows); an empty rest is sound nesting.
3. Pairs and rests are exploded into one DataFrame of tests and anti-joined with the pairs that the language's grammar
   permits (a table of some thousand rows, fixed by the grammars).  Labels carry the statement a token belongs to -- a
   try's closing brace must meet catch or finally, a conditional its colon, a block its header -- so the same join
   validates statement productions.

What is left names the files that do not parse, and why.

Defined results: null content and files of other extensions are no case; empty and blank files parse; a byte order
mark and CR LF are harmless; repeated rows of a file count once; rates count distinct files with content.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import grammars, lexers
from graphloom.sources.tables import spread

LANGUAGES = ("py", "ts", "js", "go", "java", "json")
#: More than any grammar here gives: the table is fixed by this package, and checked before it is broadcast.
MOST_PAIRS = 60_000


def language(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))


def tokens(files: DataFrame) -> DataFrame:
    """(repo_id, path, lang, pairs array<string>, windows array<string>) of the files of known languages."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, windows = [], []
            for lang, raw in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                try:
                    got, rest = lexers.lex(lang, raw.as_py().decode("utf-8"))
                except UnicodeDecodeError:
                    got, rest = {("BAD", "BAD", False)}, []
                pairs.append([f"{a} {b} {int(line)}" for a, b, line in got])
                windows.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(pairs, pa.list_(pa.string())), pa.array(windows, pa.list_(pa.string()))],
                ["repo_id", "path", "lang", "pairs", "windows"],
            )

    known = (
        files.filter(F.col("raw_content").isNotNull())
        .select("repo_id", "path", language(F.col("path")).alias("lang"), "raw_content")
        .filter(F.col("lang").isin(*LANGUAGES))
    )
    return spread(known).mapInArrow(scan, "repo_id string, path string, lang string, pairs array<string>, windows array<string>")


def rest_of(windows: Column) -> Column:
    """The brackets that do not cancel over all windows of a file."""
    cancel = r"\(\)|\[\]|\{\}"
    return F.aggregate(
        windows,
        F.lit(""),
        lambda acc, w: F.aggregate(F.sequence(F.lit(1), F.length(w)), F.concat(acc, w), lambda s, _: F.regexp_replace(s, cancel, "")),
    )


def violations(files: DataFrame) -> DataFrame:
    """(repo_id, path, lang, test): every pair that the grammar does not permit, and every rest of brackets."""
    spark = files.sparkSession
    rows = [(lang, f"{a} {b} {int(line)}") for lang, pairs in grammars.tables().items() for a, b, line in pairs]
    if len(rows) > MOST_PAIRS:
        raise ValueError("the grammars permit more pairs than may be broadcast")
    permitted = spark.createDataFrame(rows + [(lang, "") for lang in LANGUAGES], "lang string, test string")
    tests = tokens(files).select("repo_id", "path", "lang", F.explode(F.array_append("pairs", rest_of(F.col("windows")))).alias("test"))
    return tests.join(F.broadcast(permitted), ["lang", "test"], "left_anti").select("repo_id", "path", "lang", "test")


def found(files: DataFrame) -> DataFrame:
    """(repo_id, path) of the files that do not parse."""
    return violations(files).select("repo_id", "path").distinct()


def rates(files: DataFrame) -> DataFrame:
    """(repo_id, lang, files, broken, rate) per repository and language."""
    every = (
        files.filter(F.col("raw_content").isNotNull()).select("repo_id", "path", language(F.col("path")).alias("lang"))
        .filter(F.col("lang").isin(*LANGUAGES)).distinct()
    )
    broken = violations(files).select("repo_id", "path").distinct().withColumn("broken", F.lit(1))
    return (
        every.join(broken, ["repo_id", "path"], "left").groupBy("repo_id", "lang")
        .agg(F.count(F.lit(1)).alias("files"), F.count("broken").alias("broken"))
        .withColumn("rate", F.round(F.col("broken") / F.col("files"), 6))
    )
