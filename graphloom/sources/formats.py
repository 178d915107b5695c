"""Formats that a code index reads and writes: git logs, unified diffs, coverage reports, dbt schemas, bundles."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: git log --no-merges --name-only --format=%x1e%H%x1f%an%x1f%ae%x1f%at%x1f%s
RECORD, UNIT = "\x1e", "\x1f"


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit_sha, author_name, author_email, commit_date, message, file_path) of exported logs; records split by readers."""
    raw = spark.read.option("lineSep", RECORD).text(path).filter(F.length(F.trim("value")) > 0)
    head = F.split(F.element_at(F.split("value", "\n"), 1), UNIT)
    files = F.filter(F.slice(F.split("value", "\n"), 2, 1_000_000), lambda x: F.trim(x) != "")
    cols = [F.get(head, F.lit(i)).alias(n) for i, n in enumerate(("commit_sha", "author_name", "author_email"))]
    return raw.select(*cols, F.get(head, F.lit(3)).cast("bigint").alias("commit_date"), F.get(head, F.lit(4)).alias("message"), F.explode(files).alias("file_path"))


def co_change_rows(log: DataFrame, repo_id: str, depth: int = 300) -> DataFrame:
    """(repo_id, commit_sha, file_path, commit_date) of the latest `depth` commits of a log without merges, each row once."""
    latest = log.select("commit_sha", "commit_date").distinct().orderBy(F.desc("commit_date"), "commit_sha").limit(depth)
    return log.join(latest.select("commit_sha"), "commit_sha", "left_semi").select(F.lit(repo_id).alias("repo_id"), "commit_sha", "file_path", "commit_date").distinct()


_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def parse_diff(text: str) -> list[tuple[str | None, str | None, int, int, int, int]]:
    """(old path, new path, old first, old count, new first, new count) of every hunk; null paths for added and deleted files."""
    out, old, new = [], None, None
    for line in text.splitlines():
        if line.startswith("--- "):
            old = None if line[4:].strip() == "/dev/null" else re.sub(r"^a/", "", line[4:].split("\t")[0].strip())
        elif line.startswith("+++ "):
            new = None if line[4:].strip() == "/dev/null" else re.sub(r"^b/", "", line[4:].split("\t")[0].strip())
        elif m := _HUNK.match(line):
            a, b, c, d = (int(x) if x is not None else 1 for x in m.groups())
            out.append((old, new, a, b, c, d))
    return out


def diffs(patches: DataFrame) -> DataFrame:
    """(patch_id, old_path, new_path, old_first, old_count, new_first, new_count) from (patch_id, patch)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["patch_id", "old_path", "new_path", "old_first", "old_count", "new_first", "new_count"]
        for pdf in batches:
            yield pd.DataFrame([(i, *h) for i, p in zip(pdf["patch_id"], pdf["patch"], strict=True) if p for h in parse_diff(p)], columns=names)

    kind = dict(patches.dtypes)["patch_id"]
    return patches.select("patch_id", "patch").mapInPandas(run, f"patch_id {kind}, old_path string, new_path string, old_first int, old_count int, new_first int, new_count int")


def istanbul(reports: DataFrame) -> DataFrame:
    """(path, line, hits) from (report) JSON texts of Istanbul coverage: statements by their first line, the most hits."""
    schema = "map<string, struct<path:string, statementMap:map<string, struct<start:struct<line:int>>>, s:map<string, int>>>"
    files = reports.select(F.explode(F.from_json("report", schema)).alias("key", "f"))
    stmts = files.select(F.coalesce("f.path", "key").alias("path"), F.col("f.s").alias("s"), F.explode("f.statementMap").alias("id", "at"))
    return stmts.select("path", F.col("at.start.line").alias("line"), F.coalesce(F.element_at("s", F.col("id")), F.lit(0)).alias("hits")).groupBy("path", "line").agg(F.max("hits").alias("hits"))


def v8(reports: DataFrame) -> DataFrame:
    """(path, function, first, last, calls) from (report) JSON texts of V8 coverage: named functions, byte range of the first
    block, the most calls."""
    schema = "struct<result:array<struct<url:string, functions:array<struct<functionName:string, ranges:array<struct<startOffset:int, endOffset:int, count:int>>>>>>>"
    scripts = reports.select(F.explode(F.from_json("report", schema)["result"]).alias("r")).select(F.regexp_replace("r.url", "^file://", "").alias("path"), F.explode("r.functions").alias("f"))
    named = scripts.filter(~F.coalesce(F.col("f.functionName"), F.lit("")).rlike(r"^$|^\((top-level|anonymous)"))
    one = named.select("path", F.col("f.functionName").alias("function"), F.col("f.ranges")[0]["startOffset"].alias("first"), F.col("f.ranges")[0]["endOffset"].alias("last"), F.array_max(F.transform("f.ranges", lambda x: x["count"])).alias("calls"))
    return one.groupBy("path", "function", "first", "last").agg(F.max("calls").alias("calls"))


def dbt_columns(schemas: DataFrame) -> DataFrame:
    """(path, entity, column, description, tags) from (path, text) of dbt schema files; a file that is no YAML gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                try:
                    doc = yaml.safe_load(text) if text else None
                except yaml.YAMLError:
                    doc = None
                for kind in ("models", "sources", "seeds", "snapshots"):
                    for m in (doc or {}).get(kind) or []:
                        for c in m.get("columns") or []:
                            out.append((path, m.get("name"), c.get("name"), c.get("description"), list(map(str, c.get("tags") or []))))
            yield pd.DataFrame(out, columns=["path", "entity", "column", "description", "tags"])

    return schemas.select("path", "text").mapInPandas(run, "path string, entity string, column string, description string, tags array<string>")


def export_bundle(tables: dict[str, DataFrame], folder: str, repo_id: str | None = None) -> None:
    """Write tables as compressed JSON lines, one folder a table; only one repository's rows if asked."""
    for name, df in tables.items():
        kept = df.filter(F.col("repo_id") == repo_id) if repo_id is not None and "repo_id" in df.columns else df
        kept.write.mode("overwrite").option("compression", "gzip").json(f"{folder}/{name}")


def import_bundle(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Read a bundle back, with its schemas (binary columns come as base64 text and are decoded)."""
    return {name: spark.read.schema(schema).json(f"{folder}/{name}") for name, schema in schemas.items()}


def append_snapshot(metrics: DataFrame, label: str, created_at: int, path: str) -> None:
    """Append one row per repository: its metrics as JSON under a label and a time."""
    names = [c for c in metrics.columns if c != "repo_id"]
    metrics.select("repo_id", F.lit(label).alias("label"), F.lit(created_at).cast("bigint").alias("created_at"), F.to_json(F.struct(*names)).alias("metrics")).write.mode("append").parquet(path)


def render_mermaid(edges: list[tuple[str, str]]) -> str:
    """A Mermaid graph of a pruned edge list."""
    ids = {n: f"n{i}" for i, n in enumerate(dict.fromkeys(x for e in edges for x in e))}
    return "\n".join(["graph LR", *(f"  {i}[{json.dumps(n)}]" for n, i in ids.items()), *(f"  {ids[a]} --> {ids[b]}" for a, b in edges)])
