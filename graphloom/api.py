"""The library's entry points: index a folder, re-index files, delete, list, export.

An index is a folder of Parquet tables (files, symbols, imports, uses, edges, refs), each partitioned by repo_id, so that
one repository is replaced by overwriting its partitions and no other is touched.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.extract import process as px
from graphloom.extract import resolve as rs
from graphloom.functions.scalars import short_id
from graphloom.operators import edges as eg
from graphloom.operators import ingest
from graphloom.sources.tables import cut

TABLES = ("files", "symbols", "imports", "uses", "edges", "refs")
EXTENSIONS = sorted(e.lstrip(".") for e in px.standard().by_extension) + ["vue", "svelte", "astro"]


def table(spark: SparkSession, index: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{index}/{name}")


def repo_id_of(spark: SparkSession, root: str) -> str:
    return spark.range(1).select(short_id(F.lit(root))).first()[0]


def build(files: DataFrame) -> dict[str, DataFrame]:
    """The tables of an index from files (repo_id, path, raw_content, content_hash)."""
    rows = cut(px.process(files))
    symbols, records = px.symbols(rows), px.imports(rows)
    resolved = cut(rs.resolve(records, files))
    edges = eg.file_edges(resolved).unionByName(eg.injected_edges(rows))
    uses = px.name_uses(rows)
    return {"files": files, "symbols": symbols, "imports": records, "uses": uses, "edges": edges, "refs": eg.symbol_refs(uses, resolved, symbols)}


def write(tables: dict[str, DataFrame], index: str) -> None:
    """Write tables, replacing the partitions of the repositories that they hold and no others."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(f"{index}/{name}")


def read_folder(spark: SparkSession, root: str, max_bytes: int = 524_288) -> tuple[DataFrame, DataFrame]:
    """(files, report) of a source tree; paths are relative to the root."""
    kept, report = ingest.discover(spark, root, max_bytes, EXTENSIONS)
    below = F.expr(f"substring(path, instr(path, '{root.rstrip('/')}/') + {len(root.rstrip('/')) + 1})")
    return kept.select(F.lit(repo_id_of(spark, root)).alias("repo_id"), below.alias("path"), "raw_content", "content_hash"), report


def index_folder(spark: SparkSession, root: str, index: str, max_bytes: int = 524_288) -> dict[str, int]:
    """Index a source tree; returns the number of rows of each table, and of dropped files by reason."""
    files, report = read_folder(spark, root, max_bytes)
    write(build(cut(files)), index)
    me = repo_id_of(spark, root)
    counts = {t: table(spark, index, t).filter(F.col("repo_id") == me).count() for t in TABLES if os.path.exists(f"{index}/{t}")}
    return counts | {f"dropped_{r['dropped']}": r["files"] for r in report.collect()}  # a handful of reasons


def reindex_files(spark: SparkSession, index: str, changed: DataFrame) -> None:
    """Apply changed files (repo_id, path, raw_content, content_hash); null content removes the file.

    Symbols, imports and uses of changed files are read again; edges and references of the repositories concerned are
    resolved anew, as a new file may answer to an old import.
    """
    key = changed.select("repo_id", "path").distinct()
    repos = changed.select("repo_id").distinct()
    mine = lambda name: table(spark, index, name).join(F.broadcast(repos), "repo_id", "left_semi") if repos.count() <= 10_000 else table(spark, index, name).join(repos, "repo_id", "left_semi")  # noqa: E731 checked
    fresh = changed.filter(F.col("raw_content").isNotNull())
    files = cut(mine("files").join(key, ["repo_id", "path"], "left_anti").select("repo_id", "path", "raw_content", "content_hash").unionByName(fresh.select("repo_id", "path", "raw_content", "content_hash")))
    rows = cut(px.process(fresh))
    keep = lambda name, column: mine(name).join(key.withColumnRenamed("path", column), ["repo_id", column], "left_anti")
    symbols, records, uses = px.symbols(rows), px.imports(rows), px.name_uses(rows)
    symbols = cut(keep("symbols", "file_path").select(*symbols.columns).unionByName(symbols))
    records = cut(keep("imports", "source").select(*records.columns).unionByName(records))
    uses = cut(keep("uses", "path").select(*uses.columns).unionByName(uses))
    resolved = cut(rs.resolve(records, files))
    injected = mine("edges").filter("edge_type = 'di'").join(key.withColumnRenamed("path", "src"), ["repo_id", "src"], "left_anti").join(key.withColumnRenamed("path", "dst"), ["repo_id", "dst"], "left_anti")
    e = eg.file_edges(resolved)
    edges = cut(e.unionByName(injected.select(*e.columns)).unionByName(eg.injected_edges(rows).select(*e.columns)).distinct())
    write({"files": files, "symbols": symbols, "imports": records, "uses": uses, "edges": edges, "refs": cut(eg.symbol_refs(uses, resolved, symbols))}, index)


def delete_index(spark: SparkSession, index: str, repo_id: str, dry_run: bool = True) -> dict[str, int]:
    """Rows of a repository in every table; without `dry_run` they are removed."""
    counts = {}
    for name in TABLES:
        t = table(spark, index, name)
        counts[name] = t.filter(F.col("repo_id") == repo_id).count()
        if not dry_run and counts[name]:
            fs = spark._jvm.org.apache.hadoop.fs.Path(f"{index}/{name}/repo_id={repo_id}")
            fs.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs, True)
    return counts


def list_repos(spark: SparkSession, index: str) -> DataFrame:
    """(repo_id, files, symbols) of every repository of an index."""
    f = table(spark, index, "files").groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"))
    s = table(spark, index, "symbols").groupBy("repo_id").agg(F.count(F.lit(1)).alias("symbols"))
    return f.join(s, "repo_id", "left").na.fill(0, ["symbols"])


def resolve_repo(repos: DataFrame, text: str) -> DataFrame:
    """Repositories (id, root_path) that a text names: an id, a root path, or the last folder of one."""
    root = F.regexp_replace("root_path", "/+$", "")
    return repos.filter((F.col("id") == text) | (root == text.rstrip("/")) | (F.substring_index(root, "/", -1) == text))
