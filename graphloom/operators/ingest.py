"""Ingest and incremental maintenance: what changed, what vanished, which version holds, what a file declares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.extract.process import process
from graphloom.functions.scalars import short_id


#: Folders of tools and caches, and names of files that hold secrets; neither is read.
SKIPPED = r"/(\.git|\.hg|\.svn|node_modules|\.venv|venv|__pycache__|\.tox|\.mypy_cache|\.gradle|\.idea|\.next|\.nuxt)/"
SECRET_FILE = r"(?i)(^|/)(\.env(\.[^/]*)?|id_rsa|id_dsa|id_ecdsa|id_ed25519|[^/]*\.(pem|key|p12|pfx|jks|keystore)|\.netrc|\.npmrc|\.pypirc|credentials(\.json)?)$"
#: Folders that hold other people's code.
LIBRARY = r"(^|/)(node_modules|bower_components|vendor|third_party|third-party|site-packages|dist-packages|Pods|Carthage|deps|external)/"


def is_library_path(path: Column) -> Column:
    return path.rlike(LIBRARY)


def judged(found: DataFrame, max_bytes: int = 524_288, extensions: list[str] | None = None) -> DataFrame:
    """(path, content, length) rows with `dropped`, why a file is not read: folder, secret, size, type or binary; else null."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    why = (
        F.when(F.concat(F.lit("/"), "path").rlike(SKIPPED), "folder").when(F.col("path").rlike(SECRET_FILE), "secret").when(F.col("length") > max_bytes, "size")
        .when(~ext.isin(extensions) if extensions else F.lit(False), "type").when(F.expr("position(X'00' in substring(content, 1, 8000)) > 0"), "binary")
    )
    return found.withColumn("dropped", why)


def discover(spark, root: str, max_bytes: int = 524_288, extensions: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, report): files (path, raw_content, content_hash, size) below a folder that are read, every one of them, and
    (dropped, files) how many are not and why."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    every = judged(raw, max_bytes, extensions)
    kept = every.filter(F.col("dropped").isNull())
    report = every.filter(F.col("dropped").isNotNull()).groupBy("dropped").agg(F.count(F.lit(1)).alias("files"))
    return kept.select("path", F.col("content").alias("raw_content"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size")), report


def first_by_directory(files: DataFrame, limit: int, first: tuple[str, ...] = ("src", "lib", "app", "packages")) -> DataFrame:
    """(path, size): the `limit` files that an index of a bounded size keeps: those in `first` folders, then by path; ranks
    are made of paths only."""
    top = F.regexp_extract("path", r"(?:^|/)([^/]+)/[^/]+$", 1)
    rank = F.coalesce(*[F.when(F.col("path").rlike(f"(^|/){d}/"), i) for i, d in enumerate(first)], F.lit(len(first)))
    return files.select("path", "size", rank.alias("_r"), top.alias("_t")).orderBy("_r", "path").limit(limit).select("path", "size")


def only_changed(files: DataFrame, changed_paths: DataFrame) -> DataFrame:
    """Files of a set of changed paths (repo_id, path), as a diff between two commits gives them."""
    return files.join(changed_paths.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")


def insert_new(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows, and those incoming ones whose key is not there yet, each key once (the smallest row)."""
    fresh = incoming.join(stored.select(*keys), keys, "left_anti")
    rest = [c for c in stored.columns if c not in keys]
    one = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return stored.unionByName(one.select(*stored.columns))


def write_chunked(rows: DataFrame, path: str, rows_per_file: int = 500_000, by: str = "repo_id", mode: str = "overwrite") -> None:
    """Write rows in files of at most `rows_per_file` rows, one folder per value of `by`; a large value is split by hash."""
    rows.repartition(by, F.pmod(F.xxhash64(*rows.columns), F.lit(16))).write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy(by).parquet(path)


def clone(rows: DataFrame, repo_id: str, new_id: str) -> DataFrame:
    """The rows of a repository under another id, to be appended."""
    return rows.filter(F.col("repo_id") == repo_id).withColumn("repo_id", F.lit(new_id))


def collectable(blobs: DataFrame, files: DataFrame, as_of_ms: int, grace_ms: int = 86_400_000) -> DataFrame:
    """Blobs (content_hash, created_at) that no file holds and that are older than the grace period."""
    return orphan_blobs(blobs, files).filter(F.col("created_at") < as_of_ms - grace_ms)


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version of every key; equal rows collapse, ties go to the greatest row."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(version), F.xxhash64(*rest))).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def changed(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Found (path, hash) rows whose hash the store does not have: what must be read again."""
    return found.join(stored.select("path", "hash"), ["path", "hash"], "left_anti")


def vanished(stored: DataFrame, found: DataFrame) -> DataFrame:
    return stored.join(found.select("path"), "path", "left_anti")


def staleness(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(path, state): fresh, stale, missing or new."""
    a, b = stored.select("path", F.col("hash").alias("h1")), found.select("path", F.col("hash").alias("h2"))
    state = F.when(F.col("h1").isNull(), "new").when(F.col("h2").isNull(), "missing").when(F.col("h1") == F.col("h2"), "fresh").otherwise("stale")
    return a.join(b, "path", "full").select("path", state.alias("state"))


def replace_by_source(edges: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges after re-reading some sources: their outgoing edges are replaced; those of vanished files go both ways."""
    kept = edges.join(fresh.select("src").distinct(), "src", "left_anti")
    kept = kept.join(gone.select(F.col("path").alias("src")), "src", "left_anti").join(gone.select(F.col("path").alias("dst")), "dst", "left_anti")
    return kept.select(*edges.columns).unionByName(fresh.select(*edges.columns))


def orphan_blobs(blobs: DataFrame, files: DataFrame) -> DataFrame:
    return blobs.join(files.select("content_hash"), "content_hash", "left_anti")


def extract(files: DataFrame) -> DataFrame:
    """(repo_id, path, what, name, kind, start_byte, end_byte): symbols and imports that files declare; what is symbol or import."""
    rows = process(files, with_uses=False).filter("what in ('symbol', 'import')")
    return rows.select("repo_id", "path", "what", F.coalesce("name", "specifier").alias("name"), "kind", "start_byte", "end_byte")


def symbol_ids(symbols: DataFrame) -> DataFrame:
    """Extracted symbols with their ids: the hash of path, name and kind."""
    return symbols.filter("what = 'symbol'").withColumn("id", short_id(F.col("path"), F.col("name"), F.col("kind")))
