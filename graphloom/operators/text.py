"""Text scans: lines, tagged comments, references with their enclosing symbol, mentions, overlaps of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tags of comments.
TAGS = ("TODO", "FIXME", "HACK", "NOTE", "OPTIMIZE", "BUG", "XXX")


def lines(files: DataFrame, keep: Column | None = None) -> DataFrame:
    """(repo_id, path, line_no, line, offset, bytes): lines from 1, without the CR of CRLF; byte offset of each line.

    keep: a condition on `text` that whole files must meet first; it is the cheap filter before the explode.
    """
    text = files.filter(F.col("raw_content").isNotNull()).select("repo_id", "path", F.col("raw_content").cast("string").alias("text"))
    if keep is not None:
        text = text.filter(keep)
    # a line begins where those before it end: a running sum over the lines of a file, after the explode
    each = text.select("repo_id", "path", F.xxhash64("text").alias("_v"), F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).distinct()
    before = W.partitionBy("repo_id", "path", "_v").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0))
    return each.select("repo_id", "path", (F.col("i") + 1).alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"), offset.alias("offset"))


def plain_lines(files: DataFrame, keep: Column | None = None) -> DataFrame:
    """(repo_id, path, line_no, line), without offsets."""
    text = files.filter(F.col("raw_content").isNotNull()).select("repo_id", "path", F.col("raw_content").cast("string").alias("text"))
    if keep is not None:
        text = text.filter(keep)
    return text.select("repo_id", "path", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select(
        "repo_id", "path", (F.col("i") + 1).alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line")
    )


def search(files: DataFrame, pattern: str) -> DataFrame:
    """(repo_id, path, line_no, matches): lines on which a regular expression occurs, and how often."""
    hit = plain_lines(files, F.col("text").rlike(pattern)).filter(F.col("line").rlike(pattern))
    return hit.select("repo_id", "path", "line_no", F.regexp_count("line", F.lit(pattern)).alias("matches")).distinct()


def context(files: DataFrame, pattern: str, around: int = 1) -> DataFrame:
    """(repo_id, path, line_no, before, after): hits with the lines around them, joined by newlines.

    The places of hits are found first; each takes its own few lines out of the file, so that no line carries all others.
    """
    text = files.filter(F.col("raw_content").isNotNull()).select("repo_id", "path", F.col("raw_content").cast("string").alias("text"))
    lines_ = F.transform(F.split("text", "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))
    held = text.filter(F.regexp_replace("text", "\r\n", "\n").rlike("(?m)" + pattern)).select("repo_id", "path", lines_.alias("all"))
    at = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: F.get("all", i).rlike(pattern))
    cut_out = lambda i: F.struct(
        (i + 1).alias("line_no"), F.array_join(F.slice("all", F.greatest(F.lit(0), i - around) + 1, i - F.greatest(F.lit(0), i - around)), "\n").alias("before"), F.array_join(F.slice("all", i + 2, around), "\n").alias("after")
    )
    return held.select("repo_id", "path", F.explode(F.transform(at, cut_out)).alias("h")).select("repo_id", "path", "h.line_no", "h.before", "h.after").distinct()


def tagged(files: DataFrame) -> DataFrame:
    """(repo_id, path, line_no, tag, assignee, text) of comment tags: TODO(name): text."""
    pattern = r"(?i)\b(" + "|".join(TAGS) + r")\b(?:\(([^)]+)\))?[:\s]*(.*)"
    part = lambda i: F.regexp_extract("line", pattern, i)
    return plain_lines(files, F.col("text").rlike(pattern)).filter(F.col("line").rlike(pattern)).select(
        "repo_id", "path", "line_no", F.upper(part(1)).alias("tag"), part(2).alias("assignee"), F.rtrim(part(3)).alias("text")
    ).distinct()


def enclosing(hits: DataFrame, spans: DataFrame, bucket: int = 4096) -> DataFrame:
    """hits (repo_id, path, offset, ...) with the id of the narrowest span (start, end, id) that contains the offset.

    A range join by buckets of bytes: spans are put into every bucket they cross, hits into theirs.
    """
    cols = hits.columns
    b = spans.select("repo_id", "path", "start", "end", "id", F.explode(F.sequence(F.expr(f"start div {bucket}"), F.expr(f"greatest(start, end - 1) div {bucket}"))).alias("bucket"))
    h = hits.withColumn("bucket", F.expr(f"cast(offset div {bucket} as bigint)"))
    j = h.join(b.withColumn("bucket", F.col("bucket").cast("bigint")), ["repo_id", "path", "bucket"], "left").withColumn("inside", (F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("end")))
    best = F.min_by("id", F.when(F.col("inside"), F.struct((F.col("end") - F.col("start")).alias("w"), "id")))
    return j.groupBy(*cols).agg(best.alias("symbol_id"))


def mentions(names: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, id, file_count): files whose words hold a name as a whole word.

    names: (repo_id, id, name); files: (repo_id, path, raw_content).  Words of files are distinct per file before they
    are shuffled; short names never match.
    """
    word = F.array_distinct(F.regexp_extract_all(F.col("raw_content").cast("string"), F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    w = files.filter(F.col("raw_content").isNotNull()).select("repo_id", "path", F.explode(word).alias("name")).distinct()
    n = names.filter(F.length("name") >= 3).select("repo_id", "id", "name").distinct()
    counted = w.join(n.select("repo_id", "name").distinct(), ["repo_id", "name"], "left_semi").groupBy("repo_id", "name").agg(F.count(F.lit(1)).alias("file_count"))
    return n.join(counted, ["repo_id", "name"]).select("repo_id", "id", "file_count")


def overlaps(ranges: DataFrame, hunks: DataFrame) -> DataFrame:
    """(repo_id, path, id): ranges (start, end) that overlap a hunk (lo, hi) of the same file; ends are exclusive.

    The join is on the file; ranges and hunks of a file are few, and a file of many is divided by adaptive execution.
    """
    return ranges.join(hunks, ["repo_id", "path"]).filter((F.col("start") < F.col("hi")) & (F.col("end") > F.col("lo"))).select("repo_id", "path", "id").distinct()


def signature_search(s: DataFrame, needle: str, how: str = "contains") -> DataFrame:
    """Symbols whose signature contains, starts with or matches a text; case does not matter but for a regular expression."""
    sig = F.col("signature")
    escaped = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    test = {"contains": sig.ilike(f"%{escaped}%"), "prefix": sig.ilike(f"{escaped}%"), "regex": sig.rlike(needle)}[how]
    return s.filter(test)


def nearest_before(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """Every row with the value of `at` of the row before it in its group."""
    return rows.withColumn("previous", F.lag(at).over(W.partitionBy(*key).orderBy(at)))
