"""History mining: churn, authors, co-change, percentiles, risk.  `as_of` is a parameter; nothing asks the clock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.scalars import band, epoch_seconds, half_up, path_of

DAY = 86_400


def commits(git_metadata: DataFrame) -> DataFrame:
    """(repo_id, path, sha, author, at): distinct, paths in one spelling, dates in seconds; null keys are left out."""
    return (
        git_metadata.select(
            "repo_id", path_of(F.col("file_path")).alias("path"), F.col("commit_sha").alias("sha"),
            F.coalesce(F.nullif(F.trim("author_email"), F.lit("")), "author_name").alias("author"), epoch_seconds(F.col("commit_date")).alias("at"),
        )
        .dropna(subset=["repo_id", "path", "sha"]).distinct()
    )


def file_churn(c: DataFrame, as_of: int, days: int = 90) -> DataFrame:
    """(repo_id, path, commits, authors, last_at, churn_score, risk) of files with commits in the window."""
    inside = c.filter(F.col("at").between(as_of - days * DAY, as_of))
    agg = inside.groupBy("repo_id", "path").agg(F.count_distinct("sha").alias("commits"), F.count_distinct("author").alias("authors"), F.max("at").alias("last_at"))
    score = half_up(F.col("commits") / float(days) * 90, 2)
    risk = F.when(score > 10, "hotspot").when(score > 5, "volatile").when(score >= 1, "active").otherwise("stable")
    return agg.withColumn("churn_score", score).withColumn("risk", risk)


def symbol_churn(symbols: DataFrame, churn: DataFrame) -> DataFrame:
    """(repo_id, id, commits, authors): every symbol carries the commits of its file."""
    return symbols.select("repo_id", "id", F.col("file_path").alias("path")).distinct().join(churn, ["repo_id", "path"]).select("repo_id", "id", "commits", "authors", "churn_score")


def top_author(c: DataFrame) -> DataFrame:
    """(repo_id, author, touched): the author of most (commit, file) rows; ties go to the smaller name."""
    n = c.filter(F.col("author").isNotNull()).groupBy("repo_id", "author").agg(F.count(F.lit(1)).alias("touched"))
    best = n.groupBy("repo_id").agg(F.min_by(F.struct("author", "touched"), F.struct((-F.col("touched")).alias("k"), "author")).alias("b"))
    return best.select("repo_id", "b.author", "b.touched")


def churn_summary(churn: DataFrame) -> DataFrame:
    """(repo_id, files, hotspot, volatile, active, stable, total_commits)."""
    return churn.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("files"), *[F.count_if(F.col("risk") == r).alias(r) for r in ("hotspot", "volatile", "active", "stable")], F.sum("commits").alias("file_commits")
    )


def co_change(baskets: DataFrame, min_support: int = 2, mega: int = 30, targets: DataFrame | None = None) -> DataFrame:
    """(g, target, partner, support, weighted_support, confidence, lift) from distinct (g, b, item) rows.

    Commits of 2 to `mega` files count; weights are 1 / (files - 1); denominators use all commits.  Both directions of
    a pair come out.  With `targets` (g, item) only their partners are computed: the semi-join comes before the pairs.
    """
    sizes = baskets.groupBy("g", "b").agg(F.count(F.lit(1)).alias("k"))
    totals = sizes.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    per_item = baskets.groupBy("g", "item").agg(F.count(F.lit(1)).alias("n_item"))
    held = baskets.join(sizes.filter(F.col("k").between(2, mega)), ["g", "b"])
    left = held if targets is None else held.join(targets.select("g", "item").distinct(), ["g", "item"], "left_semi")
    pairs = left.select("g", "b", "k", F.col("item").alias("target")).join(held.select("g", "b", F.col("item").alias("partner")), ["g", "b"]).filter("target <> partner")
    agg = pairs.groupBy("g", "target", "partner").agg(F.count(F.lit(1)).alias("support"), F.sum(1.0 / (F.col("k") - 1)).alias("w")).filter(F.col("support") >= min_support)
    t = per_item.select("g", F.col("item").alias("target"), F.col("n_item").alias("n_t"))
    p = per_item.select("g", F.col("item").alias("partner"), F.col("n_item").alias("n_p"))
    return agg.join(t, ["g", "target"]).join(p, ["g", "partner"]).join(totals, "g").select(
        "g", "target", "partner", "support", half_up(F.col("w"), 3).alias("weighted_support"), half_up(F.col("support") / F.col("n_t"), 3).alias("confidence"),
        half_up(F.col("support") * F.col("n") / (F.col("n_t") * F.col("n_p")), 3).alias("lift"),
    )


def midrank(values: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """(group, value, out): (less + equal / 2) / n of every value that occurs; from a histogram, not from the rows."""
    hist = values.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    order = W.partitionBy(*group).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    less = F.coalesce(F.sum("_n").over(order), F.lit(0))
    total = F.sum("_n").over(W.partitionBy(*group))
    return hist.select(*group, value, half_up((less + F.col("_n") / 2.0) / total, 6).alias(out))


def midrank_of(values: DataFrame, distribution: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """(group, value, out) of every value of `values` in the distribution of another table, where it may be absent: half of
    its equals and all below it count; without a distribution the rank is 0."""
    hist = distribution.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    asked = values.select(*group, value).distinct().withColumn("_n", F.lit(0).cast("bigint"))
    both = hist.unionByName(asked).groupBy(*group, value).agg(F.sum("_n").alias("_n"))
    order = W.partitionBy(*group).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    less = F.coalesce(F.sum("_n").over(order), F.lit(0))
    total = F.sum("_n").over(W.partitionBy(*group))
    ranked = both.select(*group, value, F.when(total > 0, half_up((less + F.col("_n") / 2.0) / total, 6)).otherwise(0.0).alias(out))
    return ranked.join(asked.select(*group, value), [*group, value], "left_semi")


def symbol_risk(symbols: DataFrame, churn: DataFrame, co: DataFrame, tested: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, id, churn_pct, centrality_pct, complexity_pct, test_gap, co_change, risk, band).

    Churn .25, centrality .25 (files that import the symbol's file), complexity .20, missing test .15, co-change partners
    of confidence .4 or more (five are full) .15.  Percentiles are midranks within the repository: commits among the
    files that have any, importers among all symbols, with zeros.
    symbols: distinct (repo_id, id, path, cc); churn: (repo_id, path, commits); co: (g, target, partner, confidence);
    tested: (repo_id, id); edges: (repo_id, src, dst).
    """
    strong = co.filter(F.col("confidence") >= 0.4).groupBy(F.col("g").alias("repo_id"), F.col("target").alias("path")).agg(F.count(F.lit(1)).alias("strong"))
    importers = edges.groupBy("repo_id", F.col("dst").alias("path")).agg(F.count_distinct("src").alias("importers"))
    # what belongs to a file is joined per file, before its symbols
    commits_ = churn.select("repo_id", "path", "commits")
    per_file = symbols.select("repo_id", "path").distinct().join(commits_, ["repo_id", "path"], "left").join(strong, ["repo_id", "path"], "left").join(importers, ["repo_id", "path"], "left").na.fill(0, ["commits", "strong", "importers"])
    per_file = per_file.join(midrank_of(per_file, commits_, ["repo_id"], "commits", "churn_pct"), ["repo_id", "commits"])
    s = symbols.join(per_file, ["repo_id", "path"]).na.fill(0, ["cc"])
    s = s.join(tested.select("repo_id", "id").distinct().withColumn("t", F.lit(1)), ["repo_id", "id"], "left")
    for value, out in (("cc", "complexity_pct"), ("importers", "centrality_pct")):
        s = s.join(midrank(s, ["repo_id"], value, out), ["repo_id", value])
    gap = F.when(F.col("t").isNull(), 1.0).otherwise(0.0)
    spread = F.least(F.col("strong") / 5.0, F.lit(1.0))
    score = half_up((0.25 * F.col("churn_pct") + 0.25 * F.col("centrality_pct") + 0.20 * F.col("complexity_pct") + 0.15 * gap + 0.15 * spread) * 100)
    return s.select("repo_id", "id", "churn_pct", "centrality_pct", "complexity_pct", gap.alias("test_gap"), spread.alias("co_change"), score.alias("risk")).withColumn("band", band(F.col("risk")))
