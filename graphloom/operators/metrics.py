"""Metric roll-ups and composite scores over distinct symbol rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.scalars import capped, directory, exported, half_up, is_test_path, name_tokens

METRICS = {"cyclomatic_complexity": 1, "cognitive_complexity": 0, "line_count": 0, "param_count": 0, "return_count": 0, "nesting_depth": 0}


def distinct_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols without exact repeats, metrics with their defaults where null."""
    d = symbols.filter(F.col("id").isNotNull()).dropDuplicates()
    return d.select("*", *[F.coalesce(F.col(m), F.lit(v)).alias(f"m_{m}") for m, v in METRICS.items()])


def quality_score() -> Column:
    return half_up(capped(F.col("m_cyclomatic_complexity"), 50, 0.4) + capped(F.col("m_line_count"), 200, 0.3) + capped(F.col("m_nesting_depth"), 10, 0.2) + capped(F.col("m_param_count"), 10, 0.1))


def quality_level(score: Column) -> Column:
    return F.when(score < 25, "good").when(score < 50, "moderate").when(score < 75, "high").otherwise("critical")


def quality_top(s: DataFrame, limit: int = 50) -> DataFrame:
    """(id, name, score, level): the worst symbols; ties by id."""
    scored = s.select("id", "name", quality_score().alias("score"))
    return scored.withColumn("level", quality_level(F.col("score"))).orderBy(F.desc("score"), "id").limit(limit)


def hotspots(s: DataFrame, complex_from: int = 5) -> DataFrame:
    """Per file: counts, averages, maxima and the hotspot score."""
    cc = F.col("m_cyclomatic_complexity")
    agg = s.filter(F.col("kind").isin("function", "method")).groupBy("repo_id", "file_path").agg(
        F.count(F.lit(1)).alias("symbols"), F.count_if(cc >= complex_from).alias("complex_symbols"), half_up(F.avg(cc), 3).alias("avg_cc"),
        F.max(cc).alias("max_cc"), F.max("m_nesting_depth").alias("max_nesting"), F.sum("m_line_count").alias("lines"),
    )
    score = half_up(capped(F.col("avg_cc"), 30, 0.35) + capped(F.col("max_cc"), 50, 0.30) + capped(F.col("complex_symbols") / F.col("symbols"), 1, 0.20) + capped(F.col("max_nesting"), 10, 0.15))
    return agg.withColumn("score", score)


def top_symbols(s: DataFrame, k: int = 3) -> DataFrame:
    """(repo_id, file_path, id, rank): the k most complex functions of every file."""
    w = W.partitionBy("repo_id", "file_path").orderBy(F.desc("m_cyclomatic_complexity"), "id")
    return s.filter(F.col("kind").isin("function", "method")).select("repo_id", "file_path", "id", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= k)


def search_by_complexity(s: DataFrame, low: dict[str, int], high: dict[str, int]) -> DataFrame:
    for m, v in low.items():
        s = s.filter(F.col(f"m_{m}") >= v)
    for m, v in high.items():
        s = s.filter(F.col(f"m_{m}") <= v)
    return s


def public_api(s: DataFrame) -> DataFrame:
    """Exported symbols, and the methods in files of exported classes."""
    top = s.filter(exported(F.col("signature")))
    classes = top.filter(F.col("kind") == "class").select("repo_id", "file_path").distinct()
    methods = s.filter(F.col("kind") == "method").join(classes, ["repo_id", "file_path"], "left_semi")
    return top.select("repo_id", "id", "name", "kind").unionByName(methods.select("repo_id", "id", "name", "kind")).distinct()


def tree_counts(paths: DataFrame) -> DataFrame:
    """(repo_id, dir, files): files below every directory; the root is ''."""
    steps = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    return paths.select("repo_id", F.explode(dirs).alias("dir")).groupBy("repo_id", "dir").agg(F.count(F.lit(1)).alias("files"))


def outline(s: DataFrame) -> DataFrame:
    """(repo_id, file_path, symbols, kinds, first_symbol)."""
    return s.groupBy("repo_id", "file_path").agg(
        F.count(F.lit(1)).alias("symbols"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.min("name").alias("first_symbol")
    )


def similar_names(s: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(repo_id, id_a, id_b, jaccard): functions of one repository and kind whose names share words.

    Equal token sets are one class, represented by its smallest id.  Words are ranked by rarity: two sets of that
    similarity share one of the rarest n - ceil(threshold n) + 1 words of each (prefix filter), so only rare words make
    candidates, which are then compared as sets.
    """
    named = s.filter(F.col("kind").isin("function", "method") & F.col("name").isNotNull()).select("repo_id", "kind", "id", name_tokens(F.col("name")).alias("t")).filter(F.size("t") > 0)
    classes = named.groupBy("repo_id", "kind", "t").agg(F.min("id").alias("id"))
    w = classes.select("repo_id", "kind", "id", F.explode("t").alias("w"))
    frequency = w.groupBy("repo_id", "kind", "w").agg(F.count(F.lit(1)).alias("f"))
    ranked = w.join(frequency, ["repo_id", "kind", "w"]).groupBy("repo_id", "kind", "id").agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("r"))
    n = F.size("r")
    prefix = F.slice("r", 1, (n - F.ceil(n * threshold - 1e-9) + 1).cast("int"))
    words = ranked.select("repo_id", "kind", "id", F.transform("r", lambda x: x["w"]).alias("t"), F.explode(prefix).alias("p")).select("repo_id", "kind", "id", "t", F.col("p.w").alias("w"))
    a, b = words.alias("a"), words.alias("b")
    same = (F.col("a.repo_id") == F.col("b.repo_id")) & (F.col("a.kind") == F.col("b.kind")) & (F.col("a.w") == F.col("b.w")) & (F.col("a.id") < F.col("b.id"))
    near = F.size("a.t") >= threshold * F.size("b.t") - 1e-9
    far = F.size("b.t") >= threshold * F.size("a.t") - 1e-9  # sets of very different sizes are not alike
    both = F.size(F.array_intersect("a.t", "b.t"))
    jac = both / (F.size("a.t") + F.size("b.t") - both)
    return a.join(b, same & near & far).filter(jac >= threshold).select(F.col("a.repo_id").alias("repo_id"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), half_up(jac, 3).alias("jaccard")).distinct()


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo_id, path, change): added, removed or changed files between two (repo_id, path, hash) tables."""
    a, b = old.withColumnRenamed("hash", "h_old"), new.withColumnRenamed("hash", "h_new")
    change = F.when(F.col("h_old").isNull(), "added").when(F.col("h_new").isNull(), "removed").when(F.col("h_old") != F.col("h_new"), "changed")
    return a.join(b, ["repo_id", "path"], "full").withColumn("change", change).filter(F.col("change").isNotNull()).select("repo_id", "path", "change")


def untested(s: DataFrame, tested: DataFrame) -> DataFrame:
    """(repo_id, id, priority): functions outside tests that no test mentions."""
    t = tested.select("repo_id", "id").distinct()
    f = s.filter(F.col("kind").isin("function", "method") & ~is_test_path(F.col("file_path"))).join(t, ["repo_id", "id"], "left_anti")
    cc, n = F.col("m_cyclomatic_complexity"), F.col("m_line_count")
    return f.select("repo_id", "id", F.when((cc >= 5) | (n >= 20), "high").when((cc >= 2) | (n >= 8), "medium").otherwise("low").alias("priority"))


def placement(s: DataFrame) -> DataFrame:
    """(repo_id, dir, symbols, exported): the directory's interface."""
    return s.groupBy("repo_id", directory(F.col("file_path")).alias("dir")).agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.coalesce(exported(F.col("signature")), F.lit(False))).alias("exported"))
