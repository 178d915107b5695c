"""Health of repositories: debt in four categories, a radar of five axes, antipatterns, refactoring, differences.

All take `symbols` (distinct rows with the six metrics, null where unknown), `edges` (repo_id, src, dst) of files and
`churn` (repo_id, path, commits); files in cycles come from `graph.components`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import half_up

#: Limits and kinds of the scores below.
CALLABLE = ("function", "method", "hook", "composable", "middleware", "route")
CC_CRITICAL, NESTING_HIGH, PARAM_HIGH, LINE_HIGH = 20, 4, 7, 100
COUPLING_HIGH, COUPLING_CRITICAL = 10, 20
GOD_CLASS_LINES, GOD_CLASS_METHODS = 500, 20
CHURN_HIGH, CHURN_CRITICAL = 10, 25
AXES = {"complexity": 0.30, "coupling": 0.25, "maintainability": 0.25, "documentation": 0.10, "stability": 0.10}
KEY = ["repo_id", "file_path"]


def grade(debt: Column) -> Column:
    """A below 20 points of debt, F from 80."""
    return F.when(debt < 20, "A").when(debt < 40, "B").when(debt < 60, "C").when(debt < 80, "D").otherwise("F")


def health_grade(health: Column) -> Column:
    return F.when(health >= 80, "A").when(health >= 60, "B").when(health >= 40, "C").when(health >= 20, "D").otherwise("F")


def health_label(health: Column) -> Column:
    return F.when(health >= 80, "excellent").when(health >= 60, "good").when(health >= 40, "fair").when(health >= 20, "poor").otherwise("critical")


def measured(symbols: DataFrame) -> DataFrame:
    """Callable symbols with a complexity metric, and their debt: .5 complexity, .25 nesting, .15 parameters, .1 lines."""
    part = lambda c, limit, w: F.least(F.coalesce(c, F.lit(0)) / float(limit), F.lit(1.0)) * 100 * F.lit(w)
    known = F.col("cyclomatic_complexity").isNotNull() | F.col("nesting_depth").isNotNull() | F.col("param_count").isNotNull()
    debt = part(F.col("cyclomatic_complexity"), CC_CRITICAL, 0.5) + part(F.col("nesting_depth"), NESTING_HIGH, 0.25) + part(F.col("param_count"), PARAM_HIGH, 0.15) + part(F.col("line_count"), LINE_HIGH, 0.1)
    return symbols.filter(F.col("kind").isin(*CALLABLE) & known).withColumn("symbol_debt", debt)


def importer_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("repo_id", F.col("dst").alias("file_path")).agg(F.count_distinct("src").alias("importers"))


def debt_scores(symbols: DataFrame, edges: DataFrame, cycles: DataFrame, churn: DataFrame) -> DataFrame:
    """(repo_id, file_path, category, score) of every file with debt in a category.

    complexity: the worst symbol; structural: 80 in a cycle, 90 from 20 importers on, their share of 79 from 11 on;
    maintainability: classes of more than 500 lines, files of more than 20 methods; volatility: commits of 90 days.
    cycles: (repo_id, file_path) of files that lie in a cycle.
    """
    complexity = measured(symbols).groupBy(*KEY).agg(F.max("symbol_debt").alias("score")).withColumn("category", F.lit("complexity"))
    coupled = importer_counts(edges).filter(F.col("importers") > COUPLING_HIGH)
    by_importers = F.when(F.col("importers") >= COUPLING_CRITICAL, 90.0).otherwise(F.least(F.lit(79.0), half_up(F.col("importers") / float(COUPLING_CRITICAL) * 79)))
    structural = coupled.select(*KEY, by_importers.alias("score")).unionByName(cycles.select(*KEY, F.lit(80.0).alias("score"))).groupBy(*KEY).agg(F.max("score").alias("score")).withColumn("category", F.lit("structural"))
    classes = symbols.filter((F.col("kind") == "class") & (F.col("line_count") > GOD_CLASS_LINES)).select(*KEY, F.least(F.lit(100.0), half_up(F.col("line_count") / float(GOD_CLASS_LINES) * 70)).alias("score"))
    methods = symbols.filter(F.col("kind") == "method").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GOD_CLASS_METHODS)
    crowded = methods.select(*KEY, F.least(F.lit(90.0), half_up(F.col("n") / float(GOD_CLASS_METHODS) * 70)).alias("score"))
    maintainability = classes.unionByName(crowded).groupBy(*KEY).agg(F.max("score").alias("score")).withColumn("category", F.lit("maintainability"))
    volatile = F.when(F.col("commits") >= CHURN_CRITICAL, 100.0).otherwise(half_up(F.col("commits") / float(CHURN_CRITICAL) * 100))
    volatility = churn.select("repo_id", F.col("path").alias("file_path"), volatile.alias("score"), F.lit("volatility").alias("category"))
    cols = [*KEY, "category", "score"]
    return complexity.select(*cols).unionByName(structural.select(*cols)).unionByName(maintainability.select(*cols)).unionByName(volatility.select(*cols))


def debt_files(scores: DataFrame) -> DataFrame:
    """(repo_id, file_path, debt, grade): .4 complexity, .35 structural, .25 maintainability, at 80 % where the repository
    has volatility, which gives the other 20 %."""
    at = lambda c: F.max(F.when(F.col("category") == c, F.col("score")).otherwise(0.0))
    per = scores.groupBy(*KEY).agg(at("complexity").alias("c"), at("structural").alias("s"), at("maintainability").alias("m"), at("volatility").alias("v"))
    known = scores.groupBy("repo_id").agg(F.max(F.col("category") == "volatility").alias("dated"))
    share = F.when(F.col("dated"), 0.2).otherwise(0.0)
    debt = half_up((F.col("c") * 0.4 + F.col("s") * 0.35 + F.col("m") * 0.25) * (1 - share) + F.col("v") * share)
    return per.join(known, "repo_id").select(*KEY, debt.alias("debt")).withColumn("grade", grade(F.col("debt")))


def debt_categories(scores: DataFrame) -> DataFrame:
    """(repo_id, category, score, files): the average and the worst file of each category, blended .6/.4, .5/.5, .6/.4, .4/.6."""
    blend = {"complexity": (0.6, 0.4), "structural": (0.5, 0.5), "maintainability": (0.6, 0.4), "volatility": (0.4, 0.6)}
    mean, worst = F.avg("score"), F.max("score")
    out = None
    for c, (a, b) in blend.items():
        out = F.when(F.col("category") == c, a) if out is None else out.when(F.col("category") == c, a)
    agg = scores.withColumn("a", out).groupBy("repo_id", "category").agg(F.max("a").alias("a"), mean.alias("mean"), worst.alias("worst"), F.count(F.lit(1)).alias("files"))
    return agg.select("repo_id", "category", F.least(F.lit(100.0), half_up(F.col("mean") * F.col("a") + F.col("worst") * (1 - F.col("a")))).alias("score"), "files")


def radar(symbols: DataFrame, edges: DataFrame, files: DataFrame, churn: DataFrame) -> DataFrame:
    """(repo_id, the five axes, overall, grade): 100 is best; axes without data are null and leave the blend.

    files: (repo_id, path); a symbol is dead here when nothing imports its file.
    """
    m = measured(symbols).groupBy("repo_id").agg(F.avg("symbol_debt").alias("mean"), F.count_if(F.col("cyclomatic_complexity") >= CC_CRITICAL).alias("critical"))
    complexity = m.select("repo_id", half_up(F.greatest(F.lit(0.0), 100 - F.col("mean") - F.least(F.col("critical") * 10, F.lit(30)))).alias("complexity"))
    per_file = importer_counts(edges)
    coupling = per_file.groupBy("repo_id").agg(
        half_up(F.greatest(F.lit(0.0), 100 - F.count_if(F.col("importers") > COUPLING_HIGH) / F.count(F.lit(1)) * 60 - F.count_if(F.col("importers") >= COUPLING_CRITICAL) * 15)).alias("coupling")
    )
    alive = edges.filter("src <> dst").select("repo_id", F.col("dst").alias("file_path")).distinct().withColumn("alive", F.lit(True))
    big = symbols.groupBy(*KEY).agg(F.count_if((F.col("kind") == "class") & (F.col("line_count") > GOD_CLASS_LINES)).alias("big"), F.count_if(F.col("kind") == "method").alias("methods"), F.count(F.lit(1)).alias("n"))
    per_repo = big.join(alive, KEY, "left").groupBy("repo_id").agg(
        F.sum(F.when(F.col("alive").isNull(), F.col("n")).otherwise(0)).alias("dead"), (F.sum("big") + F.count_if(F.col("methods") > GOD_CLASS_METHODS)).alias("gods")
    )
    maintainability = per_repo.select("repo_id", half_up(F.greatest(F.lit(0.0), 100.0 - F.least(F.col("dead") * 3, F.lit(40)) - F.least(F.col("gods") * 15, F.lit(40)))).alias("maintainability"))
    documentation = symbols.filter(~F.col("kind").isin("type", "const", "enum")).groupBy("repo_id").agg(half_up(F.count_if(F.length("summary") > 5) / F.count(F.lit(1)) * 100).alias("documentation"))
    stability = churn.groupBy("repo_id").agg(
        half_up(F.greatest(F.lit(0.0), 100 - F.count_if(F.col("commits") >= CHURN_HIGH) / F.count(F.lit(1)) * 60 - F.count_if(F.col("commits") >= CHURN_CRITICAL) * 10)).alias("stability")
    )
    out = files.select("repo_id").distinct()
    for axis in (complexity, coupling, maintainability, documentation, stability):
        out = out.join(axis, "repo_id", "left")
    weight, total = F.lit(0.0), F.lit(0.0)
    for name, w in AXES.items():
        weight = weight + F.when(F.col(name).isNotNull(), w).otherwise(0.0)
        total = total + F.coalesce(F.col(name) * w, F.lit(0.0))
    overall = F.when(weight > 0, half_up(total / weight)).otherwise(100.0)
    return out.withColumn("overall", overall).withColumn("grade", health_grade(F.col("overall")))


def radar_difference(before: DataFrame, after: DataFrame, pairs: DataFrame) -> DataFrame:
    """(base, head, axis, delta, verdict) of two radars; pairs: (base, head) repository ids."""
    axes = [*AXES, "overall"]
    tall = lambda r, k, v: r.select(F.col("repo_id").alias(k), F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias(v)) for a in axes])).alias("x")).select(k, "x.axis", f"x.{v}")
    both = pairs.join(tall(before, "base", "was"), "base").join(tall(after, "head", "now"), ["head", "axis"])
    delta = F.col("now") - F.col("was")
    return both.select("base", "head", "axis", delta.alias("delta"), F.when(delta > 0, "improved").when(delta < 0, "declined").when(delta == 0, "unchanged").otherwise("unknown").alias("verdict"))


def antipatterns(symbols: DataFrame, edges: DataFrame, cycles: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """(repo_id, file_path, id, pattern, severity, n): cycles, god classes, coupling, deep nesting, dead code, long parameter
    lists, duplicates.

    cycles: (repo_id, file_path, component); duplicates: (repo_id, file_path, id, n).
    """
    cols = ["repo_id", "file_path", "id", "pattern", "severity", "n"]
    nothing = F.lit(None).cast("string")
    row = lambda df, pattern, severity, n: df.select("repo_id", "file_path", "id", F.lit(pattern).alias("pattern"), severity.alias("severity"), n.cast("bigint").alias("n"))
    rings = cycles.groupBy("repo_id", "component").agg(F.count(F.lit(1)).alias("n")).withColumn("file_path", F.col("component")).withColumn("id", nothing)
    classes = symbols.filter((F.col("kind") == "class") & (F.col("line_count") > GOD_CLASS_LINES))
    crowded = symbols.filter(F.col("kind") == "method").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GOD_CLASS_METHODS).withColumn("id", nothing)
    coupled = importer_counts(edges).filter(F.col("importers") > COUPLING_HIGH).withColumn("id", nothing)
    nested = symbols.filter(F.col("nesting_depth") > NESTING_LIMIT)
    alive = edges.filter("src <> dst").select("repo_id", F.col("dst").alias("file_path")).distinct()
    dead = symbols.join(alive, KEY, "left_anti")  # whatever is exported or not
    wide = symbols.filter(F.col("kind").isin(*CALLABLE) & (F.col("param_count") > PARAM_LIMIT))
    error, warning = F.lit("error"), F.lit("warning")
    parts = [
        row(rings, "circular_dependency", error, F.col("n")), row(classes, "god_class", error, F.col("line_count")), row(crowded, "god_class_methods", error, F.col("n")),
        row(coupled, "high_coupling", F.when(F.col("importers") > COUPLING_CRITICAL, error).otherwise(warning), F.col("importers")), row(nested, "deep_nesting", error, F.col("nesting_depth")),
        row(dead, "dead_export", warning, F.lit(1)), row(wide, "long_parameter_list", F.when(F.col("param_count") > PARAM_ERROR, error).otherwise(warning), F.col("param_count")),
    ]
    if duplicates is not None:
        parts.append(row(duplicates, "duplicate_code", warning, F.col("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*cols).distinct()


#: Limits of the antipattern checks.
NESTING_LIMIT, PARAM_LIMIT, PARAM_ERROR = 5, 7, 10


def antipattern_health(findings: DataFrame) -> DataFrame:
    """(repo_id, errors, warnings, health): 100 less 10 an error and 2 a warning, in 0 .. 100."""
    error = F.col("severity") == "error"
    n = findings.groupBy("repo_id").agg(F.count_if(error).alias("errors"), F.count_if(~error).alias("warnings"))
    return n.withColumn("health", F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.col("errors") * 10 - F.col("warnings") * 2)).cast("bigint"))


def refactoring(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, subject, finding, impact, effort): functions to extract, parameters to group, classes to split, small
    functions to inline, conditions to simplify; subject is a symbol id, or a file's path."""
    call = symbols.filter(F.col("kind").isin(*CALLABLE))
    cc, lc, pc, nd, rc = (F.coalesce(c, F.lit(0)) for c in ("cyclomatic_complexity", "line_count", "param_count", "nesting_depth", "return_count"))
    effort = F.when(lc > 100, "large").when(lc > 50, "medium").when(lc > 20, "small").otherwise("trivial")
    level = lambda high, medium: F.when(high, "high").when(medium, "medium").otherwise("low")
    row = lambda df, subject, finding, impact, eff: df.select("repo_id", F.col(subject).alias("subject"), F.lit(finding).alias("finding"), impact.alias("impact"), eff.alias("effort"))
    crowded = symbols.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("kind").alias("kinds")).filter((F.col("n") > 15) & (F.col("kinds") >= 3))
    once = importer_counts(edges).filter(F.col("importers") == 1).select(*KEY)
    parts = [
        row(call.filter((lc > 50) & (cc > 10)), "id", "extract_function", level((cc > 30) | (lc > 150), (cc > 15) | (lc > 80)), effort),
        row(call.filter(pc > 5), "id", "introduce_parameter_object", level(pc > 10, pc > 7), effort),
        row(crowded, "file_path", "extract_class", level(F.col("n") > 30, F.col("n") > 20), F.when(F.col("n") > 30, "large").otherwise("medium")),
        row(call.filter((lc > 0) & (lc <= 3)).join(once, KEY, "left_semi"), "id", "inline_function", F.lit("low"), F.lit("trivial")),
        row(call.filter((nd > 4) & (rc > 3)), "id", "simplify_conditional", level(nd > 7, nd > 5), effort),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = lambda c, names: F.coalesce(*[F.when(F.col(c) == n, i) for i, n in enumerate(names)])
    return out.distinct().withColumn("impact_rank", order("impact", ("high", "medium", "low"))).withColumn("effort_rank", order("effort", ("trivial", "small", "medium", "large")))


def snapshot(symbols: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, files, symbols, edges, avg_cc, avg_coupling): avg_coupling is the mean of Ce + Ca over files with edges."""
    ends = edges.select("repo_id", "src", "dst").distinct()
    degree = ends.select("repo_id", F.explode(F.array("src", "dst")).alias("file")).groupBy("repo_id", "file").agg(F.count(F.lit(1)).alias("d")).groupBy("repo_id").agg(half_up(F.avg("d"), 3).alias("avg_coupling"))
    a = files.groupBy("repo_id").agg(F.count_distinct("path").alias("files"))
    b = symbols.groupBy("repo_id").agg(F.count(F.lit(1)).alias("symbols"), half_up(F.avg("cyclomatic_complexity"), 3).alias("avg_cc"))
    c = ends.groupBy("repo_id").agg(F.count(F.lit(1)).alias("edges"))
    return a.join(b, "repo_id", "left").join(c, "repo_id", "left").join(degree, "repo_id", "left").na.fill(0, ["symbols", "edges"])
