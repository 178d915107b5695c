"""Checks before and after a change: references, deletion, moves, differences of symbols, coverage, plans, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import exported, is_test_path

WORD = r"[A-Za-z_][A-Za-z0-9_]*"


def reference_lines(names: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, name, path, line_no): lines that hold a name as a whole word.  names: (repo_id, name)."""
    lines = files.filter(F.col("raw_content").isNotNull()).select("repo_id", "path", F.posexplode(F.split(F.col("raw_content").cast("string"), "\n", -1)).alias("i", "line"))
    word = F.array_distinct(F.regexp_extract_all("line", F.lit(WORD), F.lit(0)))
    hit = lines.select("repo_id", "path", (F.col("i") + 1).alias("line_no"), F.explode(word).alias("name"))
    return hit.join(names.select("repo_id", "name").distinct(), ["repo_id", "name"]).select("repo_id", "name", "path", "line_no").distinct()


def delete_safety(symbols: DataFrame, files: DataFrame, entry: Column | None = None) -> DataFrame:
    """(repo_id, id, live_references, test_references, exported, entry_point, verdict) of symbols (repo_id, id, name,
    file_path, signature): lines outside its own file that hold its name, in tests and elsewhere.

    verdict: blocked by live references, risky where it is exported, an entry point or tested, else safe.
    """
    s = symbols.filter("id is not null and name is not null")
    refs = reference_lines(s, files).withColumn("in_test", is_test_path(F.col("path")))
    # references of a name are counted per file before they meet the symbols that bear it
    per_file = refs.groupBy("repo_id", "name", "path").agg(F.count_if(~F.col("in_test")).alias("live"), F.count_if(F.col("in_test")).alias("test"))
    total = per_file.groupBy("repo_id", "name").agg(F.sum("live").alias("all_live"), F.sum("test").alias("all_test"))
    own = per_file.select("repo_id", "name", F.col("path").alias("file_path"), F.col("live").alias("own_live"), F.col("test").alias("own_test"))
    is_entry = F.lit(False) if entry is None else F.coalesce(entry, F.lit(False))
    j = s.select("repo_id", "id", "name", "file_path", F.coalesce(exported(F.col("signature")), F.lit(False)).alias("exported"), is_entry.alias("entry_point")).distinct()
    j = j.join(total, ["repo_id", "name"], "left").join(own, ["repo_id", "name", "file_path"], "left").na.fill(0, ["all_live", "all_test", "own_live", "own_test"])
    live, test = F.col("all_live") - F.col("own_live"), F.col("all_test") - F.col("own_test")
    verdict = F.when(live > 0, "blocked").when(F.col("exported") | F.col("entry_point") | (test > 0), "risky").otherwise("safe")
    return j.select("repo_id", "id", live.alias("live_references"), test.alias("test_references"), "exported", "entry_point", verdict.alias("verdict"))


def rename_conflicts(symbols: DataFrame, renames: DataFrame) -> DataFrame:
    """(repo_id, id, new_name, conflict): whether the new name is taken, in the same file or elsewhere in the repository.
    renames: (repo_id, id, new_name)."""
    s = symbols.filter("id is not null").select("repo_id", "id", "name", "file_path").distinct()
    asked = renames.join(s.select("repo_id", "id", "file_path"), ["repo_id", "id"])
    there = s.select("repo_id", F.col("name").alias("new_name"), F.col("file_path").alias("other")).distinct()
    met = asked.join(there, ["repo_id", "new_name"], "left")
    level = F.max(F.when(F.col("other") == F.col("file_path"), 2).when(F.col("other").isNotNull(), 1).otherwise(0))
    return met.groupBy("repo_id", "id", "new_name").agg(level.alias("l")).select("repo_id", "id", "new_name", F.when(F.col("l") == 2, "same_file").when(F.col("l") == 1, "repository").otherwise("none").alias("conflict"))


def moved(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """(repo_id, src, dst) after files moved; moves: (repo_id, old, new)."""
    a = moves.select("repo_id", F.col("old").alias("src"), F.col("new").alias("s2"))
    b = moves.select("repo_id", F.col("old").alias("dst"), F.col("new").alias("d2"))
    j = edges.join(a, ["repo_id", "src"], "left").join(b, ["repo_id", "dst"], "left")
    return j.select("repo_id", F.coalesce("s2", "src").alias("src"), F.coalesce("d2", "dst").alias("dst")).filter("src <> dst").distinct()


def move_safety(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """(repo_id, old, new, importers, new_cycles): files whose imports must be rewritten, and mutual imports that were not
    there before the move."""
    after = moved(edges, moves)
    pairs = lambda e: e.filter("src < dst").join(e.select("repo_id", F.col("src").alias("dst"), F.col("dst").alias("src")), ["repo_id", "src", "dst"], "left_semi").select("repo_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    fresh = pairs(after).join(pairs(moved(edges, moves.limit(0))), ["repo_id", "a", "b"], "left_anti")
    cycles = fresh.select("repo_id", F.explode(F.array("a", "b")).alias("new")).groupBy("repo_id", "new").agg(F.count(F.lit(1)).alias("new_cycles"))
    importers = edges.groupBy("repo_id", F.col("dst").alias("old")).agg(F.count_distinct("src").alias("importers"))
    return moves.join(importers, ["repo_id", "old"], "left").join(cycles, ["repo_id", "new"], "left").na.fill(0, ["importers", "new_cycles"]).select("repo_id", "old", "new", "importers", "new_cycles")


def symbol_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo_id, id, change) between two versions (repo_id, id, signature, body): added, deleted, signature_changed, modified."""
    a = before.select("repo_id", "id", F.struct("signature", "body").alias("x")).distinct()
    b = after.select("repo_id", "id", F.struct("signature", "body").alias("y")).distinct()
    change = (
        F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "deleted").when(~F.col("x.signature").eqNullSafe(F.col("y.signature")), "signature_changed").when(~F.col("x.body").eqNullSafe(F.col("y.body")), "modified")
    )
    return a.join(b, ["repo_id", "id"], "full").select("repo_id", "id", change.alias("change")).filter(F.col("change").isNotNull())


def review_priority(breaks: Column, impacted: Column, band: Column, gaps: Column) -> Column:
    """critical: signatures break with more than ten files behind them or high risk; high: one of the two, or five files."""
    n, high = F.coalesce(impacted, F.lit(0)), F.coalesce(band == "high", F.lit(False))
    return (
        F.when((breaks > 0) & ((n > 10) | high), "critical").when((breaks > 0) | (n > 5) | high, "high").when((n >= 1) | F.coalesce(band == "review", F.lit(False)) | (gaps > 0), "medium").otherwise("low")
    )


def coverage_map(symbols: DataFrame, coverage: DataFrame) -> DataFrame:
    """(repo_id, id, lines, covered, status): lines of a report (repo_id, path, line, hits) inside each symbol (repo_id, path,
    id, first_line, last_line); status covered, partial or uncovered; symbols without reported lines are left out.

    A range join by blocks of 64 lines.
    """
    block = lambda c: F.expr(f"cast({c} div 64 as int)")
    s = symbols.filter("first_line <= last_line").select("repo_id", "path", "id", "first_line", "last_line", F.explode(F.sequence(block("first_line"), block("last_line"))).alias("b"))
    c = coverage.select("repo_id", "path", "line", "hits", block("line").alias("b"))
    met = s.join(c, ["repo_id", "path", "b"]).filter("line between first_line and last_line")
    n = met.groupBy("repo_id", "id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("hits") > 0).alias("covered"))
    return n.withColumn("status", F.when(F.col("covered") == 0, "uncovered").when(F.col("covered") == F.col("lines"), "covered").otherwise("partial"))


#: The steps of a refactoring, in order.
STEPS = {
    "extract_function": ["cover the function with tests", "name the part to extract", "move it into a function of its own", "pass what it needs as parameters", "run the tests"],
    "introduce_parameter_object": ["cover the callers with tests", "declare a type that holds the parameters", "take the type beside them", "change the callers", "drop the old parameters", "run the tests"],
    "extract_class": ["group the symbols by what they share", "move one group into a file of its own", "re-export it from the old place", "change the importers", "drop the re-export", "run the tests"],
    "inline_function": ["find all callers", "put the body in place of the call", "delete the function", "run the tests"],
    "simplify_conditional": ["cover each branch with a test", "return early where a branch ends", "name long conditions", "run the tests"],
}


def refactoring_plan(findings: DataFrame) -> DataFrame:
    """(repo_id, subject, finding, step_no, step): the steps of every finding (repo_id, subject, finding)."""
    steps = F.create_map(*[x for k, v in STEPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return findings.select("repo_id", "subject", "finding").distinct().select("repo_id", "subject", "finding", F.posexplode(steps[F.col("finding")]).alias("i", "step")).select("repo_id", "subject", "finding", (F.col("i") + 1).alias("step_no"), "step")


def readiness(changed: DataFrame, missing: DataFrame, risk: DataFrame) -> DataFrame:
    """(g, b, files, missing, worst, tests, verdict) of commits: changed (g, b, item), partners that are missing (g, b,
    missing), risk bands of files (g, item, band).

    no_go: a file of high risk without a test in the commit; review: missing partners, or a file to review; else go.
    """
    order = F.coalesce(F.when(F.col("band") == "high", 2).when(F.col("band") == "review", 1), F.lit(0))
    per = changed.join(risk, ["g", "item"], "left").groupBy("g", "b").agg(F.count_distinct("item").alias("files"), F.max(order).alias("w"), F.count_if(is_test_path(F.col("item"))).alias("tests"))
    gone = missing.groupBy("g", "b").agg(F.count_distinct("missing").alias("missing"))
    j = per.join(gone, ["g", "b"], "left").na.fill(0, ["missing"])
    verdict = F.when((F.col("w") == 2) & (F.col("tests") == 0), "no_go").when((F.col("missing") > 0) | (F.col("w") >= 1), "review").otherwise("go")
    return j.select("g", "b", "files", "missing", F.when(F.col("w") == 2, "high").when(F.col("w") == 1, "review").otherwise("low").alias("worst"), "tests", verdict.alias("verdict"))


def columns_of(provider: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_id, entity, column, description, tags, symbol_id): columns that providers describe, one row each, with the symbol
    that bears the entity's name, if there is one.  provider: (repo_id, entity, metadata JSON with `columns`)."""
    schema = "struct<columns:array<struct<name:string,description:string,tags:array<string>>>>"
    c = provider.select("repo_id", "entity", F.explode(F.from_json("metadata", schema)["columns"]).alias("c")).select("repo_id", "entity", F.col("c.name").alias("column"), F.col("c.description").alias("description"), F.coalesce("c.tags", F.array().cast("array<string>")).alias("tags"))
    first = symbols.filter("name is not null and id is not null").groupBy("repo_id", F.col("name").alias("entity")).agg(F.min("id").alias("symbol_id"))
    return c.join(first, ["repo_id", "entity"], "left")


def search_columns(columns: DataFrame, text: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Columns whose name or description holds a text, whatever its case, and that bear all the tags."""
    if text is not None:
        columns = columns.filter(F.contains(F.lower("column"), F.lit(text.lower())) | F.coalesce(F.contains(F.lower("description"), F.lit(text.lower())), F.lit(False)))
    if tags:
        columns = columns.filter(F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0)
    return columns


def any_predicate(meta: Column, key: str, wanted: str) -> Column:
    """Whether a list under `key` of a JSON object holds an entry of which `predicates` names the wanted one."""
    entries = F.from_json(meta, f"struct<{key}:array<struct<predicates:array<string>>>>")[key]
    return F.coalesce(F.exists(entries, lambda e: F.array_contains(e["predicates"], wanted)), F.lit(False))


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob of whole paths: ** crosses folders, * and ? do not, {a,b} is a choice."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out.append("(?:" + "|".join(glob_pattern(x)[1:-1] for x in glob[i + 1 : end].split(",")) + ")")
            i = end
        else:
            out.append("\\" + c if c in ".^$+()[]|\\" else c)
        i += 1
    return "^" + "".join(out) + "$"


def in_scope(path: Column, scope: str, by_folder: bool = True) -> Column:
    """Whether a path lies in a scope: the folder itself and what is below; otherwise anything that begins with the text."""
    return (path == scope) | path.startswith(scope.rstrip("/") + "/") if by_folder else path.startswith(scope)
