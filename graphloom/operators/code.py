"""Code relations: sources of symbols, calls, types, references by kind, change checks, refactoring candidates."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.tables import spread

CALL = r"\b([A-Za-z_]\w*)\s*\("
#: Words before a parenthesis that are no call.
NOT_CALLS = ["if", "for", "while", "switch", "catch", "return", "function", "func", "def", "class", "new", "typeof", "sizeof", "super", "with", "elif", "and", "or", "not", "in", "int", "string"]


def spans(symbols: DataFrame) -> DataFrame:
    """(repo_id, path, id, name, kind, start, end): distinct symbols with a sound span."""
    return symbols.filter("id is not null and start_byte >= 0 and end_byte > start_byte").select(
        "repo_id", F.col("file_path").alias("path"), "id", "name", "kind", F.col("start_byte").alias("start"), F.col("end_byte").alias("end")
    ).distinct()


def sources(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, id, name, kind, source binary): bytes of every symbol whose span lies in its file's content."""
    f = files.filter(F.col("raw_content").isNotNull()).select("repo_id", "path", "raw_content")
    j = spans(symbols).join(f, ["repo_id", "path"]).filter(F.col("end") <= F.octet_length("raw_content"))
    return j.select("repo_id", "id", "name", "kind", F.substring("raw_content", F.col("start") + 1, F.col("end") - F.col("start")).alias("source")).distinct()


def file_slice(files: DataFrame, first: int, last: int) -> DataFrame:
    """(repo_id, path, lines): lines first .. last of every file, numbered from 1, joined by newlines."""
    parts = F.split(F.col("raw_content").cast("string"), "\n", -1)
    return files.filter(F.col("raw_content").isNotNull()).select("repo_id", "path", F.array_join(F.slice(parts, first, last - first + 1), "\n").alias("lines")).distinct()


def calls(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, src, dst): symbols that a function's source calls by name, within the repository; not itself."""
    s = sources(symbols, files).filter(F.col("kind").isin("function", "method"))
    found = F.array_except(F.array_distinct(F.regexp_extract_all(F.col("source").cast("string"), F.lit(CALL), F.lit(1))), F.array(*map(F.lit, NOT_CALLS)))
    names = symbols.filter("id is not null and name is not null").filter(F.col("kind").isin("function", "method")).select("repo_id", "name", F.col("id").alias("dst")).distinct()
    return s.select("repo_id", F.col("id").alias("src"), F.explode(found).alias("name")).join(names, ["repo_id", "name"]).filter("src <> dst").select("repo_id", "src", "dst").distinct()


def type_relations(symbols: DataFrame) -> DataFrame:
    """(repo_id, id, relation, target, target_id): extends and implements parsed from signatures, targets by name.

    Several types of one name resolve to the smallest id; what the repository does not declare keeps a null id.
    """
    sig = F.regexp_replace("signature", r"<[^<>]*>", "")
    t = symbols.filter(F.col("kind").isin("class", "interface", "struct") & F.col("id").isNotNull())
    python = F.split(F.regexp_extract(sig, r"class\s+\w+\s*\(([^)]*)\)", 1), r"\s*,\s*")
    ext = F.split(F.regexp_extract(sig, r"\bextends\s+([\w.]+(?:\s*,\s*[\w.]+)*)", 1), r"\s*,\s*")
    imp = F.split(F.regexp_extract(sig, r"\bimplements\s+([\w.]+(?:\s*,\s*[\w.]+)*)", 1), r"\s*,\s*")
    rel = lambda a, r: F.transform(a, lambda x: F.struct(F.lit(r).alias("relation"), x.alias("target")))
    pairs = t.select("repo_id", "id", F.explode(F.concat(rel(python, "extends"), rel(ext, "extends"), rel(imp, "implements"))).alias("p")).select("repo_id", "id", "p.relation", "p.target").filter("target <> ''").distinct()
    ids = t.groupBy("repo_id", F.col("name").alias("target")).agg(F.min("id").alias("target_id"))
    return pairs.join(ids, ["repo_id", "target"], "left").select("repo_id", "id", "relation", "target", "target_id")


def implementors(relations: DataFrame) -> DataFrame:
    """(repo_id, target, implementors): how many types extend or implement each name."""
    return relations.groupBy("repo_id", "target").agg(F.count_distinct("id").alias("implementors"))


def decorated(files: DataFrame) -> DataFrame:
    """(repo_id, path, decorator, target): @name lines directly above a declaration."""
    pattern = r"(?m)^[ \t]*@([A-Za-z_][\w.]*)[^\n]*\n[ \t]*(?:(?:export|public|private|protected|static|async|abstract|final)\s+)*(?:def|class|function|interface|[\w<>\[\]]+)\s+(\w+)"
    text = F.col("raw_content").cast("string")
    names, targets = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return files.filter(F.col("raw_content").isNotNull()).select("repo_id", "path", F.explode(F.arrays_zip(names.alias("decorator"), targets.alias("target"))).alias("z")).select("repo_id", "path", "z.decorator", "z.target").distinct()


def reference_kinds(names: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, name, kind, lines): lines that hold a name, by the first that applies: comment, import, string, call, other.

    Words of a line are joined with the names, so a line meets only the names it holds.
    """
    lines = files.filter(F.col("raw_content").isNotNull()).select("repo_id", "path", F.posexplode(F.split(F.col("raw_content").cast("string"), "\n", -1)).alias("i", "line"))
    word = F.array_distinct(F.regexp_extract_all("line", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    hit = lines.select("repo_id", "path", "i", "line", F.explode(word).alias("name")).join(names.select("repo_id", "name").distinct(), ["repo_id", "name"]).distinct()
    name = F.col("name")
    kind = (
        F.when(F.col("line").rlike(r"^\s*(//|#|\*|/\*)"), "comment").when(F.col("line").rlike(r"^\s*(import|from|export .* from|use|require)\b"), "import")
        .when(F.regexp_like("line", F.concat(F.lit("[\"'`][^\"'`]*\\b"), name, F.lit("\\b[^\"'`]*[\"'`]"))), "string").when(F.regexp_like("line", F.concat(F.lit("\\b"), name, F.lit("\\s*\\("))), "call").otherwise("other")
    )
    return hit.groupBy("repo_id", "name", kind.alias("kind")).agg(F.count(F.lit(1)).alias("lines"))


def missing_partners(baskets: DataFrame, co: DataFrame, at_least: float = 0.4, mega: int = 30) -> DataFrame:
    """(g, b, missing): files that a commit left out although they go with one of its files at that confidence."""
    sizes = baskets.groupBy("g", "b").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k").between(1, mega)).select("g", "b")
    held = baskets.join(sizes, ["g", "b"])
    strong = co.filter(F.col("confidence") >= at_least).select("g", F.col("target").alias("item"), "partner")
    predicted = held.join(strong, ["g", "item"]).select("g", "b", F.col("partner").alias("item")).distinct()
    return predicted.join(held, ["g", "b", "item"], "left_anti").select("g", "b", F.col("item").alias("missing"))


def symbol_history(symbols: DataFrame, commits: DataFrame, as_of: int) -> DataFrame:
    """(repo_id, id, commits, first_at, last_at, churn): commits of the symbol's file; churn per 90 days since the first."""
    per = commits.filter(F.col("at") <= as_of).groupBy("repo_id", F.col("path").alias("file_path")).agg(F.count_distinct("sha").alias("commits"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    days = F.greatest(F.lit(1.0), (F.lit(as_of) - F.col("first_at")) / 86400.0)
    churn = F.floor(F.col("commits") / days * 90 * 100 + 0.5) / 100
    return symbols.filter("id is not null").select("repo_id", "id", "file_path").distinct().join(per, ["repo_id", "file_path"]).select("repo_id", "id", "commits", "first_at", "last_at", churn.alias("churn"))


def context_pool(seeds: DataFrame, edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, score, why): seeds (node, score) with what they lead to and what leads to them, the best `limit`; ties by node."""
    out = seeds.join(edges, seeds.node == edges.src).select(F.col("dst").alias("node"), (F.col("score") * 0.6).alias("score"), F.lit("uses").alias("why"))
    into = seeds.join(edges, seeds.node == edges.dst).select(F.col("src").alias("node"), (F.col("score") * 0.4).alias("score"), F.lit("used_by").alias("why"))
    every = seeds.select("node", "score", F.lit("match").alias("why")).unionByName(out).unionByName(into)
    best = every.groupBy("node").agg(F.max_by(F.struct("score", "why"), F.struct("score", "why")).alias("b")).select("node", "b.score", "b.why")
    return best.orderBy(F.desc("score"), "node").limit(limit)


def syntax_nodes(files: DataFrame, node_type: str) -> DataFrame:
    """(repo_id, path, line, end_line, text): nodes of a type (a class of Python's `ast`) in Python files that parse, with
    their source on one line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = getattr(ast, node_type)
        for b in batches:
            rows: list[tuple] = []
            for repo, path, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                text = raw.decode("utf-8", "replace").lstrip("\ufeff")
                try:
                    tree = ast.parse(text)
                except (SyntaxError, ValueError, RecursionError):
                    continue
                for n in ast.walk(tree):
                    if isinstance(n, wanted) and hasattr(n, "lineno"):
                        rows.append((repo, path, n.lineno, n.end_lineno, " ".join((ast.get_source_segment(text, n) or "").split())))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["repo_id", "path", "line", "end_line", "text"])

    py = files.filter(F.col("raw_content").isNotNull() & F.col("path").endswith(".py")).select("repo_id", "path", "raw_content")
    return spread(py).mapInArrow(run, "repo_id string, path string, line int, end_line int, text string").distinct()


def members(symbols: DataFrame) -> DataFrame:
    """(repo_id, owner, name): methods by the type in whose bytes they lie, the last-starting one that holds them.

    The join is on the file; the container that starts last is taken by one aggregation.
    """
    s = spans(symbols)
    types = s.filter(F.col("kind").isin("class", "interface", "struct")).select("repo_id", "path", F.col("id").alias("owner"), F.col("start").alias("a"), F.col("end").alias("z"))
    methods = s.filter("kind = 'method'").select("repo_id", "path", "id", "name", "start", "end")
    inside = methods.join(types, ["repo_id", "path"]).filter((F.col("a") <= F.col("start")) & (F.col("end") <= F.col("z")))
    return inside.groupBy("repo_id", "path", "id", "name").agg(F.max_by("owner", F.struct("a", "owner")).alias("owner")).select("repo_id", "owner", "name").distinct()


def missing_methods(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_id, id, target_id, implemented, missing): for every type and one it extends or implements, how many of the
    target's methods it has itself and which it lacks."""
    m = members(symbols).groupBy("repo_id", "owner").agg(F.array_sort(F.collect_set("name")).alias("names"))
    r = relations.filter("target_id is not null and id <> target_id").select("repo_id", "id", "target_id").distinct()
    want = r.join(m.select("repo_id", F.col("owner").alias("target_id"), F.col("names").alias("wanted")), ["repo_id", "target_id"])
    both = want.join(m.select("repo_id", F.col("owner").alias("id"), F.col("names").alias("own")), ["repo_id", "id"], "left")
    own = F.coalesce("own", F.array().cast("array<string>"))
    return both.select("repo_id", "id", "target_id", F.size(F.array_intersect("wanted", own)).alias("implemented"), F.array_join(F.array_except("wanted", own), ",").alias("missing"))
