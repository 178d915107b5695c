"""The dependency graph of an index: file edges, injected edges, references between symbols, edges across repositories.

Inputs are the rows of `extract.process` and the targets of `extract.resolve`; every operator is a few equi-joins of
small rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.scalars import directory, is_test_path

#: Names that a wildcard import offers from one file at most; a file with more offers none of them, and is counted.
FAN_OUT = 100
HOPS = 3


def file_edges(resolved: DataFrame) -> DataFrame:
    """(repo_id, src, dst, specifier, edge_type): one edge per pair of files; the record that comes first in its file
    gives specifier and type; no self loops."""
    first = F.min_by(F.struct("specifier", "form"), F.struct("position", "specifier"))
    e = resolved.filter("source <> target").groupBy("repo_id", F.col("source").alias("src"), F.col("target").alias("dst")).agg(first.alias("r"))
    return e.select("repo_id", "src", "dst", "r.specifier", F.col("r.form").alias("edge_type"))


def injected_edges(rows: DataFrame) -> DataFrame:
    """(repo_id, src, dst, specifier, edge_type = di): from a file that asks for a type to every file that provides it.

    Not to itself, and not from production code to a provider in a test.
    """
    want = rows.filter("what = 'consumes'").select("repo_id", F.col("path").alias("src"), "name").distinct()
    give = rows.filter("what = 'provides'").select("repo_id", F.col("path").alias("dst"), "name").distinct()
    met = want.join(give, ["repo_id", "name"]).filter("src <> dst").filter(is_test_path(F.col("src")) | ~is_test_path(F.col("dst")))
    return met.select("repo_id", "src", "dst", F.col("name").alias("specifier"), F.lit("di").alias("edge_type"))


def adjacency(local: DataFrame, across: DataFrame, with_injected: bool = False) -> DataFrame:
    """(src_repo, src, dst_repo, dst, specifier) of local edges and of `cross_repo` rows, each once, without self loops."""
    kept = local if with_injected else local.filter("edge_type <> 'di'")
    a = kept.select(F.col("repo_id").alias("src_repo"), "src", F.col("repo_id").alias("dst_repo"), "dst", "specifier")
    b = across.select(F.col("repo_id").alias("src_repo"), F.col("source").alias("src"), F.col("target_repo_id").alias("dst_repo"), F.col("target").alias("dst"), "specifier")
    return a.unionByName(b).filter((F.col("src_repo") != F.col("dst_repo")) | (F.col("src") != F.col("dst"))).distinct()


def links(repos: DataFrame, most: int = 8) -> DataFrame:
    """(repo_id, linked, relation, position): repositories beside, inside and around one another, by their root paths.

    The nearest `most` hold: parents first, then nested ones, then siblings, by path.
    """
    r = repos.filter("id is not null and root_path is not null").select("id", F.regexp_replace("root_path", "/+$", "").alias("root")).distinct()
    up = r.select("id", "root", directory(F.col("root")).alias("folder"))
    # a repository lies inside another if that one's root is among its ancestors
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("root", "/")) - 1, F.lit(1))), lambda i: F.array_join(F.slice(F.split("root", "/"), 1, i), "/"))
    inside = r.select(F.col("id").alias("inner"), "root", F.explode(above).alias("at")).filter("at <> root").join(r.select(F.col("id").alias("outer"), F.col("root").alias("at")), "at")
    nested = inside.select(F.col("outer").alias("repo_id"), F.col("inner").alias("linked"), F.lit("nested").alias("relation"), F.lit(1).alias("rank"), F.col("root").alias("path"))
    parent = inside.select(F.col("inner").alias("repo_id"), F.col("outer").alias("linked"), F.lit("parent").alias("relation"), F.lit(0).alias("rank"), F.col("at").alias("path"))
    # of siblings the next `most` in order of their paths are enough, so a folder of many repositories gives no pairs of all
    order = W.partitionBy("folder").orderBy("root", "id")
    numbered = up.withColumn("n", F.row_number().over(order)).withColumn("of", F.count(F.lit(1)).over(W.partitionBy("folder")))
    offsets = numbered.select(F.col("id").alias("repo_id"), "folder", "of", F.col("n").alias("own"), F.explode(F.sequence(F.lit(1), F.lit(most + 1))).alias("n")).filter("n <= of and n <> own")
    beside = offsets.join(numbered.select(F.col("id").alias("linked"), "folder", "n", "root"), ["folder", "n"]).select("repo_id", "linked", F.lit("sibling").alias("relation"), F.lit(2).alias("rank"), F.col("root").alias("path"))
    every = parent.unionByName(nested).unionByName(beside)
    placed = every.withColumn("position", F.row_number().over(W.partitionBy("repo_id").orderBy("rank", "path", "linked")))
    return placed.filter(F.col("position") <= most).select("repo_id", "linked", "relation", "position")


def reverse_links(rows: DataFrame) -> DataFrame:
    """Links with their inverses: nested and parent change places."""
    other = F.when(F.col("relation") == "nested", "parent").when(F.col("relation") == "parent", "nested").otherwise(F.col("relation"))
    return rows.select("repo_id", "linked", "relation").unionByName(rows.select(F.col("linked").alias("repo_id"), F.col("repo_id").alias("linked"), other.alias("relation"))).distinct()


def changed_links(stored: DataFrame, live: DataFrame) -> DataFrame:
    """(repo_id) of repositories whose links (repo_id, linked, stamp) differ from the stored ones."""
    a, b = stored.select("repo_id", "linked", F.col("stamp").alias("x")), live.select("repo_id", "linked", F.col("stamp").alias("y"))
    return a.join(b, ["repo_id", "linked"], "full").filter(~F.col("x").eqNullSafe(F.col("y"))).select("repo_id").distinct()


def offered(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_id, source, name, target_file, target_symbol, confidence): what imports bring into a file.

    Named imports offer the symbols they name, others all top-level ones of the target (confidence wildcard), as far as
    `FAN_OUT` allows; re-exports are followed over `HOPS` files.
    """
    s = symbols.filter(F.col("kind") != "property").select("repo_id", F.col("file_path").alias("target_file"), "name", F.col("id").alias("target_symbol"))
    sizes = s.groupBy("repo_id", "target_file").agg(F.count(F.lit(1)).alias("declared"))
    reach = resolved.select("repo_id", "source", F.col("target").alias("target_file"), "names").distinct()
    passes = resolved.filter("form = 're-export'").select("repo_id", F.col("source").alias("target_file"), F.col("target").alias("behind")).distinct()
    every = reach
    step = reach
    for _ in range(HOPS):
        step = step.join(passes, ["repo_id", "target_file"]).select("repo_id", "source", F.col("behind").alias("target_file"), "names").filter("source <> target_file").distinct()
        every = every.unionByName(step)
    every = every.distinct()
    whole = F.size(F.filter("names", lambda n: n != "*")) == 0
    named = every.filter(~whole).select("repo_id", "source", "target_file", F.explode("names").alias("name")).join(s, ["repo_id", "target_file", "name"]).withColumn("confidence", F.lit("named"))
    small = sizes.filter(F.col("declared") <= FAN_OUT).select("repo_id", "target_file")
    wild = every.filter(whole).select("repo_id", "source", "target_file").distinct().join(small, ["repo_id", "target_file"]).join(s, ["repo_id", "target_file"]).withColumn("confidence", F.lit("wildcard"))
    cols = ["repo_id", "source", "name", "target_file", "target_symbol"]
    return named.select(*cols, "confidence").unionByName(wild.select(*cols, "confidence")).groupBy(*cols).agg(F.min("confidence").alias("confidence"))


def symbol_refs(uses: DataFrame, resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_id, source_file, source_symbol, target_file, target_symbol, name, confidence, ref_count).

    uses: (repo_id, path, symbol_id, name, amount), occurrences at the innermost symbol around them.  A name that the
    file declares itself shadows an import.
    """
    own = symbols.select("repo_id", F.col("file_path").alias("source"), "name").distinct()
    offers = offered(resolved, symbols).join(own, ["repo_id", "source", "name"], "left_anti")
    met = uses.withColumnRenamed("path", "source").join(offers, ["repo_id", "source", "name"])
    return met.groupBy("repo_id", F.col("source").alias("source_file"), F.col("symbol_id").alias("source_symbol"), "target_file", "target_symbol", "name").agg(
        F.min("confidence").alias("confidence"), F.sum("amount").alias("ref_count")
    )


def afferent_symbols(refs: DataFrame) -> DataFrame:
    """(repo_id, target_symbol, afferent, references): distinct symbols (or files, at top level) that refer to a symbol."""
    source = F.coalesce("source_symbol", "source_file")
    return refs.groupBy("repo_id", "target_symbol").agg(F.count_distinct(source).alias("afferent"), F.sum("ref_count").alias("references"))


def afferent_across(across: DataFrame) -> DataFrame:
    """(target_repo_id, target, importers): files of other repositories that import a file."""
    return across.groupBy("target_repo_id", "target").agg(F.count_distinct("repo_id", "source").alias("importers"))


def dead_symbols(symbols: DataFrame, edges: DataFrame, across: DataFrame | None = None) -> DataFrame:
    """(repo_id, id, name, kind, file_path): symbols of files that nothing imports, here or in other repositories."""
    alive = edges.filter("src <> dst").select("repo_id", F.col("dst").alias("file_path"))
    if across is not None:
        alive = alive.unionByName(across.select(F.col("target_repo_id").alias("repo_id"), F.col("target").alias("file_path")))
    return symbols.select("repo_id", "id", "name", "kind", "file_path").distinct().join(alive.distinct(), ["repo_id", "file_path"], "left_anti").select("repo_id", "id", "name", "kind", "file_path")


def refs_with_symbols(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """References whose target is still a symbol, with its kind; dangling ones drop out."""
    return refs.join(symbols.select("repo_id", F.col("id").alias("target_symbol"), F.col("kind").alias("target_kind")).distinct(), ["repo_id", "target_symbol"])


def edges_with_records(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Edges with the names that their import record brings in."""
    r = records.select("repo_id", F.col("source").alias("src"), "specifier", "names", "type_only")
    return edges.join(r, ["repo_id", "src", "specifier"])


def rebuilt_refs(stored: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """References after some files were read again: theirs are replaced.  changed: (repo_id, path)."""
    key = changed.select("repo_id", F.col("path").alias("source_file")).distinct()
    return stored.join(key, ["repo_id", "source_file"], "left_anti").unionByName(fresh.join(key, ["repo_id", "source_file"], "left_semi"))
