"""Graph operators over an edge table (src, dst): coupling, reachability, cycles, components, hierarchies, layers.

Walks are loops over frontiers: a join with the edges, a distinct, an anti-join with what was seen.  Loops of fixed
depth are one plan; open-ended ones cut their lineage by checkpoints in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import half_up
from graphloom.sources.tables import cut


def coupling(edges: DataFrame) -> DataFrame:
    """(node, ce, ca, instability): distinct outgoing and incoming neighbours; instability ce / (ce + ca), 3 digits.

    Each distinct edge counts once at either end, so the edges are read once and no outer join is needed.  Edges with a
    null end are ignored.
    """
    end = lambda c, ce, ca: F.struct(F.col(c).alias("node"), F.lit(ce).alias("ce"), F.lit(ca).alias("ca"))
    ends = edges.select("src", "dst").dropna().distinct().select(F.explode(F.array(end("src", 1, 0), end("dst", 0, 1))).alias("e"))
    both = ends.groupBy("e.node").agg(F.sum("e.ce").alias("ce"), F.sum("e.ca").alias("ca"))
    return both.withColumn("instability", half_up(F.col("ce") / (F.col("ce") + F.col("ca")), 3))


def importers(edges: DataFrame) -> DataFrame:
    """(node, importers, first_importer): distinct sources per target."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("importers"), F.min("src").alias("first_importer"))


def dead(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing else leads to (a self loop does not keep a node alive)."""
    return nodes.join(edges.filter("src <> dst").select(F.col("dst").alias("node")), "node", "left_anti")


def high_coupling(edges: DataFrame, more_than: int = 10) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("importers")).filter(F.col("importers") > more_than)


def reach(edges: DataFrame, starts: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(source, node, depth): nodes within `depth` steps of each source, at the depth they are first met; sources at 0."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    frontier = starts.select(F.col("node").alias("source"), "node").distinct()
    seen = frontier.withColumn("depth", F.lit(0))
    for k in range(1, depth + 1):
        reached = frontier.join(step, "node").select("source", F.col("next").alias("node")).distinct()
        frontier = reached.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(k)))
    return seen


def truncated(edges: DataFrame, starts: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(source, nodes, truncated): the size of each reach, and whether a walk one step longer would meet more."""
    longer = reach(edges, starts, depth + 1, reverse)
    return longer.groupBy("source").agg(F.count_if(F.col("depth") <= depth).alias("nodes"), F.max(F.col("depth") > depth).alias("truncated"))


def cycles(edges: DataFrame, length: int) -> DataFrame:
    """Simple cycles of `length` nodes, each once, from its smallest node: columns n1 .. n<length>."""
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    walk = e.filter("dst > src").select(F.col("src").alias("n1"), F.col("dst").alias("n2"))
    for k in range(2, length):
        here, new = F.col(f"n{k}"), f"n{k + 1}"
        step = e.select(F.col("src").alias("_at"), F.col("dst").alias(new))
        walk = walk.join(step, here == F.col("_at")).drop("_at").filter(F.col(new) > F.col("n1"))
        for j in range(2, k + 1):
            walk = walk.filter(F.col(new) != F.col(f"n{j}"))
    back = e.select(F.col("src").alias("_end"), F.col("dst").alias("_root"))
    return walk.join(back, (F.col(f"n{length}") == F.col("_end")) & (F.col("n1") == F.col("_root")), "left_semi")


def components(edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(node, component): strongly connected components, named by their smallest node.

    Nodes without incoming or outgoing edges are components of their own and leave first, layer by layer as long as a
    layer is a good part of what is left.  Then, in rounds, the smallest label flows forward and backward over all edges,
    and at each step labels jump to the label of their label's node, so that a chain of n nodes takes log n steps; nodes
    whose forward and backward labels agree are a component and leave, and edges between different labels fall away.
    Nothing is left out: if nodes are still there after `most_rounds`, the call fails.
    """
    e = cut(edges.filter("src <> dst").select("src", "dst").distinct())
    left = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    parts: list[DataFrame] = [left.limit(0).withColumn("component", F.col("node"))]

    def within(edges_: DataFrame, nodes: DataFrame) -> DataFrame:
        return edges_.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")

    def reached(edges_: DataFrame, nodes: DataFrame, a: str, b: str) -> DataFrame:
        """(node, label): the smallest node from which an edge path a -> b leads to each node; by pointer doubling."""
        label = nodes.withColumn("label", F.col("node"))
        step = edges_.select(F.col(a).alias("from"), F.col(b).alias("to"))
        while True:
            flow = step.join(label.withColumnRenamed("node", "from"), "from").select(F.col("to").alias("node"), "label")
            near = label.unionByName(flow).groupBy("node").agg(F.min("label").alias("label"))
            # what reaches my label's node reaches me
            up = near.select(F.col("node").alias("label"), F.col("label").alias("above"))
            new = cut(near.join(up, "label").select("node", F.least("label", "above").alias("label")))
            still = new.join(label.withColumnRenamed("label", "old"), "node").filter("label <> old").isEmpty()
            label = new
            if still:
                return label

    for _ in range(most_rounds):
        if left.isEmpty():
            break
        while True:  # trim
            live = cut(left.join(e.select(F.col("src").alias("node")), "node", "left_semi").join(e.select(F.col("dst").alias("node")), "node", "left_semi"))
            n, m = left.count(), live.count()
            if n == m:
                break
            parts.append(left.join(live, "node", "left_anti").withColumn("component", F.col("node")))
            left = live
            e = cut(within(e, left))
            if n - m < n // 8:  # a thin layer: the rounds below are quicker
                break
        if left.isEmpty():
            break
        forward = reached(e, left, "src", "dst").withColumnRenamed("label", "f")
        backward = reached(e, left, "dst", "src").withColumnRenamed("label", "b")
        both = cut(forward.join(backward, "node"))
        done = both.filter("f = b").select("node", F.col("f").alias("component"))
        parts.append(done)
        left = cut(both.filter("f <> b").select("node"))
        ends = both.filter("f <> b").select("node", "f", "b")
        a_ = ends.select(F.col("node").alias("src"), F.col("f").alias("f1"), F.col("b").alias("b1"))
        b_ = ends.select(F.col("node").alias("dst"), F.col("f").alias("f2"), F.col("b").alias("b2"))
        # a component lies inside one forward and one backward label
        e = cut(e.join(a_, "src").join(b_, "dst").filter("f1 = f2 and b1 = b2").select("src", "dst"))
    else:
        raise RuntimeError("components: nodes are left after most_rounds")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hierarchy(parents: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth, path): descendants along (child, parent) rows, from every node that has no parent."""
    p = parents.select("child", "parent").distinct()
    roots = p.select(F.col("parent").alias("node")).distinct().join(p.select(F.col("child").alias("node")), "node", "left_anti")
    level = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"), F.col("node").cast("string").alias("path"))
    out = level
    for k in range(1, depth + 1):
        level = level.join(p, level.node == p.parent).select("root", F.col("child").alias("node"), F.lit(k).alias("depth"), F.concat_ws("/", "path", F.col("child").cast("string")).alias("path"))
        out = out.unionByName(level)
    return out


def paths(edges: DataFrame, starts: DataFrame, goals: DataFrame, hops: int) -> DataFrame:
    """(source, target, hops, path): simple paths of at most `hops` edges from starts to goals, as arrays."""
    step = edges.filter("src <> dst").select(F.col("src").alias("at"), F.col("dst").alias("next")).distinct()
    walk = starts.select(F.col("node").alias("source"), F.col("node").alias("at"), F.array("node").alias("path")).distinct()
    out: DataFrame | None = None
    for k in range(1, hops + 1):
        walk = walk.join(step, "at").filter(~F.array_contains("path", F.col("next"))).select("source", F.col("next").alias("at"), F.array_append("path", F.col("next")).alias("path"))
        hit = walk.join(goals.select(F.col("node").alias("at")).distinct(), "at", "left_semi").select("source", F.col("at").alias("target"), F.lit(k).alias("hops"), "path")
        out = hit if out is None else out.unionByName(hit)
    return out


def most_connected(edges: DataFrame, keep: int) -> DataFrame:
    """Edges between the `keep` nodes of highest degree (ties: smaller node)."""
    e = edges.select("src", "dst").distinct()
    degree = e.select(F.col("src").alias("node")).unionAll(e.select("dst")).groupBy("node").count()
    top = degree.orderBy(F.desc("count"), "node").limit(keep).select("node")
    return e.join(top.withColumnRenamed("node", "src"), "src", "left_semi").join(top.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def layer_violations(edges: DataFrame, layers: DataFrame, rules: DataFrame) -> DataFrame:
    """(from_layer, to_layer, edges): edges between layers that a rule forbids; what no rule names is allowed.

    layers: (node, layer), the first layer of a node holds; rules: (from_layer, to_layer, allowed).
    """
    one = layers.groupBy("node").agg(F.min("layer").alias("layer"))
    placed = edges.join(one.select(F.col("node").alias("src"), F.col("layer").alias("from_layer")), "src").join(one.select(F.col("node").alias("dst"), F.col("layer").alias("to_layer")), "dst")
    return (
        placed.join(rules, ["from_layer", "to_layer"], "left").filter(~F.coalesce("allowed", F.lit(True)))
        .groupBy("from_layer", "to_layer").agg(F.count(F.lit(1)).alias("edges"))
    )


def matrix(edges: DataFrame, row: Column, column: Column, values: list) -> DataFrame:
    """Counts of edges from each row value to each of `values`."""
    return edges.select(row.alias("from_node"), column.alias("_to")).groupBy("from_node").pivot("_to", values).count().na.fill(0)


def resolve(records: DataFrame, candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(source, specifier, target): import records with the first of their candidate paths that is a file.

    records: (source, specifier); candidates: (source, specifier, ordinal, path); files: (path).
    """
    hits = candidates.join(files.select("path").distinct(), "path", "left_semi")
    first = hits.groupBy("source", "specifier").agg(F.min_by("path", "ordinal").alias("target"))
    return records.join(first, ["source", "specifier"])


def file_edges(resolved: DataFrame) -> DataFrame:
    """(src, dst, specifier): one edge per pair of files, the smallest specifier kept; no self loops."""
    return resolved.filter("source <> target").groupBy(F.col("source").alias("src"), F.col("target").alias("dst")).agg(F.min("specifier").alias("specifier"))
