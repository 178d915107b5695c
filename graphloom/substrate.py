"""Views over the driver's tables that stand in for a code index: edges, nodes, layers, baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scalars import path_of
from graphloom.sources.tables import table


def part_edges(spark: SparkSession, d: str, least_quantity: int | None = None) -> DataFrame:
    """(src, dst): parts on consecutive lines of an order, distinct; with `least_quantity` both lines hold that much."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    if least_quantity is not None:
        li = li.filter(F.col("l_quantity") >= least_quantity)
    a = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"))
    b = li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst"))
    e = a.join(b, ["l_orderkey", "l_linenumber"]).select("src", "dst").distinct()
    return e if least_quantity is None else e.filter("src <> dst")


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("node"))


def nation_edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): nations of customers and of the suppliers they buy from."""
    # projected before each join; the dimension sides shrink to two columns
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    oc = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "src")
    return li.join(s, li.l_suppkey == s.s_suppkey).select("l_orderkey", "dst").join(oc, F.col("l_orderkey") == F.col("o_orderkey")).select("src", "dst").distinct()


def nation_layers(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("node"), F.col("r_name").alias("layer"))


def baskets(spark: SparkSession, d: str) -> DataFrame:
    """(g, b, item): distinct files of commits."""
    cf = table(spark, d, "commit_files")
    return cf.select(F.col("repo_id").alias("g"), F.col("commit_sha").alias("b"), path_of(F.col("file_path")).alias("item")).dropna().distinct()


def paths(spark: SparkSession, d: str) -> DataFrame:
    """(repo_id, path) of files, each once."""
    return table(spark, d, "files").select("repo_id", "path").distinct()
