"""Ranked search: postings, BM25, query rewrite with an OR fallback, reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.scalars import half_up, words

K1, B = 1.2, 0.75

#: Words that a query drops, and groups of verbs that stand for one another.
STOP = frozenset("a an and are as at be by can do does find for from get how i in is it me of on or show that the this to what when where which who why with".split())
SYNONYMS = {"fetch": ["fetch", "load", "read", "get"], "delete": ["delete", "remove", "drop", "discard"], "build": ["build", "create", "make", "compute"], "send": ["send", "publish", "emit"]}


def postings(docs: DataFrame) -> DataFrame:
    """(doc, term, tf, len) from (doc, text): one row per distinct term of a document."""
    w = docs.select("doc", words(F.col("text")).alias("w")).withColumn("len", F.size("w"))
    return w.select("doc", "len", F.explode("w").alias("term")).groupBy("doc", "term", "len").agg(F.count(F.lit(1)).alias("tf"))


def rewrite(query: str) -> list[list[str]]:
    """A query as AND of ORs: stop words go, verbs stand with their synonyms."""
    return [SYNONYMS.get(w, [w]) for w in query.lower().split() if w not in STOP]


def bm25(posting: DataFrame, stats: DataFrame, terms: list[str]) -> DataFrame:
    """(doc, score, matched) of the documents that hold a term; stats is one row (n, avg_len)."""
    hit = posting.filter(F.col("term").isin(terms))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    # one row per query term and one row of statistics
    return hit.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).groupBy("doc").agg(half_up(F.sum(idf * tf), 4).alias("score"), F.count_distinct("term").alias("matched"))


def collection(docs: DataFrame) -> DataFrame:
    """One row: n documents, avg_len words."""
    return docs.select(F.size(words(F.col("text"))).alias("l")).agg(F.count(F.lit(1)).alias("n"), F.avg("l").alias("avg_len"))


def search(docs: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(doc, score, rank): documents that meet all groups of the query, then those that meet some; best first."""
    groups = rewrite(query)
    p = postings(docs)
    terms = sorted({t for g in groups for t in g})
    scored = bm25(p, collection(docs), terms)
    met = p.filter(F.col("term").isin(terms)).groupBy("doc").agg(*[F.max(F.col("term").isin(g)).alias(f"g{i}") for i, g in enumerate(groups)])
    every = met.select("doc", F.when(F.forall(F.array(*[F.col(f"g{i}") for i in range(len(groups))]), lambda x: x), 1).otherwise(0).alias("every"))
    top = scored.join(every, "doc").orderBy(F.desc("every"), F.desc("score"), "doc").limit(limit)
    return top.select("doc", "score", F.row_number().over(W.orderBy(F.desc("every"), F.desc("score"), "doc")).alias("rank"))  # at most `limit` rows


def fuse(lists: list[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """(doc, score): reciprocal rank fusion of (doc, rank) lists with weights."""
    parts = [df.select("doc", (F.lit(w) / (k + F.col("rank"))).alias("s")) for df, w in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc").agg(half_up(F.sum("s"), 6).alias("score"))
