"""Mixing sources to target weights (problem 9).

The size of the mix is the largest for which no source must be repeated more often than its cap allows.  Every
document of a source gets the same expected number of copies; the whole part is taken, and the fractional parts are
rounded by the pivotal method: two fractional documents meet, mass (in tokens) moves at random from one to the other
until one of them is whole, so that the expected copies of each document and the tokens of the source are kept.
Groups of documents are rounded independently and leave at most one fractional document each; those meet in further
rounds of a reduction tree, up to one per source, which is drawn at last (an error of at most one document).

Random draws come from a hash of the document and the seed: a lost executor repeats the same draws.

Defined results: null and empty texts have no tokens and are left out; sources are compared trimmed and in lower
case; a source without a target, or a target without documents, has no part in the mix and is reported; targets are
taken relative to the sum over the sources that have documents; repeated `doc_id`s are separate documents; a null or
negative `max_repeats` counts as 0; an empty table gives an empty mix.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.encode import token_counts
from graphloom.sources.tables import cut

FAN_IN = 64
EPS = 1e-9


def sizes(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens): source trimmed and in lower case, tokens of the public tokenizer."""
    src = docs.select("doc_id", F.lower(F.trim("source")).alias("source"), "text")
    return token_counts(src, ["doc_id", "source"], path=path).filter(F.col("tokens") > 0)


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, docs, supply, share, rate): rate is the expected copies of a document."""
    clean = targets.select(
        F.lower(F.trim("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"),
        F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"),
    ).dropDuplicates(["source"])
    supply = sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("supply"))
    usable = clean.join(supply, "source", "left").withColumn("open", (F.col("supply") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0))
    total = usable.agg(
        F.sum(F.when(F.col("open"), F.col("target_share"))).alias("shares"),
    )
    with_share = usable.crossJoin(F.broadcast(total)).withColumn("share", F.when(F.col("open"), F.col("target_share") / F.col("shares")).otherwise(0.0))  # one row
    size = with_share.filter("open").agg(F.min(F.col("max_repeats") * F.col("supply") / F.col("share")).alias("size"))
    return with_share.crossJoin(F.broadcast(size)).select(  # one row
        "source", "target_share", "max_repeats", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("supply", F.lit(0)).alias("supply"), "share",
        F.when(F.col("open"), F.least(F.col("share") * F.col("size") / F.col("supply"), F.col("max_repeats").cast("double"))).otherwise(0.0).alias("rate"),
    )


def pivot(group: list[tuple[int, int, float]], seed: int) -> list[tuple[int, float]]:
    """Pivotal rounding of (key, tokens, fraction); returns (position, fraction), at most one of them fractional."""
    out: list[tuple[int, float]] = []
    held: int | None = None
    p = [f for _, _, f in group]
    for i, (key, w, _) in enumerate(group):
        if p[i] <= EPS or p[i] >= 1 - EPS:
            out.append((i, float(round(p[i]))))
            continue
        if held is None:
            held = i
            continue
        a, b = held, i
        wa, wb = group[a][1], w
        up = min(1 - p[a], p[b] * wb / wa)
        down = min(p[a], (1 - p[b]) * wb / wa)
        draw = random.Random(f"{seed}:{group[a][0]}:{key}").random()
        move = up if draw * (up + down) < down else -down
        p[a] += move
        p[b] -= move * wa / wb
        held = None
        for j in (a, b):
            if p[j] <= EPS or p[j] >= 1 - EPS:
                out.append((j, float(round(p[j]))))
            else:
                held = j
    if held is not None:
        out.append((held, p[held]))
    return out


def _round(df: DataFrame, keys: list[str], seed: int, last: bool) -> DataFrame:
    schema = "doc_id bigint, source string, tokens int, slot long, part int, whole int, fraction double"

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["slot", "doc_id", "part"], kind="stable").reset_index(drop=True)
        group = list(zip(rows["slot"], rows["tokens"], rows["fraction"], strict=True))
        fractions = rows["fraction"].tolist()
        for at, f in pivot(group, seed):
            if last and EPS < f < 1 - EPS:
                f = float(random.Random(f"{seed}:last:{group[at][0]}").random() < f)
            fractions[at] = f
        rows["fraction"] = fractions
        return rows[["doc_id", "source", "tokens", "slot", "part", "whole", "fraction"]]

    return df.groupBy(*keys).applyInPandas(one, schema)


def mix(docs: DataFrame, targets: DataFrame, seed: int = 17, rows_per_group: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(copies, plan): copies holds doc_id, source, tokens, copies (>= 1); plan is `plan`'s table."""
    sized = cut(sizes(docs))
    rates = cut(plan(sized, targets))
    n = sized.count()
    groups = max(1, -(-n // rows_per_group))
    want = sized.join(F.broadcast(rates.select("source", "rate")), "source").filter("rate > 0")  # one row per target
    # `sized` is materialised, so the places of its rows are fixed; they keep repeated rows apart
    start = want.select(
        "doc_id", "source", "tokens", F.xxhash64("doc_id", "source", "tokens", F.monotonically_increasing_id()).alias("slot"), F.lit(0).alias("part"),
        F.floor(F.col("rate") + EPS).cast("int").alias("whole"), F.greatest(F.lit(0.0), F.col("rate") - F.floor(F.col("rate") + EPS)).alias("fraction"),
    )
    fraction = F.col("fraction")
    done: list[DataFrame] = []
    current = start
    while True:
        last = groups == 1
        bucket = F.pmod(F.col("slot"), F.lit(groups))
        rounded = cut(_round(current.withColumn("bucket", bucket), ["source", "bucket"], seed, last))
        open_ = (fraction > EPS) & (fraction < 1 - EPS)
        done.append(rounded.filter(~open_))
        if last:
            break
        current, groups = rounded.filter(open_), max(1, groups // FAN_IN)
    everything = done[0]
    for d in done[1:]:
        everything = everything.unionByName(d)
    copies = everything.select("doc_id", "source", "tokens", (F.col("whole") + F.round("fraction").cast("int")).alias("copies")).filter("copies > 0")
    return copies, rates


def report(copies: DataFrame, rates: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, docs, supply, tokens, most_copies, actual_share): one row per target."""
    got = copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    total = got.agg(F.sum("tokens").alias("all_tokens"))
    return rates.join(got, "source", "left").crossJoin(F.broadcast(total)).select(  # one row
        "source", "target_share", "max_repeats", "docs", "supply", F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
    )
