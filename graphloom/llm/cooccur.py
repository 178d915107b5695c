"""Items that appear together (problem 7): support and lift of pairs of files that share commits.

Heavy-light decomposition.  Within a repository a file is *heavy* when it lies in at least one of `dense` of its
commits; as a counted commit holds at most `max_items` files, a repository has at most `max_items * dense` heavy
files, however large it is.

* heavy x heavy: each heavy file is a row of bits over the repository's commits, 64 commits to a word; the shared
  commits of two files are the popcount of the words' conjunction.
* light x light: pairs inside a commit, counted by hash with partial aggregation before the shuffle.
* heavy x light: each occurrence of a light file probes the list of its commit's heavy files.

Commits are numbered inside hash buckets, so that no window or group holds a whole repository, and the statistics
of files are joined on salted keys, so that a file in every commit is no hot key.

Defined results: rows with a null path are ignored, also for the number of commits; null repository or commit
ids form no basket and are ignored; repeated rows count once; paths are compared with forward slashes and without
leading "./"; an empty table gives no pairs; columns beyond the three that are read are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.sources.tables import cut

SALTS = 8


def clean_path(path: Column) -> Column:
    """Forward slashes, no leading './'."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(path.startswith(".") | path.contains("\\"), F.regexp_replace(slashed, r"^(\./)+", "")).otherwise(path)


def keyed(rows: DataFrame, group: str, basket: str, item: str, path_items: bool = True) -> DataFrame:
    """(g, item, bk, ik): group and item, and 16-byte keys of (group, basket) and (group, item), which stand for them."""
    it = clean_path(F.col(item)) if path_items else F.col(item)
    flat = rows.select(F.col(group).alias("g"), F.col(basket).alias("b"), it.alias("item")).dropna()
    key = lambda *c: F.unhex(F.md5(F.concat_ws("\0", *c)))
    return flat.select("g", "item", key("g", "b").alias("bk"), key("g", "item").alias("ik"))


def cooccurrence(
    rows: DataFrame,
    group: str = "repo_id",
    basket: str = "commit_sha",
    item: str = "file_path",
    min_items: int = 2,
    max_items: int = 30,
    min_support: int = 5,
    dense: int = 16,
    path_items: bool = True,
) -> DataFrame:
    """(g, item_a, item_b, support, n_a, n_b, n, lift), item_a < item_b, for pairs with `min_support` shared baskets.

    support counts baskets of `min_items` to `max_items` items; n_a, n_b and n count baskets of every size.
    """
    flat = keyed(rows, group, basket, item, path_items)
    all_rows = cut(flat.select("g", "bk", "ik").distinct())  # read four times below
    # names are looked up once per item; the rows in between carry keys only
    names = flat.select("ik", "item").distinct()
    sizes = all_rows.groupBy("g", "bk").agg(F.count(F.lit(1)).alias("size"))
    counted = F.col("size").between(min_items, max_items)
    totals = sizes.groupBy("g").agg(F.count(F.lit(1)).alias("baskets"), F.count_if(counted).alias("counted"))
    # a basket above the limit, of whatever size, leaves here; the join splits it if it fills a partition
    occurrences = all_rows.drop("g").join(sizes.filter(counted).select("bk"), "bk")
    per_item = all_rows.groupBy("g", "ik").agg(F.count(F.lit(1)).alias("n_item"))
    per_counted = occurrences.groupBy("ik").agg(F.count(F.lit(1)).alias("n_counted"))
    # an item of fewer counted baskets than min_support is in no pair
    frequent = per_counted.filter(F.col("n_counted") >= min_support).join(per_item, "ik").join(names, "ik").join(totals, "g")
    # materialised, so the numbers of its rows stay; pairs carry these instead of keys
    frequent = cut(frequent.withColumn("heavy", F.col("n_counted") * dense >= F.col("counted")).withColumn("no", F.monotonically_increasing_id()))

    spread = occurrences.withColumn("salt", F.pmod(F.xxhash64("bk"), F.lit(SALTS)).cast("int"))
    salted = frequent.select("ik", "no", "g", "counted", "heavy", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    known = spread.join(salted, ["ik", "salt"]).select("g", "counted", "bk", "no", "heavy")

    # one row a basket, its light and its heavy items; at most max_items of them
    split = known.groupBy("g", "bk").agg(
        F.sort_array(F.collect_list(F.when(~F.col("heavy"), F.col("no")))).alias("light"),
        F.sort_array(F.collect_list(F.when(F.col("heavy"), F.col("no")))).alias("dense"),
        F.max("counted").alias("counted"),
    )
    split = cut(split)  # read by both ways of counting
    # baskets are numbered inside hash buckets of about 4,000, by repository
    numbered = (
        split.filter(F.size("dense") > 1)
        .withColumn("bucket", F.pmod(F.xxhash64("bk"), F.greatest(F.lit(1), F.expr("counted div 4096"))).cast("int"))
        .withColumn("k", F.row_number().over(W.partitionBy("g", "bucket").orderBy("bk")) - 1)
        .select("g", "bucket", F.expr("k div 64").cast("int").alias("word"), F.expr("k % 64").cast("int").alias("bit"), "dense")
    )
    at = ["g", "bucket", "word"]

    # pairs that hold a light item: a light item with the light ones after it, and with the heavy ones of its basket
    light = F.col("light")
    light_pairs = (
        split.filter((F.size("light") > 1) | (F.size("light") == 1) & (F.size("dense") > 0))
        .select(F.posexplode("light").alias("i", "a"), "light", "dense")
        .select("a", F.explode(F.concat(F.slice(light, F.col("i") + 2, F.size(light)), F.col("dense"))).alias("b"))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("support"))
    )

    # the bit matrix: one word of 64 baskets, one long per heavy item
    bits = (
        numbered.select(*at, "bit", F.explode("dense").alias("no"))
        .groupBy(*at, "no")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        .groupBy(*at)
        .agg(F.sort_array(F.collect_list(F.struct("no", "bits"))).alias("row"))
    )
    row = F.col("row")
    heavy_pairs = (
        bits.filter(F.size("row") > 1)
        .select(F.posexplode("row").alias("i", "x"), "row")
        .select("x", F.explode(F.slice(row, F.col("i") + 2, F.size(row))).alias("y"))
        .select(F.col("x.no").alias("a"), F.col("y.no").alias("b"), F.bit_count(F.col("x.bits").bitwiseAND(F.col("y.bits"))).cast("long").alias("shared"))
        .filter("shared > 0")
        .groupBy("a", "b")
        .agg(F.sum("shared").alias("support"))
    )

    pairs = light_pairs.unionByName(heavy_pairs).filter(F.col("support") >= min_support)
    stat = lambda k: frequent.select(F.col("no").alias(k), F.struct("item", "n_item").alias(f"s{k}"))
    one = frequent.select(F.col("no").alias("a"), "g", F.col("baskets").alias("n"), F.struct("item", "n_item").alias("sa"))
    named = pairs.join(one, "a").join(stat("b"), "b").select("g", "support", "n", F.least("sa", "sb").alias("x"), F.greatest("sa", "sb").alias("y"))
    return named.select(
        "g", F.col("x.item").alias("item_a"), F.col("y.item").alias("item_b"), "support", F.col("x.n_item").alias("n_a"), F.col("y.n_item").alias("n_b"), "n",
        (F.col("support") * F.col("n") / (F.col("x.n_item") * F.col("y.n_item")).cast("double")).alias("lift"),
    )


def found(rows: DataFrame, min_support: int = 5, min_lift: float = 3.0) -> DataFrame:
    """(repo_id, file_a, file_b) with support and lift at or above the limits."""
    # support * n >= min_lift * n_a * n_b, in integers where min_lift is one: no rounding decides a tie
    pairs = cooccurrence(rows, min_support=min_support)
    return pairs.filter((F.col("support") * F.col("n")) >= F.lit(min_lift) * (F.col("n_a") * F.col("n_b"))).select(
        F.col("g").alias("repo_id"), F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b")
    )
