"""Ranked search over symbols: an index of stemmed terms, query rewrite, AND with an OR fallback, re-ranking, blending.

The index is two tables, postings (id, term, tf, length) and one row of statistics; a query reads only the postings of
its terms.  Candidates are the best `4 * limit`, at most 200, by BM25; they are re-ranked by what name, signature,
summary and kind say, and the BM25 share is blended in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.scalars import file_stem, half_up, is_test_path
from graphloom.operators.ingest import is_library_path

K1, B = 1.2, 0.75
#: Words that a query drops.
STOP = frozenset("a an and are as at be but by can could do does find for from get has have how i if in into is it its me my of on or our should show so that the their then there these this those to was we were what when where which who why will with would you your".split())
#: Verbs that stand for one another, and short forms of words.
VERBS = [["get", "fetch", "retrieve", "load", "read"], ["create", "add", "insert", "make", "new"], ["delete", "remove", "destroy", "drop"], ["update", "edit", "modify", "change", "set"], ["send", "emit", "publish", "dispatch"], ["check", "validate", "verify"], ["start", "run", "launch", "begin"], ["stop", "end", "close", "cancel"], ["parse", "decode", "deserialize"], ["render", "draw", "display"], ["build", "compile", "generate"], ["save", "store", "persist", "write"]]
SHORT = {"auth": "authentication", "config": "configuration", "db": "database", "repo": "repository", "req": "request", "res": "response", "msg": "message", "ctx": "context", "env": "environment", "err": "error", "fn": "function", "impl": "implementation", "init": "initialize", "param": "parameter", "util": "utility", "info": "information", "num": "number", "str": "string", "temp": "temporary", "user": "usr", "btn": "button", "img": "image", "nav": "navigation", "pkg": "package", "src": "source", "dest": "destination", "conn": "connection", "async": "asynchronous", "doc": "document", "sync": "synchronize"}
KIND_WORDS = {"class": "class", "classes": "class", "interface": "interface", "function": "function", "method": "method", "type": "type", "enum": "enum", "constant": "const", "struct": "struct", "hook": "hook", "component": "component", "route": "route", "endpoint": "route", "middleware": "middleware", "model": "model"}


# ------------------------------------------------------------------------------------------------ stems


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """The stem of a lower-case English word by Porter's published algorithm; other words stay as they are."""
    if len(word) < 3 or not re.fullmatch(r"[a-z]+", word):
        return word

    def shape(w: str) -> str:
        return "".join("v" if c in "aeiou" or c == "y" and i and w[i - 1] not in "aeiou" else "c" for i, c in enumerate(w))

    def m(stem: str) -> int:
        return len(re.findall(r"v+c+", shape(stem)))

    def vowel(stem: str) -> bool:
        return "v" in shape(stem)

    def short_end(stem: str) -> bool:
        return len(stem) > 2 and shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"

    w = word
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + to
            break
    again = False
    if w.endswith("eed"):
        if m(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif m(w) == 1 and short_end(w):
            w += "e"
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    steps = (
        (0, (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))),
        (0, (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))),
        (1, tuple((e, "") for e in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"))),
    )
    for least, rules in steps:
        for end, to in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(end):
                stem = w[: len(w) - len(end)]
                if m(stem) > least and (end != "ion" or stem.endswith(("s", "t"))):
                    w = stem + to
                break
    if w.endswith("e") and (m(w[:-1]) > 1 or m(w[:-1]) == 1 and not short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and m(w) > 1:
        w = w[:-1]
    return w


def light_stem(w: Column) -> Column:
    """Without -s, -ing, -ed and -tion, as an expression: for engines and plans that shall stay on the JVM."""
    return (
        F.when(F.length(w) > 6, F.regexp_replace(w, "(ation|tion|ing|ed|es|s)$", "")).when(F.length(w) > 4, F.regexp_replace(w, "(ed|es|s)$", "")).otherwise(w)
    )


# ------------------------------------------------------------------------------------------------ index


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def split_name(name: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return words_of(spaced)


def content(symbols: DataFrame) -> DataFrame:
    """(id, terms): whole name, its parts, the file's stem, words of signature and summary; hooks and components also their
    kind, routes their path."""
    s = symbols.filter("id is not null")
    none = F.array().cast("array<string>")
    kind = F.when(F.col("kind").isin("hook", "composable"), F.array(F.lit("hook"), F.lit("composable"))).when(F.col("kind") == "component", F.array(F.lit("component"))).otherwise(none)
    path = F.when(F.col("kind").isin("route", "component"), words_of(F.coalesce(F.get_json_object("framework_meta", "$.path"), F.lit("")))).otherwise(none) if "framework_meta" in symbols.columns else none
    text = lambda c: words_of(F.coalesce(c, F.lit("")))
    name = F.coalesce("name", F.lit(""))
    return s.select("id", F.concat(text(name), split_name(name), text(file_stem(F.coalesce("file_path", F.lit("")))), text(F.col("signature")), text(F.col("summary")), kind, path).alias("terms"))


def postings(terms: DataFrame, stemmer: str = "porter") -> DataFrame:
    """(id, term, tf, length) of (id, terms); stems are made of distinct words only."""
    w = terms.select("id", F.size("terms").alias("length"), F.explode("terms").alias("word")).groupBy("id", "length", "word").agg(F.count(F.lit(1)).alias("n"))
    if stemmer == "light":
        stems = w.withColumn("term", light_stem(F.col("word")))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([porter(x) for x in b.column(0).to_pylist()])], ["word", "term"])

        stems = w.join(w.select("word").distinct().mapInArrow(run, "word string, term string"), "word")
    return stems.groupBy("id", "term", "length").agg(F.sum("n").alias("tf"))


def statistics(terms: DataFrame) -> DataFrame:
    """One row: n symbols, avg_length."""
    return terms.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms")).alias("avg_length"))


# ------------------------------------------------------------------------------------------------ query


def rewrite(query: str) -> list[list[str]]:
    """A query as AND of ORs.  Several words: stop words go, verbs stand with their synonyms.  One word: its camelCase and
    snake_case parts and its short or long form stand beside it, as one OR."""
    words = [w for w in re.split(r"[^A-Za-z0-9_]+", query) if w]
    if len(words) > 1:
        kept = [w.lower() for w in words if len(w) > 1 and w.lower() not in STOP] or [w.lower() for w in words]
        return [[w, *next(([v for v in g if v != w] for g in VERBS if w in g), [])] for w in dict.fromkeys(kept)]
    if not words:
        return []
    word = words[0]
    parts = [p.lower() for p in re.split(r"_|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", word) if len(p) > 1]
    terms = list(dict.fromkeys([word.lower().replace("_", ""), *parts])) if len(parts) > 1 else [word.lower()]
    long = {v: k for k, v in SHORT.items()}
    return [list(dict.fromkeys([*terms, *(SHORT[t] for t in terms if t in SHORT), *(long[t] for t in terms if t in long)]))]


def py_light(w: str) -> str:
    return re.sub("(ation|tion|ing|ed|es|s)$", "", w) if len(w) > 6 else re.sub("(ed|es|s)$", "", w) if len(w) > 4 else w


def candidates(posting: DataFrame, stats: DataFrame, groups: list[list[str]], limit: int) -> DataFrame:
    """(id, bm25, every): symbols that meet all groups first, then those that meet some, best BM25 first."""
    terms = sorted({t for g in groups for t in g})
    hit = posting.filter(F.col("term").isin(terms))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row a query term
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    met = [F.max(F.col("term").isin(g).cast("int")).alias(f"g{i}") for i, g in enumerate(groups)]
    scored = hit.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).groupBy("id").agg(half_up(F.sum(idf * tf), 4).alias("bm25"), *met)
    every = sum((F.col(f"g{i}") for i in range(len(groups))), F.lit(0)) == len(groups)
    return scored.select("id", "bm25", every.cast("int").alias("every")).orderBy(F.desc("every"), F.desc("bm25"), "id").limit(min(4 * limit, 200))


def base_score(query: str, words: list[str], stem) -> Column:
    """What name, signature, summary, kind and path of a symbol say for a query (columns of the symbol)."""
    name, q = F.lower(F.coalesce("name", F.lit(""))), query.strip().lower()
    joined = re.sub(r"[^a-z0-9]+", "", q)
    exact = F.when((name == q) | (name == joined), 100).when(name.startswith(joined), 60).when(name.contains(joined), 40).otherwise(0)
    parts = split_name(F.coalesce("name", F.lit("")))
    flat = F.transform(parts, stem)
    strict = [F.array_contains(parts, w) for w in words]
    loose = [F.array_contains(parts, w) | F.array_contains(flat, F.lit(stem_of(w, stem))) for w in words]
    as_int = lambda cs: sum((c.cast("int") for c in cs), F.lit(0))
    n = as_int(loose)
    overlap = F.when(n == len(words), 30).otherwise(0) + F.when(n > 0, 20).otherwise(0) + as_int(strict) * 10 + (n - as_int(strict)) * 8
    compound = F.when((F.size(parts) >= 2) & name.contains("_") & F.forall(parts, lambda p: p.isin(words)), 30).otherwise(0)
    inside = lambda c, first, each: F.when(as_int([F.array_contains(words_of(F.coalesce(c, F.lit(""))), w) for w in words]) > 0, first + each * as_int([F.array_contains(words_of(F.coalesce(c, F.lit(""))), w) for w in words])).otherwise(0)
    kinds = sorted({KIND_WORDS[w] for w in words if w in KIND_WORDS})
    hint = F.when(F.col("kind").isin(kinds), 35).otherwise(0) if kinds else F.lit(0)
    path = F.coalesce("file_path", F.lit(""))
    less = F.when(is_library_path(path), 40).otherwise(0) + F.when(is_test_path(path), 20).otherwise(0)
    return exact + overlap + compound + inside(F.col("signature"), 8, 2) + inside(F.col("summary"), 5, 1) + hint - less


def stem_of(word: str, stem) -> str:
    return py_light(word) if stem is light_stem else porter(word)


def search(symbols: DataFrame, posting: DataFrame, stats: DataFrame, query: str, limit: int = 20, stemmer: str = "light") -> DataFrame:
    """(id, name, kind, file_path, bm25, base, score, rank): the best `limit` symbols for a query; ties by id.

    posting must be stemmed by `stemmer`.  BM25 is spread to 0 .. 50 within the pool (25 where all are equal), and counts
    for three tenths where a symbol's base score is 80 or more.  Names that hold `Class::method` bring in their classes.
    """
    groups = rewrite(query)
    words = [g[0] for g in groups] if len(groups) > 1 else (groups[0] if groups else [])
    stems = [[py_light(t) if stemmer == "light" else porter(t) for t in g] for g in groups]
    if not stems:
        return symbols.limit(0).select("id", "name", "kind", "file_path", F.lit(0.0).alias("bm25"), F.lit(0.0).alias("base"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    pool = candidates(posting, stats, stems, limit)
    columns = ["id", "name", "kind", "file_path", "signature", "summary"]
    s = symbols.select(*columns).dropDuplicates(["id"]) if "repo_id" not in symbols.columns else symbols.select(*columns).distinct()
    rows = s.join(F.broadcast(pool), "id")  # at most 200 rows
    owners = rows.filter(F.col("name").contains("::")).select(F.substring_index("name", "::", 1).alias("name")).distinct()
    classes = s.join(F.broadcast(owners), "name", "left_semi").filter(F.col("kind").isin("class", "struct")).join(F.broadcast(pool.select("id")), "id", "left_anti")
    rows = rows.unionByName(classes.select(*columns, F.lit(0.0).alias("bm25"), F.lit(0).alias("every")))
    base = base_score(query, words, light_stem if stemmer == "light" else light_stem)
    whole = W.partitionBy()  # at most 200 rows and their classes
    scored = rows.withColumn("base", base.cast("double"))
    span = F.max("bm25").over(whole) - F.min("bm25").over(whole)
    bonus = F.when(span == 0, 25.0).otherwise((F.col("bm25") - F.min("bm25").over(whole)) / span * 50)
    scored = scored.withColumn("score", half_up(F.col("base") + bonus * F.when(F.max("base").over(whole) >= 80, 0.3).otherwise(1.0), 4))
    ranked = scored.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= limit).select("id", "name", "kind", "file_path", "bm25", "base", "score", "rank")


def name_like(symbols: DataFrame, text: str) -> DataFrame:
    """Symbols whose name holds a text, whatever its case; % and _ are letters here."""
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return symbols.filter(F.col("name").ilike(f"%{escaped}%"))


def pool_flags(pool: DataFrame) -> DataFrame:
    """One row over a pool: whether most is Java, whether hooks are there, names that occur three times or more."""
    names = pool.groupBy(F.lower("name").alias("n")).agg(F.count(F.lit(1)).alias("k")).filter("k >= 3")
    flags = pool.agg((F.count_if(F.col("file_path").endswith(".java")) * 2 > F.count(F.lit(1))).alias("mostly_java"), (F.count_if(F.col("kind").isin("hook", "composable")) > 0).alias("has_hooks"), F.count(F.lit(1)).alias("symbols"))
    return flags.crossJoin(names.agg(F.count(F.lit(1)).alias("frequent_names")))  # one row each


def hybrid(keyword: DataFrame, semantic: DataFrame, keyword_weight: float = 1.0, semantic_weight: float = 1.0, k: int = 60, limit: int = 20) -> DataFrame:
    """(id, score, rank): reciprocal rank fusion of two (id, rank) lists."""
    both = keyword.select("id", (F.lit(keyword_weight) / (k + F.col("rank"))).alias("s")).unionByName(semantic.select("id", (F.lit(semantic_weight) / (k + F.col("rank"))).alias("s")))
    fused = both.groupBy("id").agg(half_up(F.sum("s"), 6).alias("score"))
    return fused.orderBy(F.desc("score"), "id").limit(limit).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))  # `limit` rows


def variants(query: str) -> list[str]:
    """A query for vector search in its forms, itself first: short forms spelled out, identifiers taken apart."""
    words = query.split()
    long = {v: k for k, v in SHORT.items()}
    spelled = " ".join(SHORT.get(w.lower(), long.get(w.lower(), w)) for w in words)
    apart = " ".join(" ".join(re.split(r"_|(?<=[a-z0-9])(?=[A-Z])", w)).lower() for w in words)
    return list(dict.fromkeys([query, spelled, apart]))
