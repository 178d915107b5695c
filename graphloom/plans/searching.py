"""Queries of ranked search over symbols, keyword and semantic, and of the exact searches beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import symbolsearch as ss
from graphloom.operators import vectors
from graphloom.plans.catalogue import TEST_SQL, query
from graphloom.sources.tables import table

ASKED = "export the anchor channels function"
_GROUPS = [[ss.py_light(t) for t in g] for g in ss.rewrite(ASKED)]
_WORDS = [g[0] for g in ss.rewrite(ASKED)]
_W = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda x: x <> '')"
_NAME = "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(coalesce(name, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"
_LIGHT = "case when length({0}) > 6 then regexp_replace({0}, '(ation|tion|ing|ed|es|s)$', '') when length({0}) > 4 then regexp_replace({0}, '(ed|es|s)$', '') else {0} end"
_LIB = r"(^|/)(node_modules|bower_components|vendor|third_party|third-party|site-packages|dist-packages|Pods|Carthage|deps|external)/"


def _sql_terms(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_INDEX = f"""s as (select distinct repo_id, id, name, kind, file_path, signature, summary from symbols where id is not null),
tm as (select id, list_concat(list_concat(list_concat(list_concat({_W.format('name')}, {_NAME}), {_W.format("lower(regexp_extract(coalesce(file_path, ''), '([^/]*?)(?:[.][^./]*)?$', 1))")}), {_W.format('signature')}), {_W.format('summary')}) as terms from s),
st as (select count(*) as n, avg(len(terms)) as avg_length from tm),
po as (select id, term, length, count(*) as tf from (select id, len(terms) as length, {_LIGHT.format('w')} as term from (select id, terms, unnest(terms) as w from tm)) group by 1, 2, 3)"""
_POOL = f"""{_INDEX}, hit as (select * from po where term in ({_sql_terms(sorted({t for g in _GROUPS for t in g}))})), df as (select term, count(*) as df from hit group by 1),
pl as (select id, floor(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.2::double / (tf + 1.2::double * (1 - 0.75::double + 0.75::double * length / avg_length)))) * 10000 + 0.5) / 10000 as bm25,
case when {' and '.join(f'bool_or(term in ({_sql_terms(g)}))' for g in _GROUPS)} then 1 else 0 end as "every" from hit join df using (term), st group by 1),
pool as (select * from pl order by "every" desc, bm25 desc, id limit 80)"""
_STRICT = " + ".join(f"list_contains(parts, '{w}')::int" for w in _WORDS)
_LOOSE = " + ".join(f"(list_contains(parts, '{w}') or list_contains(flat, '{ss.py_light(w)}'))::int" for w in _WORDS)
_JOINED = "".join(c for c in ASKED if c.isalnum())


def _inside(column: str, first: int, each: int) -> str:
    n = " + ".join(f"list_contains({_W.format(column)}, '{w}')::int" for w in _WORDS)
    return f"case when {n} > 0 then {first} + {each} * ({n}) else 0 end"


_SEARCH = f"""with {_POOL}, r as (select s.*, pool.bm25, {_NAME} as parts, lower(coalesce(name, '')) as low from s join pool using (id)), f as (select *, list_transform(parts, lambda w: {_LIGHT.format('w')}) as flat from r),
b as (select *, (case when low = '{ASKED}' or low = '{_JOINED}' then 100 when starts_with(low, '{_JOINED}') then 60 when contains(low, '{_JOINED}') then 40 else 0 end
 + case when {_LOOSE} = {len(_WORDS)} then 30 else 0 end + case when {_LOOSE} > 0 then 20 else 0 end + ({_STRICT}) * 10 + (({_LOOSE}) - ({_STRICT})) * 8
 + case when len(parts) >= 2 and contains(low, '_') and len(list_filter(parts, lambda p: p not in ({_sql_terms(_WORDS)}))) = 0 then 30 else 0 end
 + {_inside('signature', 8, 2)} + {_inside('summary', 5, 1)} + case when kind = 'function' then 35 else 0 end
 - case when regexp_matches(coalesce(file_path, ''), '{_LIB}') then 40 else 0 end - case when regexp_matches(coalesce(file_path, ''), '{TEST_SQL}') then 20 else 0 end)::double as base from f),
z as (select *, floor((base + (case when max(bm25) over () = min(bm25) over () then 25 else (bm25 - min(bm25) over ()) / (max(bm25) over () - min(bm25) over ()) * 50 end) * case when max(base) over () >= 80 then 0.3::double else 1.0::double end) * 10000 + 0.5) / 10000 as score from b),
res as (select id, name, kind, file_path, bm25, base, score, row_number() over (order by score desc, id) as rank from z qualify rank <= 20)"""


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols").filter("id is not null").select("repo_id", "id", "name", "kind", "file_path", "signature", "summary").distinct()


def _found(spark: SparkSession, d: str, limit: int = 20) -> DataFrame:
    s = _symbols(spark, d)
    terms = ss.content(s)
    return ss.search(s, ss.postings(terms, "light"), ss.statistics(terms), ASKED, limit)


@query(_SEARCH + " select id, name, kind, file_path, bm25, base, score, rank from res")
def search_symbols(spark, d):
    """The best twenty symbols for a question in words."""
    return _found(spark, d)


@query(f"with {_INDEX}, d as (select term, count(*) as df, sum(tf)::bigint as total from po group by 1) select term, df, total from d where df >= 20")
def index_terms(spark, d):
    """Frequent terms of the symbol index."""
    p = ss.postings(ss.content(_symbols(spark, d)), "light")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).filter("df >= 20")


@query()
def search_symbols_porter(spark, d):
    """The same question over an index of Porter stems."""
    s = _symbols(spark, d)
    terms = ss.content(s)
    return ss.search(s, ss.postings(terms, "porter"), ss.statistics(terms), ASKED, 20, stemmer="porter")


@query("select distinct repo_id, id, name from symbols where id is not null and contains(lower(name), 'anchor')")
def search_name_substring(spark, d):
    return ss.name_like(table(spark, d, "symbols").filter("id is not null"), "Anchor").select("repo_id", "id", "name").distinct()


_VEC = """v as (select distinct symbol_id as id, embedding::double[] as e from symbol_vectors where provider = 'local' and embedding is not null and len(embedding) = dimension and dimension > 0 and symbol_id is not null and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0),
u as (select id, e, sqrt(list_dot_product(e, e)) as norm from v), w as (select * from u where norm > 0), q as (select * from w order by id limit 1),
sim as (select w.id, floor(list_dot_product(w.e, q.e) / (w.norm * q.norm) * 1000000 + 0.5) / 1000000 as similarity from w, q where w.id <> q.id and len(w.e) = len(q.e)),
near as (select *, row_number() over (order by similarity desc, id) as rank from sim qualify rank <= {0})"""


def _near(spark: SparkSession, d: str, k: int) -> DataFrame:
    """The nearest of the `local` vectors to the vector of the smallest id (one query vector against all)."""
    v = table(spark, d, "symbol_vectors").filter("provider = 'local' and size(embedding) = dimension and dimension > 0").select(F.col("symbol_id").alias("id"), F.col("embedding").alias("v")).distinct()
    asked = vectors.unit(v).agg(F.min("id")).first()[0]
    return vectors.nearest(v, v.filter(F.col("id") == asked), k).select("id", "similarity", "rank")


@query("with " + _VEC.format(20) + " select * from near")
def search_semantic(spark, d):
    return _near(spark, d, 20)


@query("with " + _VEC.format(50) + " select id, similarity from near where similarity >= 0.25")
def search_similar_symbols(spark, d):
    return _near(spark, d, 50).filter("similarity >= 0.25").select("id", "similarity")


@query(_SEARCH + ", " + _VEC.format(40) + ", un as (select id, 1.0::double / (60 + rank) as x from res union all select id, 0.8::double / (60 + rank) from near), g as (select id, floor(sum(x) * 1000000 + 0.5) / 1000000 as score from un group by 1) select id, score, row_number() over (order by score desc, id) as rank from g qualify rank <= 20")
def search_hybrid(spark, d):
    """Keyword and vector lists, fused by reciprocal ranks."""
    return ss.hybrid(_found(spark, d).select("id", "rank"), _near(spark, d, 40).select("id", "rank"), 1.0, 0.8)


@query(f"with {_POOL}, r as (select s.* from s join pool using (id)), k as (select count(*) as frequent_names from (select lower(name) from r group by 1 having count(*) >= 3)) select count(*) filter (file_path like '%.java') * 2 > count(*) as mostly_java, count(*) filter (kind in ('hook', 'composable')) > 0 as has_hooks, count(*) as symbols, any_value(frequent_names) as frequent_names from r, k")
def search_pool_flags(spark, d):
    s = _symbols(spark, d)
    terms = ss.content(s)
    pool = ss.candidates(ss.postings(terms, "light"), ss.statistics(terms), _GROUPS, 20)
    return ss.pool_flags(s.join(F.broadcast(pool), "id"))
