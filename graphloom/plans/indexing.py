"""Queries over the index that the extractors build from `files`: declarations, edges, references, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.extract import process as px
from graphloom.extract import resolve as rs
from graphloom.operators import edges as eg
from graphloom.plans.catalogue import query
from graphloom.sources.tables import cut, table


def _rows(spark: SparkSession, d: str, with_uses: bool = False, once: bool = True) -> DataFrame:
    """Rows of the index; with `once` the contents are read for one reader, otherwise the rows are kept for several."""
    rows = px.process(table(spark, d, "files"), with_uses=with_uses)
    return rows if once else cut(rows)


def _resolved(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    return rs.resolve(px.imports(rows if rows is not None else _rows(spark, d)), table(spark, d, "files"))


_DECL = {"py": r"^(?:[ \t]*(?:async[ \t]+)?def|[ \t]*class)[ \t]+\w+", "go": r"^func[ \t]"}


@query(r"""with l as (select distinct repo_id, path, i, ls[i] as line from (select repo_id, path, ls, unnest(range(1, len(ls) + 1)) as i from (select repo_id, path, string_split(replace(decode(raw_content), chr(13), ''), chr(10)) as ls from files where raw_content is not null and path like '%.go')))
select repo_id, path, count(*) as declared from l where regexp_matches(line, '^func\s+(\([^)]*\)\s*)?[A-Za-z_]') group by 1, 2""")
def declared_functions_go(spark, d):
    """Functions and methods of Go files, whatever else is broken in them."""
    f = table(spark, d, "files").filter(F.col("path").endswith(".go"))
    s = px.process(f, with_uses=False).filter("what = 'symbol' and kind in ('function', 'method')")
    return s.select("repo_id", "path", "start_byte").distinct().groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("declared"))


@query()
def framework_symbols(spark, d):
    """Routes, components, models and the like by framework."""
    s = _rows(spark, d).filter("what = 'symbol' and get_json_object(framework_meta, '$.framework') is not null")
    return s.groupBy(F.get_json_object("framework_meta", "$.framework").alias("framework"), "kind").agg(F.count_distinct("repo_id", "path", "name").alias("symbols"))


@query()
def indexed_metrics(spark, d):
    """The six metrics of the functions that the extractors find, summed per repository."""
    s = px.symbols(_rows(spark, d)).filter("kind in ('function', 'method')")
    return s.groupBy("repo_id").agg(F.count(F.lit(1)).alias("functions"), *[F.sum(m).alias(m) for m in px.METRIC_NAMES])


_SCRIPT_RECORDS = r"""with f as (select distinct repo_id, path from files),
t as (select distinct repo_id, path, decode(raw_content) as text from files where raw_content is not null and regexp_matches(path, '\.(js|ts)$')),
b as (select repo_id, path, text, unnest(list_distinct(regexp_extract_all(text, '(?:require\(|from )"(\./[A-Za-z0-9_.-]+)"', 1))) as spec from t),
v(o, x) as (values (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.d.ts'), (4, '.js'), (5, '.jsx'), (6, '.mjs'), (7, '.cjs'), (8, '.vue'), (9, '.svelte'), (10, '.json'), (11, '/index.ts'), (12, '/index.tsx'), (13, '/index.js'), (14, '/index.jsx')),
c as (select b.*, o, case when contains(b.path, '/') then regexp_extract(b.path, '^(.*/)[^/]*$', 1) else '' end || spec[3:] || x as target from b cross join v),
r as (select c.*, row_number() over (partition by c.repo_id, c.path, spec order by o) as k from c join f on f.repo_id = c.repo_id and f.path = c.target where c.target <> c.path)"""


@query(_SCRIPT_RECORDS + " select repo_id, path as src, target as dst, arg_min(spec, instr(text, spec)) as specifier, 'import' as edge_type from r where k = 1 group by 1, 2, 3")
def file_edges_scripts(spark, d):
    """File edges of scripts, from extracted imports through the resolver."""
    f = table(spark, d, "files").filter(F.col("path").rlike(r"\.(js|ts)$"))
    records = px.imports(px.process(f, with_uses=False)).filter(F.col("specifier").startswith("./"))
    return eg.file_edges(rs.resolve(records, table(spark, d, "files")))


@query()
def file_edges(spark, d):
    """File edges of all languages, with their types; injected edges included."""
    rows = _rows(spark, d, once=False)
    return eg.file_edges(_resolved(spark, d, rows)).unionByName(eg.injected_edges(rows))


@query()
def symbol_refs(spark, d):
    """References between symbols of different files of a repository."""
    rows = _rows(spark, d, with_uses=True, once=False)
    return eg.symbol_refs(px.name_uses(rows), _resolved(spark, d, rows), px.symbols(rows))


@query()
def unimported_symbols(spark, d):
    """Symbols of files that nothing imports, per repository and kind."""
    rows = _rows(spark, d, once=False)
    dead = eg.dead_symbols(px.symbols(rows), eg.file_edges(_resolved(spark, d, rows)))
    return dead.groupBy("repo_id", "kind").agg(F.count(F.lit(1)).alias("symbols"))


@query()
def cross_repo_edges(spark, d):
    """Imports that only a linked repository answers to."""
    rows = _rows(spark, d, once=False)
    records, f = px.imports(rows), table(spark, d, "files")
    return eg.afferent_across(rs.cross_repo(records, rs.resolve(records, f), f, eg.links(table(spark, d, "repos"))))


@query("""with r as (select distinct id, regexp_replace(root_path, '/+$', '') as root from repos where id is not null and root_path is not null),
u as (select *, regexp_extract(root, '^(.*)/[^/]*$', 1) as folder from r), n as (select *, row_number() over (partition by folder order by root, id) as n from u),
s as (select a.id as repo_id, b.id as linked, row_number() over (partition by a.id order by b.n) as position from n a join n b on a.folder = b.folder and a.id <> b.id and b.n <= 9)
select repo_id, linked, 'sibling' as relation, position from s where position <= 8""")
def repo_links(spark, d):
    return eg.links(table(spark, d, "repos"))
