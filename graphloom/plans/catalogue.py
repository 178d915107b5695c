"""All queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import substrate as sub
from graphloom.functions.scalars import entry_point, half_up, is_test_path
from graphloom.operators import code, graph, history, ingest, metrics, search, text, vectors
from graphloom.sources.tables import table
from graphloom.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}

AS_OF = 1_736_400_000
TODO_RE = r"\b(TODO|FIXME|HACK|XXX)\b"
CALL_RE = r"\bmeasure\("


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def put(f: Query) -> Query:
        _Q[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return put


def _complete() -> None:
    """The catalogue's other modules register their queries when they are imported."""
    from graphloom.plans import health, indexing, safety, searching  # noqa: F401


def queries() -> dict[str, Query]:
    _complete()
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    _complete()
    return dict(_SQL)


# SQL shared by the oracles

EDGES = "edges as (select distinct a.l_partkey as src, b.l_partkey as dst from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1)"
SPARSE = "edges as (select distinct a.l_partkey as src, b.l_partkey as dst from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where a.l_quantity >= 30 and b.l_quantity >= 30 and a.l_partkey <> b.l_partkey)"
NATION = "edges as (select distinct c_nationkey as src, s_nationkey as dst from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey)"
COUPLING = """, o as (select src as node, count(distinct dst) as ce from edges group by 1), i as (select dst as node, count(distinct src) as ca from edges group by 1)
select coalesce(o.node, i.node) as node, coalesce(ce, 0) as ce, coalesce(ca, 0) as ca,
  floor(coalesce(ce, 0) / (coalesce(ce, 0) + coalesce(ca, 0))::double * 1000 + 0.5) / 1000 as instability
from o full join i on o.node = i.node"""
SYM = """s as (select *, coalesce(cyclomatic_complexity, 1) as cc, coalesce(cognitive_complexity, 0) as cog, coalesce(line_count, 0) as lc, coalesce(param_count, 0) as pc,
  coalesce(return_count, 0) as rc, coalesce(nesting_depth, 0) as nd from (select distinct * from symbols where id is not null))"""
PATH = "regexp_replace(replace({0}, '\\', '/'), '^(\\./)+', '')"
COMMITS = f"""c as (select distinct repo_id, {PATH.format('file_path')} as path, commit_sha as sha, coalesce(nullif(trim(author_email), ''), author_name) as author,
  case when commit_date > 100000000000 then commit_date // 1000 else commit_date end as sec from git_metadata where repo_id is not null and file_path is not null and commit_sha is not null)"""
CHURN = f"""churn as (select repo_id, path, count(distinct sha) as commits, count(distinct author) as authors, max(sec) as last_at,
  floor(count(distinct sha) / 90.0::double * 90 * 100 + 0.5) / 100 as churn_score from c where sec between {AS_OF} - 90 * 86400 and {AS_OF} group by 1, 2)"""
RISK = "case when churn_score > 10 then 'hotspot' when churn_score > 5 then 'volatile' when churn_score >= 1 then 'active' else 'stable' end"
BASKETS = f"b as (select distinct repo_id as g, commit_sha as sha, {PATH.format('file_path')} as item from commit_files where repo_id is not null and commit_sha is not null and file_path is not null)"
CO = """, k as (select g, sha, count(*) as k from b group by 1, 2), n as (select g, count(*) as n from k group by 1), it as (select g, item, count(*) as n_item from b group by 1, 2),
held as (select b.*, k.k from b join k using (g, sha) where k.k between 2 and 30),
p as (select x.g, x.item as target, y.item as partner, count(*) as support, sum(1.0::double / (x.k - 1)) as w from held x join held y on x.g = y.g and x.sha = y.sha and x.item <> y.item group by 1, 2, 3 having count(*) >= 2),
co as (select p.g, target, partner, support, floor(w * 1000 + 0.5) / 1000 as weighted_support, floor(support / a.n_item::double * 1000 + 0.5) / 1000 as confidence,
  floor(support * n.n / (a.n_item * z.n_item)::double * 1000 + 0.5) / 1000 as lift
  from p join it a on a.g = p.g and a.item = target join it z on z.g = p.g and z.item = partner join n on n.g = p.g)"""
LINES = """l as (select repo_id, path, i as line_no, regexp_replace(ls[i], '\\r$', '') as line, ls from (select repo_id, path, ls, unnest(range(1, len(ls) + 1)) as i from
  (select repo_id, path, string_split(decode(raw_content), chr(10)) as ls from files where raw_content is not null)))"""
TEST_SQL = r"(?i)([._](test|spec)\.[a-z]+$)|(^|/)(test|spec)_[^/]*$|(^|/)(test|tests|__tests__|spec|specs|androidtest|testfixtures|[^/]*\.tests?)/"


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return metrics.distinct_symbols(table(spark, d, "symbols"))


def _churn(spark: SparkSession, d: str) -> DataFrame:
    return history.file_churn(history.commits(table(spark, d, "git_metadata")), AS_OF)


# ------------------------------------------------------------------------------------------------- graph


@query(f"with {EDGES}{COUPLING}")
def coupling_map(spark, d):
    return graph.coupling(sub.part_edges(spark, d))


@query(f"with {NATION}{COUPLING}")
def coupling_nation(spark, d):
    return graph.coupling(sub.nation_edges(spark, d))


@query(f"with {SPARSE} select p_partkey as node from part where not exists (select 1 from edges where dst = p_partkey)")
def dead_nodes(spark, d):
    return graph.dead(sub.parts(spark, d), sub.part_edges(spark, d, 30))


@query(f"with {EDGES} select dst as node, count(distinct src) as importers from edges group by 1 having count(distinct src) > 10")
def high_coupling_nodes(spark, d):
    return graph.high_coupling(sub.part_edges(spark, d))


@query(f"with {EDGES} select dst as node, count(distinct src) as importers, min(src) as first_importer from edges group by 1")
def importers_of(spark, d):
    return graph.importers(sub.part_edges(spark, d))


_LAYERED = f"""with {NATION} select rf.r_name as from_layer, rt.r_name as to_layer, count(*) as edges from edges join nation a on src = a.n_nationkey join region rf on a.n_regionkey = rf.r_regionkey
join nation b on dst = b.n_nationkey join region rt on b.n_regionkey = rt.r_regionkey where (rf.r_name, rt.r_name) in (('ASIA', 'AMERICA'), ('EUROPE', 'AFRICA')) group by 1, 2"""


@query(_LAYERED)
def layer_violations(spark, d):
    rules = spark.createDataFrame([("ASIA", "AMERICA", False), ("EUROPE", "AFRICA", False), ("ASIA", "EUROPE", True)], "from_layer string, to_layer string, allowed boolean")
    return graph.layer_violations(sub.nation_edges(spark, d), sub.nation_layers(spark, d), rules)


_BFS = "with recursive {0}, r(source, node, depth) as (select p_partkey, p_partkey, 0 from part union select r.source, e.{2}, r.depth + 1 from r join edges e on e.{1} = r.node where r.depth < {3}) "


@query(_BFS.format(SPARSE, "dst", "src", 3) + "select source, node, min(depth) as depth from r group by 1, 2")
def reverse_bfs_depth3(spark, d):
    return graph.reach(sub.part_edges(spark, d, 30), sub.parts(spark, d), 3, reverse=True)


@query(_BFS.format(SPARSE, "src", "dst", 3) + "select source, node, min(depth) as depth from r group by 1, 2")
def forward_bfs_depth3(spark, d):
    return graph.reach(sub.part_edges(spark, d, 30), sub.parts(spark, d), 3)


@query(_BFS.format(SPARSE, "dst", "src", 3) + ", m as (select source, node, min(depth) as depth from r group by 1, 2) select source, count(*) filter (depth <= 2) as nodes, bool_or(depth > 2) as truncated from m group by 1")
def blast_radius_truncated(spark, d):
    return graph.truncated(sub.part_edges(spark, d, 30), sub.parts(spark, d), 2, reverse=True)


@query(f"with {SPARSE} select a.src as n1, a.dst as n2 from edges a join edges b on a.dst = b.src and b.dst = a.src where a.src < a.dst")
def cycles_len2(spark, d):
    return graph.cycles(sub.part_edges(spark, d, 30), 2)


@query(f"with {SPARSE} select a.src as n1, a.dst as n2, b.dst as n3 from edges a join edges b on a.dst = b.src join edges c on b.dst = c.src and c.dst = a.src where a.dst > a.src and b.dst > a.src and b.dst <> a.dst")
def cycles_len3(spark, d):
    return graph.cycles(sub.part_edges(spark, d, 30), 3)


@query(f"""with recursive {NATION}, r(a, b) as (select src, dst from edges union select r.a, e.dst from r join edges e on e.src = r.b),
n as (select src as node from edges union select dst from edges)
select node, least(node, coalesce((select min(x.b) from r x join r y on x.a = y.b and x.b = y.a where x.a = n.node), node)) as component from n""")
def scc_membership(spark, d):
    return graph.components(sub.nation_edges(spark, d))


@query("select r_regionkey as root, r_regionkey as node, 0 as depth, r_regionkey::varchar as path from region union all select n_regionkey, 100 + n_nationkey, 1, n_regionkey || '/' || (100 + n_nationkey) from nation")
def type_hierarchy(spark, d):
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 100).alias("child"), F.col("n_regionkey").alias("parent"))
    return graph.hierarchy(n, 2)


@query(f"""with {NATION}, e as (select * from edges where src <> dst), g as (select n_nationkey as node from nation where n_regionkey = 1), s as (select n_nationkey as node from nation where n_regionkey = 0)
select s.node as source, a.dst as target, 1 as hops, count(*) as paths from s join e a on a.src = s.node where a.dst in (select node from g) group by 1, 2 union all
select s.node, b.dst, 2, count(*) from s join e a on a.src = s.node join e b on b.src = a.dst where b.dst <> s.node and b.dst in (select node from g) group by 1, 2""")
def path_enumeration(spark, d):
    n = table(spark, d, "nation")
    p = graph.paths(sub.nation_edges(spark, d), n.filter("n_regionkey = 0").select(F.col("n_nationkey").alias("node")), n.filter("n_regionkey = 1").select(F.col("n_nationkey").alias("node")), 2)
    return p.groupBy("source", "target", "hops").agg(F.count(F.lit(1)).alias("paths"))


@query(f"""with {EDGES}, dg as (select node, count(*) as n from (select src as node from edges union all select dst from edges) group by 1), t as (select node from dg order by n desc, node limit 50)
select src, dst from edges where src in (select node from t) and dst in (select node from t)""")
def degree_prune_topn(spark, d):
    return graph.most_connected(sub.part_edges(spark, d), 50)


@query(f"""with {NATION}, m as (select a.n_regionkey as f, b.n_regionkey as t from edges join nation a on src = a.n_nationkey join nation b on dst = b.n_nationkey)
select f as from_node, {', '.join(f'count(*) filter (t = {i}) as "{i}"' for i in range(5))} from m group by 1""")
def dep_matrix_pivot(spark, d):
    n = table(spark, d, "nation")
    e = sub.nation_edges(spark, d).join(n.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("f")), "src").join(n.select(F.col("n_nationkey").alias("dst"), F.col("n_regionkey").alias("t")), "dst")
    return graph.matrix(e, F.col("f"), F.col("t"), [0, 1, 2, 3, 4])


@query(f"""with {EDGES}, old as (select distinct a.l_partkey as src, b.l_partkey as dst from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where a.l_quantity >= 30 and b.l_quantity >= 30 and a.l_partkey <> b.l_partkey)
select e.src as n1, e.dst as n2 from edges e join edges f on f.src = e.dst and f.dst = e.src where e.src < e.dst and not exists (select 1 from old a join old b on b.src = a.dst and b.dst = a.src where a.src = e.src and a.dst = e.dst)""")
def change_impact_new_cycles(spark, d):
    new, old = graph.cycles(sub.part_edges(spark, d), 2), graph.cycles(sub.part_edges(spark, d, 30), 2)
    return new.join(old, ["n1", "n2"], "left_anti")


# ------------------------------------------------------------------------------------------------- history


@query(f"with {COMMITS}, {CHURN} select repo_id, path, commits, authors, last_at, churn_score, {RISK} as risk from churn")
def churn_file(spark, d):
    return _churn(spark, d)


@query(f"with {COMMITS}, {CHURN} select s.repo_id, s.id, commits, authors, churn_score from (select distinct repo_id, id, file_path from symbols) s join churn on churn.repo_id = s.repo_id and path = file_path")
def churn_symbol(spark, d):
    return history.symbol_churn(table(spark, d, "symbols"), _churn(spark, d))


@query(f"with {COMMITS}, {CHURN}, x as (select *, {RISK} as risk from churn) select repo_id, count(*) as files, " + ", ".join(f"count(*) filter (risk = '{r}') as {r}" for r in ("hotspot", "volatile", "active", "stable")) + ", sum(commits)::bigint as file_commits from x group by 1")
def churn_summary(spark, d):
    return history.churn_summary(_churn(spark, d))


@query(f"with {COMMITS}, n as (select repo_id, author, count(*) as touched from c where author is not null group by 1, 2) select repo_id, author, touched from n qualify row_number() over (partition by repo_id order by touched desc, author) = 1")
def most_active_author(spark, d):
    return history.top_author(history.commits(table(spark, d, "git_metadata")))


@query(f"with {BASKETS}{CO} select g, target, partner, support, weighted_support, confidence, lift from co")
def co_change_all_pairs(spark, d):
    return history.co_change(sub.baskets(spark, d))


@query(f"with {BASKETS}{CO} select g, target, partner, support, weighted_support, confidence, lift from co where target = 'CHANGELOG.md'")
def co_change_target(spark, d):
    b = sub.baskets(spark, d)
    return history.co_change(b, targets=b.filter("item = 'CHANGELOG.md'"))


@query(f"""with {SYM}, h as (select repo_id, cc, count(*) as n from s group by 1, 2)
select repo_id, cc, floor((coalesce(sum(n) over (partition by repo_id order by cc rows between unbounded preceding and 1 preceding), 0) + n / 2.0::double) / sum(n) over (partition by repo_id) * 1000000 + 0.5) / 1000000 as percentile from h""")
def midrank_percentile(spark, d):
    return history.midrank(_symbols(spark, d).withColumnRenamed("m_cyclomatic_complexity", "cc"), ["repo_id"], "cc", "percentile")


_MID = "floor((coalesce(sum(n) over (partition by repo_id order by v rows between unbounded preceding and 1 preceding), 0) + n / 2.0::double) / sum(n) over (partition by repo_id) * 1000000 + 0.5) / 1000000"
_TESTED = f"""tested as (select distinct n.repo_id, n.id from (select distinct repo_id, id, name from symbols where length(name) >= 3) n
join (select distinct repo_id, unnest(regexp_extract_all(decode(raw_content), '[A-Za-z_][A-Za-z0-9_]*')) as w from files where raw_content is not null and regexp_matches(path, '{TEST_SQL}')) f on f.repo_id = n.repo_id and f.w = n.name)"""


def _tested(spark: SparkSession, d: str) -> DataFrame:
    """(repo_id, id): symbols that a test file mentions."""
    tests = table(spark, d, "files").filter(is_test_path(F.col("path")))
    return text.mentions(table(spark, d, "symbols").select("repo_id", "id", "name"), tests).select("repo_id", "id")


# ------------------------------------------------------------------------------------------------- metrics

_QUALITY = "floor(least(cc / 50.0::double, 1) * 100 * 0.4::double + least(lc / 200.0::double, 1) * 100 * 0.3::double + least(nd / 10.0::double, 1) * 100 * 0.2::double + least(pc / 10.0::double, 1) * 100 * 0.1::double + 0.5)"


@query(f"with {SYM}, q as (select id, name, {_QUALITY} as score from s) select *, case when score < 25 then 'good' when score < 50 then 'moderate' when score < 75 then 'high' else 'critical' end as level from q order by score desc, id limit 50")
def quality_metrics_topk(spark, d):
    return metrics.quality_top(_symbols(spark, d), 50)


@query(f"""with {SYM}, a as (select repo_id, file_path, count(*) as symbols, count(*) filter (cc >= 5) as complex_symbols, floor(avg(cc) * 1000 + 0.5) / 1000 as avg_cc, max(cc) as max_cc, max(nd) as max_nesting, sum(lc)::bigint as lines
from s where kind in ('function', 'method') group by 1, 2)
select *, floor(least(avg_cc / 30.0::double, 1) * 100 * 0.35::double + least(max_cc / 50.0::double, 1) * 100 * 0.30::double + least((complex_symbols / symbols::double) / 1.0::double, 1) * 100 * 0.20::double + least(max_nesting / 10.0::double, 1) * 100 * 0.15::double + 0.5) as score from a""")
def complexity_hotspots(spark, d):
    return metrics.hotspots(_symbols(spark, d))


@query(f"with {SYM} select repo_id, file_path, id, row_number() over (partition by repo_id, file_path order by cc desc, id) as rank from s where kind in ('function', 'method') qualify rank <= 3")
def hotspot_top_symbols(spark, d):
    return metrics.top_symbols(_symbols(spark, d), 3)


@query(f"with {SYM} select repo_id, id, file_path, cc, lc, nd from s where cc >= 4 and cc <= 40 and lc >= 20 and nd >= 2")
def search_by_complexity(spark, d):
    s = metrics.search_by_complexity(_symbols(spark, d), {"cyclomatic_complexity": 4, "line_count": 20, "nesting_depth": 2}, {"cyclomatic_complexity": 40})
    return s.select("repo_id", "id", "file_path", F.col("m_cyclomatic_complexity").alias("cc"), F.col("m_line_count").alias("lc"), F.col("m_nesting_depth").alias("nd"))


@query("select distinct repo_id, id, name from symbols where signature ilike '%map[string]%'")
def search_by_signature_contains(spark, d):
    return text.signature_search(table(spark, d, "symbols"), "map[string]").select("repo_id", "id", "name").distinct()


@query("select distinct repo_id, id, name from symbols where signature ilike 'export %'")
def search_by_signature_prefix(spark, d):
    return text.signature_search(table(spark, d, "symbols"), "export ", "prefix").select("repo_id", "id", "name").distinct()


@query(r"select distinct repo_id, id, name from symbols where regexp_matches(signature, '\b(self|this), [a-z_]+: (int|bool)\b')")
def search_by_signature_regex(spark, d):
    return text.signature_search(table(spark, d, "symbols"), r"\b(self|this), [a-z_]+: (int|bool)\b", "regex").select("repo_id", "id", "name").distinct()


@query(f"""with {SYM}, t as (select * from s where regexp_matches(signature, '^export( |$|\\n)')) select distinct repo_id, id, name, kind from (select * from t union all
select * from s where kind = 'method' and (repo_id, file_path) in (select repo_id, file_path from t where kind = 'class'))""")
def public_api(spark, d):
    return metrics.public_api(_symbols(spark, d))


_ENTRY = r"""case when name = 'handler' and kind in ('function', 'const', 'method') and regexp_matches(signature, '\b(event|context|callback)\b') then 'lambda_handler'
when name = 'main' and kind in ('function', 'method', 'const') then 'main_function'
when kind in ('function', 'const', 'class') and regexp_matches(file_path, '(?i)(^|/)(bin|cmd|cli)/') and lower(name) in ('main', 'run', 'execute', 'cli', 'command', 'program') then 'cli_handler'
when kind = 'function' and name in ('bootstrap', 'startServer', 'startApp', 'listenOn', 'serve', 'createServer') then 'server_startup'
when kind in ('function', 'const', 'class') and lower(regexp_extract(file_path, '([^/]*?)(?:\.[^./]*)?$', 1)) in ('server', 'app') and file_path not like '%/%' and lower(name) in ('main', 'start', 'run', 'init', 'boot', 'bootstrap') then 'server_startup'
when kind = 'function' and regexp_matches(file_path, '(?i)(^|/)scripts?/') then 'script' end"""


@query(f"select coalesce({_ENTRY}, 'none') as entry, count(distinct id) as symbols from symbols group by 1")
def entry_points_classify(spark, d):
    e = F.coalesce(entry_point(F.col("name"), F.col("kind"), F.col("file_path"), F.col("signature")), F.lit("none"))
    return table(spark, d, "symbols").select("id", e.alias("entry")).groupBy("entry").agg(F.count_distinct("id").alias("symbols"))


@query("""with f as (select distinct repo_id, string_split(path, '/') as p from files), x as (select repo_id, array_to_string(p[1:i], '/') as dir from (select repo_id, p, unnest(range(0, len(p))) as i from f))
select repo_id, dir, count(*) as files from x group by 1, 2""")
def file_tree_counts(spark, d):
    return metrics.tree_counts(sub.paths(spark, d))


@query(f"with {SYM} select repo_id, file_path, count(*) as symbols, array_to_string(list_sort(list(distinct kind)), ',') as kinds, min(name) as first_symbol from s group by 1, 2")
def repo_outline(spark, d):
    return metrics.outline(_symbols(spark, d))


@query(f"with {SYM} select id, name, kind, start_byte, row_number() over (partition by repo_id, file_path order by start_byte nulls first, id) as position from s")
def file_outline(spark, d):
    from pyspark.sql import Window as W

    return _symbols(spark, d).select("id", "name", "kind", "start_byte", F.row_number().over(W.partitionBy("repo_id", "file_path").orderBy(F.asc_nulls_first("start_byte"), "id")).alias("position"))


@query("""with f as (select repo_id, path, max(content_hash) as h from files group by 1, 2), o as (select repo_id, path, h from f where not path like '%/%/%'), n as (select repo_id, path, case when path like '%.json' then 'x' else h end as h from f where path not like 'tests/%')
select coalesce(o.repo_id, n.repo_id) as repo_id, coalesce(o.path, n.path) as path, case when o.h is null then 'added' when n.h is null then 'removed' else 'changed' end as change from o full join n on o.repo_id = n.repo_id and o.path = n.path where o.h is null or n.h is null or o.h <> n.h""")
def snapshot_diff(spark, d):
    f = table(spark, d, "files").groupBy("repo_id", "path").agg(F.max("content_hash").alias("hash"))
    old = f.filter(~F.col("path").like("%/%/%"))
    new = f.filter(~F.col("path").like("tests/%")).withColumn("hash", F.when(F.col("path").like("%.json"), "x").otherwise(F.col("hash")))
    return metrics.snapshot_diff(old, new)


@query(f"with {SYM}, {_TESTED} select s.repo_id, s.id, case when cc >= 5 or lc >= 20 then 'high' when cc >= 2 or lc >= 8 then 'medium' else 'low' end as priority from s where kind in ('function', 'method') and not regexp_matches(file_path, '{TEST_SQL}') and not exists (select 1 from tested t where t.repo_id = s.repo_id and t.id = s.id)")
def untested_symbols(spark, d):
    return metrics.untested(_symbols(spark, d), _tested(spark, d))


_TOK = "list_sort(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: length(x) >= 2)))"


@query(f"""with {SYM}, t as (select repo_id, kind, id, {_TOK} as t from s where kind in ('function', 'method') and name is not null), c as (select repo_id, kind, t, min(id) as id from t where len(t) > 0 group by 1, 2, 3),
w as (select repo_id, kind, id, len(t) as n, unnest(t) as w from c), p as (select a.repo_id, a.id as id_a, b.id as id_b, a.n as na, b.n as nb, count(*) as k from w a join w b on a.repo_id = b.repo_id and a.kind = b.kind and a.w = b.w and a.id < b.id group by 1, 2, 3, 4, 5)
select repo_id, id_a, id_b, floor(k / (na + nb - k)::double * 1000 + 0.5) / 1000 as jaccard from p where k / (na + nb - k)::double >= 0.6""")
def name_jaccard_duplicates(spark, d):
    return metrics.similar_names(_symbols(spark, d))


@query(f"with {SYM} select repo_id, case when contains(file_path, '/') then regexp_extract(file_path, '^(.*)/[^/]*$', 1) else '' end as dir, count(*) as symbols, count(*) filter (coalesce(regexp_matches(signature, '^export( |$|\\n)'), false)) as exported from s group by 1, 2")
def directory_interface(spark, d):
    return metrics.placement(_symbols(spark, d))


@query("select repo_id, sum(octet_length(raw_content))::bigint as bytes, floor(sum(octet_length(raw_content)) / 4)::bigint as tokens from files where raw_content is not null group by 1")
def token_savings(spark, d):
    return table(spark, d, "files").filter("raw_content is not null").groupBy("repo_id").agg(F.sum(F.octet_length("raw_content")).cast("bigint").alias("bytes")).withColumn("tokens", F.floor(F.col("bytes") / 4).cast("bigint"))


# ------------------------------------------------------------------------------------------------- text


@query(f"with {LINES} select distinct repo_id, path, line_no, len(regexp_extract_all(line, '{CALL_RE}')) as matches from l where regexp_matches(line, '{CALL_RE}')")
def search_text_lines(spark, d):
    return text.search(table(spark, d, "files"), CALL_RE)


@query(f"with {LINES} select distinct repo_id, path, line_no, case when line_no > 1 then regexp_replace(ls[line_no - 1], '\\r$', '') else '' end as before, case when line_no < len(ls) then regexp_replace(ls[line_no + 1], '\\r$', '') else '' end as after from l where regexp_matches(line, '\\bthrow new\\b')")
def search_text_context(spark, d):
    return text.context(table(spark, d, "files"), r"\bthrow new\b", 1)


_TAG = "(?i)\\b(TODO|FIXME|HACK|NOTE|OPTIMIZE|BUG|XXX)\\b(?:\\(([^)]+)\\))?[:\\s]*(.*)"


@query(f"with {LINES} select distinct repo_id, path, line_no, upper(regexp_extract(line, '{_TAG}', 1)) as tag, regexp_extract(line, '{_TAG}', 2) as assignee, rtrim(regexp_extract(line, '{_TAG}', 3)) as text from l where regexp_matches(line, '{_TAG}')")
def todo_tags(spark, d):
    return text.tagged(table(spark, d, "files"))


@query("select tag, count(*) as n from (" + _SQL["todo_tags"] + ") group by 1")
def todo_counts(spark, d):
    return text.tagged(table(spark, d, "files")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {LINES}, o as (select distinct repo_id, path, line_no, line, (octet_length(encode(array_to_string(ls[1:line_no - 1], chr(10)))) + case when line_no > 1 then 1 else 0 end) as byte_at from l where regexp_matches(line, '\\braise ValueError\\b')),
sp as (select distinct repo_id, file_path as path, start_byte as st, end_byte as en, id from symbols where start_byte >= 0 and end_byte > start_byte and kind in ('function', 'method')),
j as (select o.repo_id, o.path, o.line_no, o.byte_at, sp.id, row_number() over (partition by o.repo_id, o.path, o.line_no, o.byte_at order by en - st nulls last, id) as r from o left join sp on sp.repo_id = o.repo_id and sp.path = o.path and o.byte_at >= st and o.byte_at < en)
select repo_id, path, line_no, byte_at, id as symbol_id from j where r = 1""")
def find_references_enclosing(spark, d):
    pattern = r"\braise ValueError\b"
    hits = text.lines(table(spark, d, "files"), F.col("text").rlike(pattern)).filter(F.col("line").rlike(pattern)).select("repo_id", "path", "line_no", F.col("offset").cast("bigint").alias("offset")).distinct()
    spans = table(spark, d, "symbols").filter("start_byte >= 0 and end_byte > start_byte and kind in ('function', 'method')").select("repo_id", F.col("file_path").alias("path"), F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), "id").distinct()
    return text.enclosing(hits, spans).withColumnRenamed("offset", "byte_at")


@query("""with n as (select distinct repo_id, id, name from symbols where length(name) >= 3), w as (select distinct repo_id, path, unnest(regexp_extract_all(decode(raw_content), '[A-Za-z_][A-Za-z0-9_]*')) as w from files where raw_content is not null)
select n.repo_id, n.id, count(*) as file_count from n join w on w.repo_id = n.repo_id and w.w = n.name group by 1, 2""")
def mention_map(spark, d):
    return text.mentions(table(spark, d, "symbols").select("repo_id", "id", "name"), table(spark, d, "files"))


@query("""with n as (select distinct repo_id, name from symbols where kind = 'class' and length(name) >= 3), w as (select distinct repo_id, path, unnest(regexp_extract_all(decode(raw_content), '[A-Za-z_][A-Za-z0-9_]*')) as w from files where raw_content is not null)
select n.name, count(distinct w.repo_id) as repos, count(*) as files from (select distinct name, repo_id from n) n join w on w.w = n.name and w.repo_id <> n.repo_id group by 1""")
def cross_repo_usages(spark, d):
    n = table(spark, d, "symbols").filter("kind = 'class' and length(name) >= 3").select(F.col("repo_id").alias("home"), "name").distinct()
    word = F.array_distinct(F.regexp_extract_all(F.col("raw_content").cast("string"), F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    w = table(spark, d, "files").filter("raw_content is not null").select("repo_id", "path", F.explode(word).alias("name")).distinct()
    # only words that name a class go on
    hits = w.join(n.select("name").distinct(), "name", "left_semi")
    return hits.join(n, "name").filter("repo_id <> home").groupBy("name").agg(F.count_distinct("repo_id").alias("repos"), F.count(F.lit(1)).alias("files"))


@query("""with h as (select repo_id, path, 400 as lo, 900 as hi from (select distinct repo_id, path from files)) select distinct s.repo_id, h.path, s.id from symbols s join h on h.repo_id = s.repo_id and h.path = s.file_path where s.start_byte < hi and s.end_byte > lo and s.start_byte < s.end_byte""")
def diff_overlap(spark, d):
    hunks = sub.paths(spark, d).withColumn("lo", F.lit(400)).withColumn("hi", F.lit(900))
    r = table(spark, d, "symbols").filter("start_byte < end_byte").select("repo_id", F.col("file_path").alias("path"), F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), "id").distinct()
    return text.overlaps(r, hunks)


@query("select event_type, cast(json_extract(props, '$.k') as bigint) as k, count(*) as n from events group by 1, 2")
def search_columns_json(spark, d):
    return table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query("select lang, count(distinct id) as symbols from (select id, coalesce(json_extract_string(framework_meta, '$.lang'), 'unknown') as lang from symbols) group by 1")
def framework_meta_languages(spark, d):
    return table(spark, d, "symbols").select("id", F.coalesce(F.get_json_object("framework_meta", "$.lang"), F.lit("unknown")).alias("lang")).groupBy("lang").agg(F.count_distinct("id").alias("symbols"))


# ------------------------------------------------------------------------------------------------- search

_DOCS = "dd as (select doc_id as doc, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda x: x <> '') as w from documents)"
_TERMS = "'fetch','load','read','get','planner'"
_BM = f"""with {_DOCS}, st as (select count(*) as n, avg(len(w)) as avg_len from dd), po as (select doc, l, term, count(*) as tf from (select doc, len(w) as l, unnest(w) as term from dd) where term in ({_TERMS}) group by 1, 2, 3),
df as (select term, count(*) as df from po group by 1), sc as (select doc, floor(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.2::double / (tf + 1.2::double * (1 - 0.75::double + 0.75::double * l / avg_len)))) * 10000 + 0.5) / 10000 as score, count(distinct term) as matched,
bool_or(term in ('fetch','load','read','get')) and bool_or(term = 'planner') as every from po join df using (term), st group by 1)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))


@query(_BM + " select doc, score, matched from sc")
def bm25_search(spark, d):
    docs = _docs(spark, d)
    return search.bm25(search.postings(docs), search.collection(docs), sorted({t for g in search.rewrite("fetch the planner") for t in g}))


@query(_BM + ", r as (select *, row_number() over (order by case when every then 1 else 0 end desc, score desc, doc) as rank from sc) select doc, score, rank from r where rank <= 20")
def search_or_fallback(spark, d):
    return search.search(_docs(spark, d), "fetch the planner", 20)


@query(_BM + """, a as (select doc, row_number() over (order by case when every then 1 else 0 end desc, score desc, doc) as rank from sc), b as (select doc_id as doc, row_number() over (order by length(coalesce(text, '')) desc, doc_id) as rank from documents),
u as (select doc, 1.0::double / (60 + rank) as s from a where rank <= 40 union all select doc, 0.5::double / (60 + rank) from b where rank <= 40) select doc, floor(sum(s) * 1000000 + 0.5) / 1000000 as score from u group by 1""")
def rrf_hybrid(spark, d):
    from pyspark.sql import Window as W

    keyword = search.search(_docs(spark, d), "fetch the planner", 40)
    longest = _docs(spark, d).select("doc", F.length("text").alias("n")).orderBy(F.desc("n"), "doc").limit(40)
    by_length = longest.select("doc", F.row_number().over(W.orderBy(F.desc("n"), "doc")).alias("rank"))  # 40 rows
    return search.fuse([(keyword, 1.0), (by_length, 0.5)])


# ------------------------------------------------------------------------------------------------- vectors

_NN = """with n as (select vec_id as id, embedding::double[] as v from embeddings where embedding is not null), u as (select id, v, sqrt(list_dot_product(v, v)) as norm from n),
s as (select a.id as query, b.id as id, floor(list_dot_product(a.v, b.v) / (a.norm * b.norm) * 1000000 + 0.5) / 1000000 as similarity from u a join u b on a.id <> b.id where {0})"""


@query(_NN.format("a.id % 100 = 0") + " select *, row_number() over (partition by query order by similarity desc, id) as rank from s qualify rank <= 10")
def similar_knn(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vectors.nearest(v, v.filter(F.col("id") % 100 == 0), 10).select("query", "id", "similarity", "rank")


@query(_NN.format("a.id % 100 = 0") + ", t as (select *, row_number() over (partition by query order by similarity desc, id) as rank from s) select query, count(*) as links from t where rank <= 50 and similarity >= 0.3 group by 1")
def similar_above_threshold(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vectors.nearest(v, v.filter(F.col("id") % 100 == 0), 50).filter(F.col("similarity") >= 0.3).groupBy("query").agg(F.count(F.lit(1)).alias("links"))


# ------------------------------------------------------------------------------------------------- ingest


@query("select repo_id, path, max(indexed_at) as indexed_at, max_by(content_hash, indexed_at) as content_hash from files group by 1, 2")
def latest_files(spark, d):
    f = table(spark, d, "files").select("repo_id", "path", "indexed_at", "content_hash")
    return ingest.latest(f, ["repo_id", "path"], "indexed_at").select("repo_id", "path", "indexed_at", "content_hash")


@query("""with f as (select repo_id || ':' || path as path, max(content_hash) as h from files group by 1), o as (select path, h from f where path not like '%.go'), n as (select path, case when path like '%.ini' then 'y' else h end as h from f where path not like '%.toml')
select coalesce(o.path, n.path) as path, case when o.path is null then 'new' when n.path is null then 'missing' when o.h = n.h then 'fresh' else 'stale' end as state from o full join n on o.path = n.path""")
def index_staleness(spark, d):
    f = table(spark, d, "files").groupBy(F.concat_ws(":", "repo_id", "path").alias("path")).agg(F.max("content_hash").alias("hash"))
    found = f.filter(~F.col("path").like("%.toml")).withColumn("hash", F.when(F.col("path").like("%.ini"), "y").otherwise(F.col("hash")))
    return ingest.staleness(f.filter(~F.col("path").like("%.go")), found)


@query(f"""with {EDGES}, fresh as (select src, dst from edges where dst % 2 = 0), gone as (select p_partkey as path from part where p_size = 7)
select src, dst from edges where src not in (select src from fresh) and src not in (select path from gone) and dst not in (select path from gone) union all select src, dst from fresh""")
def incremental_edges(spark, d):
    e = sub.part_edges(spark, d)
    gone = table(spark, d, "part").filter("p_size = 7").select(F.col("p_partkey").alias("path"))
    return ingest.replace_by_source(e, e.filter("dst % 2 = 0"), gone)


@query()
def extracted_symbols(spark, d):
    """Symbols that the extractors find, per repository and kind; counted over distinct files."""
    x = ingest.symbol_ids(ingest.extract(table(spark, d, "files")))
    return x.groupBy("repo_id", "kind").agg(F.count_distinct("path", "name", "start_byte").alias("symbols"))


@query()
def extracted_imports(spark, d):
    """Import specifiers per repository, with the number of files that use them."""
    x = ingest.extract(table(spark, d, "files")).filter("what = 'import'")
    return x.groupBy("repo_id", F.col("name").alias("specifier")).agg(F.count_distinct("path").alias("files"))


@query(r"""with f as (select distinct repo_id, path from files), b as (select distinct repo_id, path, unnest(regexp_extract_all(decode(raw_content), '(?:require\(|from )"\./([A-Za-z0-9_.-]+)"', 1)) as spec from files where raw_content is not null and regexp_matches(path, '\.(js|ts)$')),
c as (select b.repo_id, b.path, spec, o, case when contains(b.path, '/') then regexp_extract(b.path, '^(.*/)[^/]*$', 1) else '' end || spec || x as target from b cross join (values (0, '.ts'), (1, '.js'), (2, '/index.ts'), (3, '/index.js')) v(o, x)),
r as (select c.*, row_number() over (partition by c.repo_id, c.path, spec order by o) as k from c join f on f.repo_id = c.repo_id and f.path = c.target)
select repo_id, path as source, spec as specifier, target from r where k = 1""")
def resolved_imports(spark, d):
    """Relative imports of scripts, resolved to the first candidate that is a file."""
    from graphloom.functions.scalars import directory

    src = table(spark, d, "files").filter(F.col("raw_content").isNotNull() & F.col("path").rlike(r"\.(js|ts)$"))
    spec = F.regexp_extract_all(F.col("raw_content").cast("string"), F.lit(r'(?:require\(|from )"\./([A-Za-z0-9_.-]+)"'), F.lit(1))
    records = src.select("repo_id", "path", F.explode(spec).alias("specifier")).distinct()
    base = F.when(F.col("path").contains("/"), F.concat(directory(F.col("path")), F.lit("/"))).otherwise("")
    ends = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(x).alias("end")) for i, x in enumerate((".ts", ".js", "/index.ts", "/index.js"))])
    key = lambda p: F.concat_ws(chr(0), "repo_id", p)
    cand = records.select(key("path").alias("source"), "specifier", "repo_id", base.alias("base"), F.explode(ends).alias("e")).select("source", "specifier", "e.ordinal", key(F.concat("base", "specifier", "e.end")).alias("path"))
    out = graph.resolve(records.select(key("path").alias("source"), "specifier"), cand, sub.paths(spark, d).select(key("path").alias("path")))
    part = lambda c, i: F.get(F.split(c, chr(0)), F.lit(i))
    return out.select(part("source", 0).alias("repo_id"), part("source", 1).alias("source"), "specifier", part("target", 1).alias("target"))


# ------------------------------------------------------------------------------------------------- code

_SRC = """sp as (select distinct repo_id, id, name, kind, file_path as path, start_byte as st, end_byte as en from symbols where id is not null and start_byte >= 0 and end_byte > start_byte),
src as (select distinct sp.repo_id, id, name, kind, raw_content[st + 1:en] as source from sp join files f on f.repo_id = sp.repo_id and f.path = sp.path where raw_content is not null and en <= octet_length(raw_content))"""
_CALLS = _SRC + ", nm as (select distinct repo_id, name, id as dst from symbols where id is not null and name is not null and kind in ('function', 'method')), cl as (select repo_id, id as src, unnest(list_distinct(regexp_extract_all(decode(source), '\\b([A-Za-z_]\\w*)\\s*\\(', 1))) as name from src where kind in ('function', 'method')), calls as (select distinct cl.repo_id, src, dst from cl join nm using (repo_id, name) where src <> dst and name not in (" + ", ".join(f"'{w}'" for w in code.NOT_CALLS) + "))"


@query(f"with {_SRC} select repo_id, id, octet_length(source) as bytes, md5(source) as digest from src")
def symbol_sources(spark, d):
    s = code.sources(table(spark, d, "symbols"), table(spark, d, "files"))
    return s.select("repo_id", "id", F.octet_length("source").cast("bigint").alias("bytes"), F.md5("source").alias("digest"))


@query("select distinct repo_id, path, array_to_string(string_split(decode(raw_content), chr(10))[3:8], chr(10)) as lines from files where raw_content is not null")
def file_content_slice(spark, d):
    return code.file_slice(table(spark, d, "files"), 3, 8)


@query(f"with {_CALLS} select * from calls")
def call_edges(spark, d):
    return code.calls(table(spark, d, "symbols"), table(spark, d, "files"))


@query(f"with recursive {_CALLS}, edges as (select src, dst from calls), r(source, node, depth) as (select src, src, 0 from (select distinct src from edges) union select r.source, e.dst, r.depth + 1 from r join edges e on e.src = r.node where r.depth < 3) select source, node, min(depth) as depth from r group by 1, 2")
def call_hierarchy_depth3(spark, d):
    e = code.calls(table(spark, d, "symbols"), table(spark, d, "files")).select("src", "dst")
    return graph.reach(e, e.select(F.col("src").alias("node")).distinct(), 3)


_TYPES = """t as (select distinct repo_id, id, name, regexp_replace(signature, '<[^<>]*>', '', 'g') as sig from symbols where id is not null and kind in ('class', 'interface', 'struct')),
r as (select repo_id, id, 'extends' as relation, unnest(regexp_split_to_array(regexp_extract(sig, 'class\\s+\\w+\\s*\\(([^)]*)\\)', 1), '\\s*,\\s*')) as target from t union select repo_id, id, 'extends', unnest(regexp_split_to_array(regexp_extract(sig, '\\bextends\\s+([\\w.]+(?:\\s*,\\s*[\\w.]+)*)', 1), '\\s*,\\s*')) from t
union select repo_id, id, 'implements', unnest(regexp_split_to_array(regexp_extract(sig, '\\bimplements\\s+([\\w.]+(?:\\s*,\\s*[\\w.]+)*)', 1), '\\s*,\\s*')) from t),
i as (select repo_id, name as target, min(id) as target_id from t group by 1, 2), rel as (select distinct r.repo_id, r.id, relation, r.target, target_id from r left join i on i.repo_id = r.repo_id and i.target = r.target where r.target <> '')"""


@query(f"with {_TYPES} select * from rel")
def type_graph(spark, d):
    return code.type_relations(table(spark, d, "symbols"))


@query(f"with {_TYPES} select repo_id, target, count(distinct id) as implementors from rel group by 1, 2")
def find_implementations(spark, d):
    return code.implementors(code.type_relations(table(spark, d, "symbols")))


@query("""with n as (select distinct repo_id, name from symbols where kind = 'class' and name is not null), l as (select repo_id, path, i, ls[i] as line from (select repo_id, path, ls, unnest(range(1, len(ls) + 1)) as i from (select repo_id, path, string_split(decode(raw_content), chr(10)) as ls from files where raw_content is not null))),
h as (select distinct l.repo_id, path, i, line, n.name from (select *, unnest(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*')) as w from l) l join n on n.repo_id = l.repo_id and n.name = w)
select repo_id, name, case when regexp_matches(line, '^\\s*(//|#|\\*|/\\*)') then 'comment' when regexp_matches(line, '^\\s*(import|from|export .* from|use|require)\\b') then 'import' when regexp_matches(line, '["''`][^"''`]*\\b' || name || '\\b[^"''`]*["''`]') then 'string' when regexp_matches(line, '\\b' || name || '\\s*\\(') then 'call' else 'other' end as kind, count(*) as lines from h group by 1, 2, 3""")
def rename_reference_kinds(spark, d):
    return code.reference_kinds(table(spark, d, "symbols").filter("kind = 'class' and name is not null"), table(spark, d, "files"))


@query(f"with {BASKETS}{CO}, z as (select g, sha from b group by 1, 2 having count(*) between 1 and 30), hb as (select b.* from b join z using (g, sha)), pr as (select distinct hb.g, hb.sha, partner as item from hb join co on co.g = hb.g and co.target = hb.item where confidence >= 0.4) select g, sha as b, item as missing from pr where not exists (select 1 from hb where hb.g = pr.g and hb.sha = pr.sha and hb.item = pr.item)")
def verify_change_missing(spark, d):
    b = sub.baskets(spark, d)
    return code.missing_partners(b, history.co_change(b))


@query(f"""with {COMMITS}, p as (select repo_id, path, count(distinct sha) as commits, min(sec) as first_at, max(sec) as last_at from c where sec <= {AS_OF} group by 1, 2)
select distinct s.repo_id, s.id, commits, first_at, last_at, floor(commits / greatest(1.0::double, ({AS_OF} - first_at) / 86400.0::double) * 90 * 100 + 0.5) / 100 as churn from symbols s join p on p.repo_id = s.repo_id and p.path = s.file_path where s.id is not null""")
def symbol_history(spark, d):
    return code.symbol_history(table(spark, d, "symbols"), history.commits(table(spark, d, "git_metadata")), AS_OF)


@query(f"""with {EDGES}, seeds as (select p_partkey as node, p_size::double as score from part where p_size >= 49), u as (select node, score, 'match' as why from seeds union all select dst, score * 0.6::double, 'uses' from seeds join edges on node = src union all select src, score * 0.4::double, 'used_by' from seeds join edges on node = dst)
select node, max(score) as score, arg_max(why, (score, why)) as why from u group by 1 order by score desc, node limit 60""")
def task_context_pool(spark, d):
    seeds = table(spark, d, "part").filter("p_size >= 49").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("score"))
    return code.context_pool(seeds, sub.part_edges(spark, d))


@query()
def decorated_symbols(spark, d):
    return code.decorated(table(spark, d, "files")).groupBy("repo_id", "decorator").agg(F.count(F.lit(1)).alias("targets"))


# ------------------------------------------------------------------------------------------------- streams, as batches


@query("""with o as (select *, lag(ts) over (partition by user_id order by ts, event_id) as p from events), s as (select *, sum(case when p is null or ts - p >= interval '6 hours' then 1 else 0 end) over (partition by user_id order by ts, event_id) as k from o)
select user_id, count(*) as events, min(ts) as first_at, max(ts) as last_at from s group by user_id, k""")
def debounce_sessions(spark, d):
    s = changes.debounce(table(spark, d, "events"), "user_id", "6 hours")
    return s.select("user_id", "events", F.col("first_at").cast("timestamp_ntz").alias("first_at"), F.col("last_at").cast("timestamp_ntz").alias("last_at"))


@query("select user_id, arg_max(event_type, (ts, event_id)) as event_type from events group by 1")
def last_event_wins(spark, d):
    return changes.last_event(table(spark, d, "events"), ["user_id"], "event_type")


@query("select time_bucket(interval '1 day', ts) as start, event_type, count(*) as events from events group by 1, 2")
def windowed_event_counts(spark, d):
    w = changes.windowed_counts(table(spark, d, "events"), "1 day", "event_type")
    return w.withColumn("start", F.col("start").cast("timestamp_ntz"))
