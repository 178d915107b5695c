"""Queries of scores over repositories, on the file graph that mentions of declared names make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import substrate as sub
from graphloom.operators import graph, health, history
from graphloom.plans.catalogue import _MID, _TESTED, BASKETS, CHURN, CO, COMMITS, SYM, _churn, _symbols, _tested, query
from graphloom.sources.tables import table

EDGES = """nm as (select repo_id, name, min(file_path) as dst from (select distinct repo_id, name, file_path from symbols where kind in ('class', 'interface', 'struct', 'function') and length(name) >= 3 and repo_id is not null and file_path is not null) group by 1, 2 having count(*) = 1),
wd as (select distinct repo_id, path, unnest(regexp_extract_all(decode(raw_content), '[A-Za-z_][A-Za-z0-9_]*')) as w from files where raw_content is not null),
ge as (select distinct wd.repo_id, wd.path as src, nm.dst from wd join nm on nm.repo_id = wd.repo_id and nm.name = wd.w where wd.path <> nm.dst),
im as (select repo_id, dst as file_path, count(distinct src) as importers from ge group by 1, 2),
cy as (select distinct a.repo_id, unnest([a.src, a.dst]) as file_path, a.src as component from ge a join ge b on a.repo_id = b.repo_id and a.src = b.dst and a.dst = b.src where a.src < a.dst)"""
KINDS = "('function', 'method', 'hook', 'composable', 'middleware', 'route')"
MEASURED = f"""me as (select *, least(coalesce(cyclomatic_complexity, 0) / 20.0::double, 1) * 100 * 0.5::double + least(nd / 4.0::double, 1) * 100 * 0.25::double + least(pc / 7.0::double, 1) * 100 * 0.15::double + least(lc / 100.0::double, 1) * 100 * 0.1::double as debt
  from s where kind in {KINDS} and (cyclomatic_complexity is not null or nesting_depth is not null or param_count is not null))"""
SCORES = f"""with {SYM}, {MEASURED}, {EDGES}, {COMMITS}, {CHURN}, sc as (
select repo_id, file_path, 'complexity' as category, max(debt) as score from me group by 1, 2
union all select repo_id, file_path, 'structural', max(score) from (select repo_id, file_path, case when importers >= 20 then 90.0::double else least(79.0::double, floor(importers / 20.0::double * 79 + 0.5)) end as score from im where importers > 10 union all select repo_id, file_path, 80.0::double from cy) group by 1, 2
union all select repo_id, file_path, 'maintainability', max(score) from (select repo_id, file_path, least(100.0::double, floor(line_count / 500.0::double * 70 + 0.5)) as score from s where kind = 'class' and line_count > 500
  union all select repo_id, file_path, least(90.0::double, floor(count(*) / 20.0::double * 70 + 0.5)) from s where kind = 'method' group by 1, 2 having count(*) > 20) group by 1, 2
union all select repo_id, path, 'volatility', case when commits >= 25 then 100.0::double else floor(commits / 25.0::double * 100 + 0.5) end from churn)"""
RADAR = f"""with {SYM}, {MEASURED}, {EDGES}, {COMMITS}, {CHURN},
a1 as (select repo_id, floor(greatest(0.0::double, 100 - avg(debt) - least(count(*) filter (cyclomatic_complexity >= 20) * 10, 30)) + 0.5) as complexity from me group by 1),
a2 as (select repo_id, floor(greatest(0.0::double, 100 - count(*) filter (importers > 10) / count(*)::double * 60 - count(*) filter (importers >= 20) * 15) + 0.5) as coupling from im group by 1),
pf as (select repo_id, file_path, count(*) filter (kind = 'class' and line_count > 500) as big, count(*) filter (kind = 'method') as methods, count(*) as n from s group by 1, 2),
a3 as (select pf.repo_id, floor(greatest(0.0::double, 100 - least(sum(case when im.file_path is null then n else 0 end) * 3, 40) - least((sum(big) + count(*) filter (methods > 20)) * 15, 40)) + 0.5) as maintainability from pf left join im on im.repo_id = pf.repo_id and im.file_path = pf.file_path group by 1),
a4 as (select repo_id, floor(count(*) filter (length(summary) > 5) / count(*)::double * 100 + 0.5) as documentation from s where kind not in ('type', 'const', 'enum') group by 1),
a5 as (select repo_id, floor(greatest(0.0::double, 100 - count(*) filter (commits >= 10) / count(*)::double * 60 - count(*) filter (commits >= 25) * 10) + 0.5) as stability from churn group by 1),
r as (select f.repo_id, complexity, coupling, maintainability, documentation, stability from (select distinct repo_id from files) f left join a1 using (repo_id) left join a2 using (repo_id) left join a3 using (repo_id) left join a4 using (repo_id) left join a5 using (repo_id)),
x as (select *, floor((coalesce(complexity * 0.30::double, 0) + coalesce(coupling * 0.25::double, 0) + coalesce(maintainability * 0.25::double, 0) + coalesce(documentation * 0.10::double, 0) + coalesce(stability * 0.10::double, 0))
  / (case when complexity is null then 0 else 0.30::double end + case when coupling is null then 0 else 0.25::double end + case when maintainability is null then 0 else 0.25::double end + case when documentation is null then 0 else 0.10::double end + case when stability is null then 0 else 0.10::double end) + 0.5) as overall from r),
radar as (select *, case when overall >= 80 then 'A' when overall >= 60 then 'B' when overall >= 40 then 'C' when overall >= 20 then 'D' else 'F' end as grade from x)"""


def mention_edges(spark: SparkSession, d: str) -> DataFrame:
    """(repo_id, src, dst): files that mention a type or function that exactly one other file of their repository declares."""
    s = table(spark, d, "symbols").filter(F.col("kind").isin("class", "interface", "struct", "function") & (F.length("name") >= 3) & F.col("repo_id").isNotNull() & F.col("file_path").isNotNull())
    one = s.select("repo_id", "name", "file_path").distinct().groupBy("repo_id", "name").agg(F.min("file_path").alias("dst"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    word = F.array_distinct(F.regexp_extract_all(F.col("raw_content").cast("string"), F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    w = table(spark, d, "files").filter("raw_content is not null").select("repo_id", F.col("path").alias("src"), F.explode(word).alias("name"))
    return w.join(one, ["repo_id", "name"]).filter("src <> dst").select("repo_id", "src", "dst").distinct()


def two_cycles(edges: DataFrame) -> DataFrame:
    """(repo_id, file_path, component): files that mention each other, under the smaller of both."""
    back = edges.select("repo_id", F.col("src").alias("dst"), F.col("dst").alias("src"))
    pairs = edges.join(back, ["repo_id", "src", "dst"], "left_semi").filter("src < dst")
    return pairs.select("repo_id", F.explode(F.array("src", "dst")).alias("file_path"), F.col("src").alias("component")).distinct()


@query(f"with {EDGES} select repo_id, src, dst from ge")
def file_mention_edges(spark, d):
    return mention_edges(spark, d)


@query(f"with {EDGES}, o as (select repo_id, src as file_path, count(distinct dst) as ce from ge group by 1, 2) select coalesce(o.repo_id, im.repo_id) as repo_id, coalesce(o.file_path, im.file_path) as file_path, coalesce(ce, 0) as ce, coalesce(importers, 0) as ca, floor(coalesce(ce, 0) / (coalesce(ce, 0) + coalesce(importers, 0))::double * 1000 + 0.5) / 1000 as instability from o full join im on im.repo_id = o.repo_id and im.file_path = o.file_path")
def coupling_files(spark, d):
    e = mention_edges(spark, d)
    c = graph.coupling(e.select(F.struct("repo_id", "src").alias("src"), F.struct("repo_id", F.col("dst").alias("src")).alias("dst")))
    return c.select("node.repo_id", F.col("node.src").alias("file_path"), "ce", "ca", "instability")


@query(f"with {EDGES}, s as (select distinct repo_id, id, kind, file_path from symbols where id is not null) select s.repo_id, kind, count(*) as symbols from s where not exists (select 1 from ge where ge.repo_id = s.repo_id and ge.dst = s.file_path) group by 1, 2")
def dead_code_files(spark, d):
    """Symbols of files that nothing mentions, per repository and kind."""
    s = table(spark, d, "symbols").filter("id is not null").select("repo_id", "id", "kind", "file_path").distinct()
    alive = mention_edges(spark, d).select("repo_id", F.col("dst").alias("file_path")).distinct()
    return s.join(alive, ["repo_id", "file_path"], "left_anti").groupBy("repo_id", "kind").agg(F.count(F.lit(1)).alias("symbols"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    e = mention_edges(spark, d)
    return health.debt_scores(_symbols(spark, d), e, two_cycles(e).select("repo_id", "file_path").distinct(), _churn(spark, d))


@query(SCORES + """, p as (select repo_id, file_path, max(case when category = 'complexity' then score else 0 end) as c, max(case when category = 'structural' then score else 0 end) as s, max(case when category = 'maintainability' then score else 0 end) as m, max(case when category = 'volatility' then score else 0 end) as v from sc group by 1, 2),
k as (select repo_id, case when bool_or(category = 'volatility') then 0.2::double else 0.0::double end as w from sc group by 1), x as (select p.repo_id, p.file_path, floor((c * 0.4::double + s * 0.35::double + m * 0.25::double) * (1 - w) + v * w + 0.5) as debt from p join k using (repo_id))
select *, case when debt < 20 then 'A' when debt < 40 then 'B' when debt < 60 then 'C' when debt < 80 then 'D' else 'F' end as grade from x""")
def debt_report_files(spark, d):
    return health.debt_files(_scores(spark, d))


@query(SCORES + """, a as (select repo_id, category, avg(score) as mean, max(score) as worst, count(*) as files, case category when 'complexity' then 0.6::double when 'structural' then 0.5::double when 'maintainability' then 0.6::double else 0.4::double end as w from sc group by 1, 2)
select repo_id, category, least(100.0::double, floor(mean * w + worst * (1 - w) + 0.5)) as score, files from a""")
def debt_report_categories(spark, d):
    return health.debt_categories(_scores(spark, d))


def _radar(spark: SparkSession, d: str) -> DataFrame:
    return health.radar(_symbols(spark, d), mention_edges(spark, d), table(spark, d, "files"), _churn(spark, d))


@query(RADAR + " select * from radar")
def health_radar_axes(spark, d):
    return _radar(spark, d)


@query(RADAR + """, t as (select repo_id, unnest(['complexity', 'coupling', 'maintainability', 'documentation', 'stability', 'overall']) as axis, unnest([complexity, coupling, maintainability, documentation, stability, overall]) as v from radar), p as (select min(repo_id) as base, max(repo_id) as head from radar)
select p.base, p.head, a.axis, b.v - a.v as delta, case when b.v > a.v then 'improved' when b.v < a.v then 'declined' when b.v = a.v then 'unchanged' else 'unknown' end as verdict from p join t a on a.repo_id = p.base join t b on b.repo_id = p.head and b.axis = a.axis""")
def diff_health_radar(spark, d):
    """The radar of the last repository against that of the first."""
    r = _radar(spark, d)
    pairs = table(spark, d, "files").agg(F.min("repo_id").alias("base"), F.max("repo_id").alias("head"))
    return health.radar_difference(r, r, pairs)


ANTI = f"""with {SYM}, {EDGES}, an as (
select repo_id, component as file_path, null as id, 'circular_dependency' as pattern, 'error' as severity, count(*) as n from (select distinct repo_id, component, file_path from cy) group by 1, 2
union all select repo_id, file_path, id, 'god_class', 'error', line_count from s where kind = 'class' and line_count > 500
union all select repo_id, file_path, null, 'god_class_methods', 'error', count(*) from s where kind = 'method' group by 1, 2 having count(*) > 20
union all select repo_id, file_path, null, 'high_coupling', case when importers > 20 then 'error' else 'warning' end, importers from im where importers > 10
union all select repo_id, file_path, id, 'deep_nesting', 'error', nesting_depth from s where nesting_depth > 5
union all select repo_id, file_path, id, 'dead_export', 'warning', 1 from s where not exists (select 1 from im where im.repo_id = s.repo_id and im.file_path = s.file_path)
union all select repo_id, file_path, id, 'long_parameter_list', case when param_count > 10 then 'error' else 'warning' end, param_count from s where kind in {KINDS} and param_count > 7)"""


def _antipatterns(spark: SparkSession, d: str) -> DataFrame:
    e = mention_edges(spark, d)
    return health.antipatterns(_symbols(spark, d), e, two_cycles(e))


@query(ANTI + " select distinct repo_id, file_path, id, pattern, severity, n::bigint as n from an")
def antipattern_union(spark, d):
    return _antipatterns(spark, d)


@query(ANTI + ", u as (select distinct * from an) select repo_id, count(*) filter (severity = 'error') as errors, count(*) filter (severity <> 'error') as warnings, greatest(0, least(100, 100 - count(*) filter (severity = 'error') * 10 - count(*) filter (severity <> 'error') * 2))::bigint as health from u group by 1")
def antipattern_health(spark, d):
    return health.antipattern_health(_antipatterns(spark, d))


@query(f"""with {SYM}, {EDGES}, f as (select *, case when lc > 100 then 'large' when lc > 50 then 'medium' when lc > 20 then 'small' else 'trivial' end as ef, coalesce(cyclomatic_complexity, 0) as c0 from s where kind in {KINDS}),
u as (select repo_id, id as subject, 'extract_function' as finding, case when c0 > 30 or lc > 150 then 'high' when c0 > 15 or lc > 80 then 'medium' else 'low' end as impact, ef as effort from f where lc > 50 and c0 > 10
union all select repo_id, id, 'introduce_parameter_object', case when pc > 10 then 'high' when pc > 7 then 'medium' else 'low' end, ef from f where pc > 5
union all select repo_id, file_path, 'extract_class', case when count(*) > 30 then 'high' when count(*) > 20 then 'medium' else 'low' end, case when count(*) > 30 then 'large' else 'medium' end from s group by repo_id, file_path having count(*) > 15 and count(distinct kind) >= 3
union all select repo_id, id, 'inline_function', 'low', 'trivial' from f where lc > 0 and lc <= 3 and (repo_id, file_path) in (select repo_id, file_path from im where importers = 1)
union all select repo_id, id, 'simplify_conditional', case when nd > 7 then 'high' when nd > 5 then 'medium' else 'low' end, ef from f where nd > 4 and rc > 3)
select distinct *, case impact when 'high' then 0 when 'medium' then 1 else 2 end as impact_rank, case effort when 'trivial' then 0 when 'small' then 1 when 'medium' then 2 else 3 end as effort_rank from u""")
def refactoring_union(spark, d):
    return health.refactoring(_symbols(spark, d), mention_edges(spark, d))


@query(f"""with {SYM}, {EDGES}, a as (select repo_id, count(distinct path) as files from files group by 1), b as (select repo_id, count(*) as symbols, floor(avg(cyclomatic_complexity) * 1000 + 0.5) / 1000 as avg_cc from s group by 1), c as (select repo_id, count(*) as edges from ge group by 1),
g as (select repo_id, floor(avg(d) * 1000 + 0.5) / 1000 as avg_coupling from (select repo_id, f, count(*) as d from (select repo_id, src as f from ge union all select repo_id, dst from ge) group by 1, 2) group by 1)
select a.repo_id, files, coalesce(symbols, 0) as symbols, coalesce(edges, 0) as edges, avg_cc, avg_coupling from a left join b using (repo_id) left join c using (repo_id) left join g using (repo_id)""")
def architecture_snapshot(spark, d):
    return health.snapshot(_symbols(spark, d), table(spark, d, "files"), mention_edges(spark, d))


@query(f"""with {COMMITS}, {CHURN}, {BASKETS}{CO}, {_TESTED}, {EDGES},
base as (select distinct repo_id, id, file_path as path, coalesce(cyclomatic_complexity, 0) as cc from symbols where id is not null and file_path is not null),
pt as (select g as repo_id, target as path, count(*) as strong from co where confidence >= 0.4 group by 1, 2),
x as (select base.*, coalesce(commits, 0) as commits, coalesce(strong, 0) as strong, coalesce(importers, 0) as importers, tested.id is null as gap from base left join churn on churn.repo_id = base.repo_id and churn.path = base.path
  left join pt on pt.repo_id = base.repo_id and pt.path = base.path left join im on im.repo_id = base.repo_id and im.file_path = base.path left join tested on tested.repo_id = base.repo_id and tested.id = base.id),
h1 as (select repo_id, v, {_MID} as p from (select repo_id, commits as v, count(*) as n from churn group by 1, 2)),
h2 as (select repo_id, v, {_MID} as p from (select repo_id, cc as v, count(*) as n from x group by 1, 2)),
h3 as (select repo_id, v, {_MID} as p from (select repo_id, importers as v, count(*) as n from x group by 1, 2)),
y as (select x.repo_id, x.id, coalesce(h1.p, 0.0::double) as churn_pct, h3.p as centrality_pct, h2.p as complexity_pct, case when gap then 1.0::double else 0.0::double end as test_gap, least(strong / 5.0::double, 1.0::double) as co_change
  from x left join h1 on h1.repo_id = x.repo_id and h1.v = commits join h2 on h2.repo_id = x.repo_id and h2.v = cc join h3 on h3.repo_id = x.repo_id and h3.v = importers),
z as (select *, floor((0.25::double * churn_pct + 0.25::double * centrality_pct + 0.20::double * complexity_pct + 0.15::double * test_gap + 0.15::double * co_change) * 100 + 0.5) as risk from y)
select repo_id, id, churn_pct, centrality_pct, complexity_pct, test_gap, co_change, risk, case when risk > 66 then 'high' when risk >= 33 then 'review' else 'low' end as band from z""")
def symbol_risk(spark, d):
    s = table(spark, d, "symbols").filter("id is not null and file_path is not null").select("repo_id", "id", F.col("file_path").alias("path"), F.coalesce("cyclomatic_complexity", F.lit(0)).alias("cc")).distinct()
    return history.symbol_risk(s, _churn(spark, d), history.co_change(sub.baskets(spark, d)), _tested(spark, d), mention_edges(spark, d))


@query(f"""with {COMMITS}, {CHURN}, f as (select distinct repo_id, path, octet_length(raw_content) % 7 as commits from files where raw_content is not null), h as (select repo_id, commits as v, count(*) as n from churn group by 1, 2), q as (select distinct repo_id, commits as v from f)
select q.repo_id, q.v as commits, floor((coalesce(sum(case when h.v < q.v then h.n end), 0) + coalesce(sum(case when h.v = q.v then h.n end), 0) / 2.0::double) / coalesce(nullif(sum(h.n), 0), 1) * 1000000 + 0.5) / 1000000 as percentile from q left join h using (repo_id) group by 1, 2""")
def midrank_absent_values(spark, d):
    """Percentiles of values that need not occur in the distribution."""
    f = table(spark, d, "files").filter("raw_content is not null").select("repo_id", "path", (F.octet_length("raw_content") % 7).cast("bigint").alias("commits")).distinct()
    return history.midrank_of(f, _churn(spark, d), ["repo_id"], "commits", "percentile").select("repo_id", "commits", "percentile")
