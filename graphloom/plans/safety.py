"""Queries of change safety, coverage, columns, scopes, ledgers and documents."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom import substrate as sub
from graphloom.functions.scalars import entry_detail, entry_point, half_up
from graphloom.operators import code, graph, health, history, safety, text
from graphloom.plans.catalogue import _CALLS, _ENTRY, _SRC, _TYPES, BASKETS, CO, LINES, SPARSE, SYM, TEST_SQL, _symbols, query
from graphloom.plans.health import EDGES, mention_edges
from graphloom.sources.tables import table

_SYMS = "sy as (select distinct repo_id, id, name, kind, file_path, signature from symbols where id is not null and name is not null)"


@query(f"""with {_SYMS}, c as (select *, {_ENTRY} is not null as ep from sy where kind in ('class', 'interface', 'struct')), l as (select repo_id, path, unnest(range(1, len(ls) + 1)) as i, ls from (select repo_id, path, string_split(decode(raw_content), chr(10)) as ls from files where raw_content is not null)),
h as (select distinct l.repo_id, path, i, n.name from (select repo_id, path, i, unnest(regexp_extract_all(ls[i], '[A-Za-z_][A-Za-z0-9_]*')) as w from l) l join (select distinct repo_id, name from c) n on n.repo_id = l.repo_id and n.name = w),
f as (select repo_id, name, path, count(*) filter (not regexp_matches(path, '{TEST_SQL}')) as live, count(*) filter (regexp_matches(path, '{TEST_SQL}')) as test from h group by 1, 2, 3),
j as (select c.repo_id, c.id, coalesce(sum(case when f.path <> c.file_path then live end), 0) as live_references, coalesce(sum(case when f.path <> c.file_path then test end), 0) as test_references, coalesce(regexp_matches(any_value(c.signature), '^export( |$|\\n)'), false) as exported, any_value(c.ep) as entry_point
 from c left join f on f.repo_id = c.repo_id and f.name = c.name group by 1, 2)
select repo_id, id, live_references::bigint as live_references, test_references::bigint as test_references, exported, entry_point, case when live_references > 0 then 'blocked' when exported or entry_point or test_references > 0 then 'risky' else 'safe' end as verdict from j""")
def check_delete_safe(spark, d):
    """Whether types can be deleted."""
    s = table(spark, d, "symbols").filter("kind in ('class', 'interface', 'struct')").select("repo_id", "id", "name", "kind", "file_path", "signature").distinct()
    return safety.delete_safety(s, table(spark, d, "files"), entry_point(F.col("name"), F.col("kind"), F.col("file_path"), F.col("signature")).isNotNull())


@query(f"with {_SYMS}, r as (select distinct repo_id, id, file_path, 'log' || upper(substr(name, 1, 1)) || substr(name, 2) as new_name from sy where kind = 'function'), m as (select r.repo_id, r.id, r.new_name, max(case when s.file_path = r.file_path then 2 when s.file_path is not null then 1 else 0 end) as l from r left join sy s on s.repo_id = r.repo_id and s.name = r.new_name group by 1, 2, 3) select repo_id, id, new_name, case l when 2 then 'same_file' when 1 then 'repository' else 'none' end as conflict from m")
def rename_conflicts(spark, d):
    s = table(spark, d, "symbols").filter("name is not null")
    asked = s.filter("kind = 'function' and id is not null").select("repo_id", "id", F.concat(F.lit("log"), F.upper(F.substring("name", 1, 1)), F.expr("substring(name, 2)")).alias("new_name")).distinct()
    return safety.rename_conflicts(s, asked)


_MOVES = "mv as (select repo_id, dst as old, 'lib/' || regexp_extract(dst, '([^/]*)$', 1) as new from ge group by 1, 2)"


@query(f"""with {EDGES}, {_MOVES}, af as (select distinct ge.repo_id, coalesce(a.new, src) as src, coalesce(b.new, dst) as dst from ge left join mv a on a.repo_id = ge.repo_id and a.old = src left join mv b on b.repo_id = ge.repo_id and b.old = dst where coalesce(a.new, src) <> coalesce(b.new, dst)),
pa as (select x.repo_id, x.src as a, x.dst as b from af x join af y on y.repo_id = x.repo_id and y.src = x.dst and y.dst = x.src where x.src < x.dst), pb as (select x.repo_id, x.src as a, x.dst as b from ge x join ge y on y.repo_id = x.repo_id and y.src = x.dst and y.dst = x.src where x.src < x.dst),
fr as (select * from pa except select * from pb), cc as (select repo_id, unnest([a, b]) as new, count(*) as n from fr group by 1, 2)
select mv.repo_id, old, mv.new, coalesce(importers, 0) as importers, coalesce(n, 0) as new_cycles from mv left join im on im.repo_id = mv.repo_id and im.file_path = old left join cc on cc.repo_id = mv.repo_id and cc.new = mv.new""")
def check_move_safe(spark, d):
    """Every file that others mention, moved to lib/."""
    e = mention_edges(spark, d)
    moves = e.select("repo_id", F.col("dst").alias("old")).distinct().withColumn("new", F.concat(F.lit("lib/"), F.regexp_extract("old", "([^/]*)$", 1)))
    return safety.move_safety(e, moves)


@query(f"""with {SYM}, a as (select distinct repo_id, id, signature, summary as body from s where name not like 'a%'), b as (select distinct repo_id, id, case when kind = 'method' and pc = 2 then coalesce(signature, '') || '!' else signature end as signature, case when lc > 30 then 'x' else summary end as body from s where name not like 'z%' and name is not null)
select coalesce(a.repo_id, b.repo_id) as repo_id, coalesce(a.id, b.id) as id, case when a.id is null then 'added' when b.id is null then 'deleted' when a.signature is distinct from b.signature then 'signature_changed' else 'modified' end as change from a full join b on a.repo_id = b.repo_id and a.id = b.id where a.id is null or b.id is null or a.signature is distinct from b.signature or a.body is distinct from b.body""")
def analyze_diff_symbols(spark, d):
    """Changes of symbols between two made-up versions of the index."""
    s = _symbols(spark, d)
    old = s.filter("name not like 'a%'").select("repo_id", "id", "signature", F.col("summary").alias("body"))
    wide = (F.col("kind") == "method") & (F.col("m_param_count") == 2)
    new = s.filter("name not like 'z%' and name is not null").select("repo_id", "id", F.when(wide, F.concat(F.coalesce("signature", F.lit("")), F.lit("!"))).otherwise(F.col("signature")).alias("signature"), F.when(F.col("m_line_count") > 30, "x").otherwise(F.col("summary")).alias("body"))
    return safety.symbol_changes(old, new)


@query("""with l as (select distinct repo_id, path, line_no, (line_no * 7) % 3 as hits, ls, octet_length(encode(array_to_string(ls[1:line_no - 1], chr(10)))) + case when line_no > 1 then 1 else 0 end as at from (select repo_id, path, unnest(range(1, len(ls) + 1)) as line_no, ls from (select repo_id, path, string_split(decode(raw_content), chr(10)) as ls from files where raw_content is not null and path like '%.go'))),
sp as (select distinct repo_id, id, file_path as path, start_byte as st, end_byte as en from symbols where id is not null and start_byte >= 0 and end_byte > start_byte and file_path like '%.go'),
m as (select sp.repo_id, sp.id, l.line_no, hits from sp join l on l.repo_id = sp.repo_id and l.path = sp.path and l.at >= st and l.at < en), n as (select repo_id, id, count(*) as lines, count(*) filter (hits > 0) as covered from m group by 1, 2)
select *, case when covered = 0 then 'uncovered' when covered = lines then 'covered' else 'partial' end as status from n""")
def test_coverage_map(spark, d):
    """Lines of Go files under a made-up report, by symbol; a line belongs to the symbols in whose bytes it begins."""
    f = table(spark, d, "files").filter(F.col("path").endswith(".go"))
    lines = text.lines(f).select("repo_id", "path", F.col("line_no").alias("line"), "offset").distinct()
    spans = table(spark, d, "symbols").filter("id is not null and start_byte >= 0 and end_byte > start_byte").select("repo_id", F.col("file_path").alias("path"), "id", "start_byte", "end_byte").distinct()
    # the first and the last line that begin inside a span
    at = lines.join(spans, ["repo_id", "path"]).filter("offset >= start_byte and offset < end_byte").groupBy("repo_id", "path", "id").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"))
    return safety.coverage_map(at, lines.withColumn("hits", F.col("line") * 7 % 3))


@query()
def plan_refactoring(spark, d):
    """Steps of every finding."""
    return safety.refactoring_plan(health.refactoring(_symbols(spark, d), mention_edges(spark, d)))


@query(f"""with {BASKETS}{CO}, z as (select g, sha from b group by 1, 2 having count(*) between 1 and 30), hb as (select b.* from b join z using (g, sha)), pr as (select distinct hb.g, hb.sha, partner as item from hb join co on co.g = hb.g and co.target = hb.item where confidence >= 0.4),
mi as (select g, sha, count(*) as missing from pr where not exists (select 1 from hb where hb.g = pr.g and hb.sha = pr.sha and hb.item = pr.item) group by 1, 2), {SYM}, rk as (select repo_id as g, file_path as item, case when max(cc) >= 8 then 2 when max(cc) >= 5 then 1 else 0 end as w from s group by 1, 2),
pp as (select hb.g, hb.sha, count(distinct hb.item) as files, max(coalesce(w, 0)) as w, count(*) filter (regexp_matches(hb.item, '{TEST_SQL}')) as tests from hb left join rk on rk.g = hb.g and rk.item = hb.item group by 1, 2)
select pp.g, pp.sha as b, files, coalesce(missing, 0) as missing, case w when 2 then 'high' when 1 then 'review' else 'low' end as worst, tests, case when w = 2 and tests = 0 then 'no_go' when coalesce(missing, 0) > 0 or w >= 1 then 'review' else 'go' end as verdict from pp left join mi on mi.g = pp.g and mi.sha = pp.sha""")
def merge_readiness(spark, d):
    """Commits of up to thirty files; a file's risk is that of its most complex symbol."""
    b = sub.baskets(spark, d)
    small = b.groupBy("g", "b").agg(F.count(F.lit(1)).alias("k")).filter("k <= 30").select("g", "b")
    worst = F.max("m_cyclomatic_complexity")
    risk = _symbols(spark, d).groupBy(F.col("repo_id").alias("g"), F.col("file_path").alias("item")).agg(F.when(worst >= 8, "high").when(worst >= 5, "review").otherwise("low").alias("band"))
    return safety.readiness(b.join(small, ["g", "b"]), code.missing_partners(b, history.co_change(b)), risk)


@query("""with c as (select distinct repo_id, file_path as entity, name, signature, kind from symbols where file_path is not null and name is not null), i as (select repo_id, name as entity, min(id) as symbol_id from symbols where name is not null and id is not null group by 1, 2)
select c.repo_id, c.entity, c.name as "column", signature as description, symbol_id from c left join i on i.repo_id = c.repo_id and i.entity = c.entity where (contains(lower(c.name), 'token') or coalesce(contains(lower(signature), 'token'), false)) and kind = 'method'""")
def search_columns(spark, d):
    """Columns of a made-up provider (files as entities, symbols as columns, kinds as tags), by text and tag."""
    s = table(spark, d, "symbols").filter("file_path is not null and name is not null")
    column = F.struct(F.col("name").alias("name"), F.col("signature").alias("description"), F.array("kind").alias("tags"))
    provider = s.groupBy("repo_id", F.col("file_path").alias("entity")).agg(F.to_json(F.struct(F.array_sort(F.collect_set(column)).alias("columns"))).alias("metadata"))
    return safety.search_columns(safety.columns_of(provider, s), "token", ["method"]).drop("tags").distinct()


@query("select count(distinct id) filter (file_path = 'src/a' or file_path like 'src/a/%') as by_folder, count(distinct id) filter (starts_with(file_path, 'src/a')) as by_text, count(distinct id) filter (regexp_matches(file_path, '^src/(?:[^/]+/)*[^/]*\\.(?:ts|js)$')) as by_glob from symbols where id is not null")
def scope_filters(spark, d):
    """Symbols in a scope: by folder, by text, by glob."""
    p = F.col("file_path")
    pick = lambda c: F.count_distinct(F.when(c, F.col("id")))
    return table(spark, d, "symbols").filter("id is not null").agg(
        pick(safety.in_scope(p, "src/a")).alias("by_folder"), pick(safety.in_scope(p, "src/a", False)).alias("by_text"), pick(p.rlike(safety.glob_pattern("src/**/*.{ts,js}"))).alias("by_glob")
    )


@query("with m as (select distinct id, '{\"cfg\": [{\"predicates\": [\"' || kind || '\", \"' || coalesce(name, '') || '\"]}]}' as meta, kind from symbols where id is not null) select kind, count(*) as symbols from m where kind = 'struct' group by 1")
def cfg_predicates(spark, d):
    """Symbols of which an entry of the JSON meta names a predicate."""
    meta = F.to_json(F.struct(F.array(F.struct(F.array("kind", F.coalesce("name", F.lit(""))).alias("predicates"))).alias("cfg")))
    m = table(spark, d, "symbols").filter("id is not null").select("id", "kind", meta.alias("meta")).distinct()
    return m.filter(safety.any_predicate(F.col("meta"), "cfg", "struct")).groupBy("kind").agg(F.count(F.lit(1)).alias("symbols"))


@query("select repo_id, count(*) as files, sum(ceil(length(decode(raw_content)) / 4.0))::bigint as tokens from (select distinct repo_id, path, raw_content from files where raw_content is not null) group by 1")
def token_estimates(spark, d):
    f = table(spark, d, "files").filter("raw_content is not null").select("repo_id", "path", "raw_content").distinct()
    return f.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.sum(F.ceil(F.length(F.col("raw_content").cast("string")) / 4)).cast("bigint").alias("tokens"))


@query("select event_type, count(*) as calls, count(*) filter (ts > m - interval '24 hours') as last_day, count(*) filter (value > 90) as limited from events, (select max(ts) as m from events) group by 1")
def usage_ledger(spark, d):
    """Calls per tool: all, those of the last day before the newest event, those over the limit."""
    e = table(spark, d, "events")
    newest = e.agg(F.max("ts").alias("m"))
    return e.crossJoin(F.broadcast(newest)).groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.expr("ts > m - interval '24 hours'")).alias("last_day"), F.count_if(F.col("value") > 90).alias("limited"))  # one row


@query(f"with {_CALLS} select repo_id, dst as id, count(distinct src) as callers from calls group by 1, 2")
def afferent_symbols(spark, d):
    e = code.calls(table(spark, d, "symbols"), table(spark, d, "files"))
    return e.groupBy("repo_id", F.col("dst").alias("id")).agg(F.count_distinct("src").alias("callers"))


@query(f"with recursive {_CALLS}, edges as (select src, dst from calls), r(source, node, depth) as (select dst, dst, 0 from (select distinct dst from edges) union select r.source, e.src, r.depth + 1 from r join edges e on e.dst = r.node where r.depth < 2), m as (select source, node, min(depth) as depth from r group by 1, 2), k as (select distinct a.dst as source from edges a join edges b on a.src = b.dst where b.src = a.dst union select src from edges where src = dst) select m.source, count(*) - 1 as callers, k.source is not null as cyclic from m left join k on k.source = m.source group by m.source, k.source")
def call_hierarchy_callers(spark, d):
    """Callers of every called function within two steps, and whether it is among them."""
    e = code.calls(table(spark, d, "symbols"), table(spark, d, "files")).select("src", "dst")
    up = graph.reach(e, e.select(F.col("dst").alias("node")).distinct(), 2, reverse=True)
    back = e.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi").select(F.col("src").alias("source")).distinct().withColumn("c", F.lit(True))
    return up.groupBy("source").agg((F.count(F.lit(1)) - 1).alias("callers")).join(back, "source", "left").select("source", "callers", F.coalesce("c", F.lit(False)).alias("cyclic"))


@query(f"with {_SRC} select repo_id, id, len(regexp_extract_all(decode(source), '\\bmeasure\\s*\\([a-z]')) as matches from src where kind in ('function', 'method') and regexp_matches(decode(source), '\\bmeasure\\s*\\([a-z]') and regexp_matches(decode(source), '\\bfor\\b')")
def lexical_scope_matches(spark, d):
    """Calls with a variable as first argument, in functions that loop."""
    s = code.sources(table(spark, d, "symbols"), table(spark, d, "files")).filter(F.col("kind").isin("function", "method")).withColumn("t", F.col("source").cast("string"))
    pattern = r"\bmeasure\s*\([a-z]"
    return s.filter(F.col("t").rlike(pattern) & F.col("t").rlike(r"\bfor\b")).select("repo_id", "id", F.regexp_count("t", F.lit(pattern)).alias("matches"))


_PARTS = "list_sort(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: length(x) >= 2)))"


@query(f"""with n as (select distinct repo_id, name, {_PARTS} as t from symbols where kind = 'class' and name is not null), p as (select repo_id, name, len(t) as k, unnest(t) as w from n where len(t) >= 2),
f as (select distinct repo_id, path, unnest(regexp_extract_all(lower(decode(raw_content)), '[a-z0-9]+')) as w from files where raw_content is not null and regexp_matches(path, '{TEST_SQL}'))
select repo_id, name, count(*) as files from (select p.repo_id, p.name, f.path from p join f on f.repo_id = p.repo_id and f.w = p.w group by p.repo_id, p.name, f.path, p.k having count(*) = p.k) group by 1, 2""")
def composite_mentions(spark, d):
    """Types all of whose name's words a test file holds."""
    from graphloom.functions.scalars import is_test_path, name_tokens

    n = table(spark, d, "symbols").filter("kind = 'class' and name is not null").select("repo_id", "name", name_tokens(F.col("name")).alias("t")).distinct().filter(F.size("t") >= 2)
    p = n.select("repo_id", "name", F.size("t").alias("k"), F.explode("t").alias("w"))
    word = F.array_distinct(F.regexp_extract_all(F.lower(F.col("raw_content").cast("string")), F.lit("[a-z0-9]+"), F.lit(0)))
    f = table(spark, d, "files").filter(F.col("raw_content").isNotNull() & is_test_path(F.col("path"))).select("repo_id", "path", F.explode(word).alias("w")).distinct()
    return p.join(f, ["repo_id", "w"]).groupBy("repo_id", "name", "path", "k").agg(F.count(F.lit(1)).alias("n")).filter("n = k").groupBy("repo_id", "name").agg(F.count(F.lit(1)).alias("files"))


@query(f"with {LINES}, t as (select distinct repo_id, path, line_no from l where regexp_matches(line, '\\breturn total\\b')) select repo_id, path, line_no, position from (select *, row_number() over (order by path, line_no, repo_id) as position from t) where position <= 50")
def search_text_first(spark, d):
    """The first fifty hits in order of path and line: a search that may stop early."""
    hits = text.search(table(spark, d, "files"), r"\breturn total\b").select("repo_id", "path", "line_no")
    first = hits.orderBy("path", "line_no", "repo_id").limit(50)
    return first.withColumn("position", F.row_number().over(W.orderBy("path", "line_no", "repo_id")))  # 50 rows


@query(f"with {SYM}, a as (select repo_id, file_path, kind, count(*) as n, floor(avg(cc) * 100 + 0.5) / 100 as cc from s where file_path is not null group by 1, 2, 3) select repo_id, file_path, '## ' || file_path || chr(10) || string_agg('- ' || kind || ': ' || n || ', complexity ' || printf('%.2f', cc), chr(10) order by kind) as markdown from a group by 1, 2")
def generate_docs(spark, d):
    """A page of Markdown per file."""
    a = _symbols(spark, d).filter("file_path is not null").groupBy("repo_id", "file_path", "kind").agg(F.count(F.lit(1)).alias("n"), half_up(F.avg("m_cyclomatic_complexity"), 2).alias("cc"))
    line = F.concat(F.lit("- "), "kind", F.lit(": "), "n", F.lit(", complexity "), F.format_string("%.2f", "cc"))
    rows = a.groupBy("repo_id", "file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", line.alias("x")))), lambda s: s["x"]), "\n").alias("rows"))
    return rows.select("repo_id", "file_path", F.concat(F.lit("## "), "file_path", F.lit("\n"), "rows").alias("markdown"))


@query(f"select repo_id, id, e as kind, case when e in ('lambda_handler', 'main_function', 'cli_handler') then 'high' when e = 'server_startup' then 'medium' else 'low' end as confidence from (select distinct repo_id, id, {_ENTRY} as e from symbols where id is not null) where e is not null")
def entry_points(spark, d):
    """Entry points with the confidence of the rule that found them."""
    s = table(spark, d, "symbols").filter("id is not null")
    e = s.select("repo_id", "id", entry_detail(F.col("name"), F.col("kind"), F.col("file_path"), F.col("signature")).alias("e")).filter("e.kind is not null")
    return e.select("repo_id", "id", "e.kind", "e.confidence").distinct()


@query("select id, root_path, symbol_count, file_count, json_array_length(languages) as languages, regexp_extract(root_path, '([^/]+)$', 1) as name from repos")
def list_repos(spark, d):
    r = table(spark, d, "repos")
    return r.select("id", "root_path", "symbol_count", "file_count", F.json_array_length("languages").alias("languages"), F.regexp_extract("root_path", "([^/]+)$", 1).alias("name"))


@query("select r_regionkey as node, n_nationkey + 100 as descendant, 1 as depth from region join nation on n_regionkey = r_regionkey union all select n_nationkey + 100, n_nationkey + 100, 0 from nation")
def type_ancestors(spark, d):
    """Every nation with its ancestors: itself and its region."""
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 100).alias("src"), F.col("n_regionkey").alias("dst"))
    up = graph.reach(n, n.select(F.col("src").alias("node")), 2)
    return up.select("node", F.col("source").alias("descendant"), "depth")


@query("select repo_id, author_email as author, count(distinct commit_sha) as commits from git_metadata where author_email is not null and trim(author_email) <> '' and commit_sha is not null group by 1, 2")
def git_log_authors(spark, d):
    g = table(spark, d, "git_metadata").filter("author_email is not null and trim(author_email) <> '' and commit_sha is not null")
    return g.groupBy("repo_id", F.col("author_email").alias("author")).agg(F.count_distinct("commit_sha").alias("commits"))


@query()
def search_ast(spark, d):
    """Assertions in Python files."""
    return code.syntax_nodes(table(spark, d, "files"), "Assert")


_MEMBERS = """sp as (select distinct repo_id, id, name, kind, file_path as path, start_byte as st, end_byte as en from symbols where id is not null and start_byte >= 0 and end_byte > start_byte),
ow as (select m.repo_id, m.path, m.id, m.name, arg_max(t.id, (t.st, t.id)) as owner from sp m join sp t on t.repo_id = m.repo_id and t.path = m.path and t.kind in ('class', 'interface', 'struct') and t.st <= m.st and m.en <= t.en where m.kind = 'method' group by 1, 2, 3, 4),
mb as (select distinct repo_id, owner, name from ow)"""


@query(f"with {_MEMBERS} select repo_id, owner, count(*) as methods from mb group by 1, 2")
def type_members(spark, d):
    """Methods per type."""
    return code.members(table(spark, d, "symbols")).groupBy("repo_id", "owner").agg(F.count(F.lit(1)).alias("methods"))


@query(f"with {_TYPES}, {_MEMBERS}, w as (select distinct rel.repo_id, rel.id, target_id, mb.name from rel join mb on mb.repo_id = rel.repo_id and mb.owner = target_id where target_id is not null and rel.id <> target_id) select w.repo_id, w.id, target_id, count(m2.name)::int as implemented, coalesce(string_agg(case when m2.name is null then w.name end, ',' order by w.name), '') as missing from w left join mb m2 on m2.repo_id = w.repo_id and m2.owner = w.id and m2.name = w.name group by 1, 2, 3")
def missing_methods(spark, d):
    s = table(spark, d, "symbols")
    return code.missing_methods(code.type_relations(s), s)


@query(f"with {SPARSE}, c as (select 2 as length, least(a.src, a.dst) || '>' || greatest(a.src, a.dst) as cycle from edges a join edges b on a.dst = b.src and b.dst = a.src where a.src < a.dst union all select 3, a.src || '>' || a.dst || '>' || b.dst from edges a join edges b on a.dst = b.src join edges c on b.dst = c.src and c.dst = a.src where a.dst > a.src and b.dst > a.src and b.dst <> a.dst) select length, cycle, case when length <= 3 then 'error' else 'warning' end as severity from c")
def find_cycles(spark, d):
    """Simple cycles of two and three nodes, rooted at their smallest node; up to three nodes are errors."""
    e = sub.part_edges(spark, d, 30)
    two = graph.cycles(e, 2).select(F.lit(2).alias("length"), F.concat_ws(">", "n1", "n2").alias("cycle"))
    three = graph.cycles(e, 3).select(F.lit(3).alias("length"), F.concat_ws(">", "n1", "n2", "n3").alias("cycle"))
    return two.unionByName(three).withColumn("severity", F.when(F.col("length") <= 3, "error").otherwise("warning"))


@query(f"with {EDGES}, {BASKETS}{CO}, se as (select repo_id, file_path as file, 1.0::double as score from (select distinct repo_id, file_path from symbols where name = 'main' or kind = 'interface') where file_path is not null), u as (select repo_id, file, score, 'match' as why from se union all select se.repo_id, dst, 0.6::double, 'uses' from se join ge on ge.repo_id = se.repo_id and src = file union all select se.repo_id, src, 0.4::double, 'used_by' from se join ge on ge.repo_id = se.repo_id and dst = file union all select se.repo_id, partner, 0.5::double * confidence, 'changes_with' from se join co on co.g = se.repo_id and co.target = file where confidence >= 0.4) select repo_id, file, max(score) as score, arg_max(why, (score, why)) as why from u group by 1, 2 order by score desc, repo_id, file limit 60")
def get_task_context(spark, d):
    """Files that a task about interfaces and main functions needs: seeds, what they use, what uses them, what changes with
    them; the best sixty."""
    s = table(spark, d, "symbols").filter("(name = 'main' or kind = 'interface') and file_path is not null").select("repo_id", F.col("file_path").alias("file")).distinct()
    e = mention_edges(spark, d)
    co = history.co_change(sub.baskets(spark, d)).filter("confidence >= 0.4")
    out = s.join(e.withColumnRenamed("src", "file"), ["repo_id", "file"]).select("repo_id", F.col("dst").alias("file"), F.lit(0.6).alias("score"), F.lit("uses").alias("why"))
    into = s.join(e.withColumnRenamed("dst", "file"), ["repo_id", "file"]).select("repo_id", F.col("src").alias("file"), F.lit(0.4).alias("score"), F.lit("used_by").alias("why"))
    with_ = s.join(co.select(F.col("g").alias("repo_id"), F.col("target").alias("file"), "partner", "confidence"), ["repo_id", "file"]).select("repo_id", F.col("partner").alias("file"), (F.col("confidence") * 0.5).alias("score"), F.lit("changes_with").alias("why"))
    every = s.select("repo_id", "file", F.lit(1.0).alias("score"), F.lit("match").alias("why")).unionByName(out).unionByName(into).unionByName(with_)
    best = every.groupBy("repo_id", "file").agg(F.max_by(F.struct("score", "why"), F.struct("score", "why")).alias("b"))
    return best.select("repo_id", "file", "b.score", "b.why").orderBy(F.desc("score"), "repo_id", "file").limit(60)
