"""Operators of the core on small tables with answers by hand, nulls, ties and empty tables."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars
from graphloom.operators import graph, history, ingest, metrics, search, text, vectors
from graphloom.streaming import changes
from tests.conftest import rows

SYMBOLS = "id string, repo_id string, name string, kind string, file_path string, start_byte int, end_byte int, signature string, summary string, line_count int, cyclomatic_complexity int, cognitive_complexity int, param_count int, return_count int, nesting_depth int"


def edges(spark, text_):
    return spark.createDataFrame([tuple(e.split(">")) for e in text_.split()], "src string, dst string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_reach_first_depth(spark):
    e = edges(spark, "entry>utils utils>helpers utils>types entry>types types>entry")
    got = {(r.node, r.depth) for r in graph.reach(e, nodes(spark, "entry"), 3).collect()}
    assert got == {("entry", 0), ("utils", 1), ("types", 1), ("helpers", 2)}
    back = {(r.node, r.depth) for r in graph.reach(e, nodes(spark, "helpers"), 2, reverse=True).collect()}
    assert back == {("helpers", 0), ("utils", 1), ("entry", 2)}


def test_reach_truncated(spark):
    e = edges(spark, "a>b b>c c>d")
    got = {r.source: (r.nodes, r.truncated) for r in graph.truncated(e, nodes(spark, "a", "d"), 2).collect()}
    assert got == {"a": (3, True), "d": (1, False)}


def test_components(spark):
    e = edges(spark, "a>b b>c c>a c>d d>e x>y y>x y>a z>z")
    got = dict(rows(graph.components(e)))
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "x": "x", "y": "x", "z": "z"}


def test_cycles(spark):
    e = edges(spark, "a>b b>a b>c c>a c>x x>y a>a")
    assert rows(graph.cycles(e, 2)) == [("a", "b")]
    assert rows(graph.cycles(e, 3)) == [("a", "b", "c")]


def test_coupling_sums(spark):
    e = edges(spark, "a>b a>b a>c c>b d>d")
    got = {r.node: (r.ce, r.ca, r.instability) for r in graph.coupling(e).collect()}
    assert got == {"a": (2, 0, 1.0), "b": (0, 2, 0.0), "c": (1, 1, 0.5), "d": (1, 1, 0.5)}
    assert sum(v[0] for v in got.values()) == sum(v[1] for v in got.values())


def test_dead_layers_paths_hierarchy(spark):
    e = edges(spark, "a>b b>c a>c c>c")
    assert rows(graph.dead(nodes(spark, "a", "b", "c", "d"), e)) == [("a",), ("d",)]
    layers = spark.createDataFrame([("a", "ui"), ("b", "db"), ("c", "db"), ("c", "zz")], "node string, layer string")
    rules = spark.createDataFrame([("ui", "db", False)], "from_layer string, to_layer string, allowed boolean")
    assert rows(graph.layer_violations(e, layers, rules)) == [("ui", "db", 2)]
    p = {tuple(r.path) for r in graph.paths(e, nodes(spark, "a"), nodes(spark, "c"), 3).collect()}
    assert p == {("a", "c"), ("a", "b", "c")}
    h = spark.createDataFrame([("b", "a"), ("c", "b")], "child string, parent string")
    assert rows(graph.hierarchy(h, 3)) == [("a", "a", 0, "a"), ("a", "b", 1, "a/b"), ("a", "c", 2, "a/b/c")]
    assert rows(graph.most_connected(e, 2)) == rows(edges(spark, "a>c c>c"))


def test_resolve_takes_first_candidate(spark):
    records = spark.createDataFrame([("s", "./x"), ("s", "./gone")], "source string, specifier string")
    cand = spark.createDataFrame([("s", "./x", 1, "x.js"), ("s", "./x", 0, "x.ts"), ("s", "./gone", 0, "gone.ts")], "source string, specifier string, ordinal int, path string")
    files = spark.createDataFrame([("x.js",), ("x.ts",)], "path string")
    assert rows(graph.resolve(records, cand, files)) == [("s", "./x", "x.ts")]


def test_empty_graph(spark):
    e = edges(spark, "a>b").limit(0)
    for df in (graph.coupling(e), graph.cycles(e, 3), graph.components(e), graph.high_coupling(e), graph.reach(e, nodes(spark, "a").limit(0), 2)):
        assert df.collect() == []


def test_co_change(spark):
    data = [("g", f"c{i}", f) for i in range(6) for f in ("target", "partner")] + [("g", "mega", f"f{i}") for i in range(38)] + [("g", "mega", "target"), ("g", "mega", "partner"), ("g", "one", "target"), ("g", "one", "other")] + [("g", f"p{i}", "pad") for i in range(20)]
    b = spark.createDataFrame(data, "g string, b string, item string")
    got = history.co_change(b, targets=b.filter("item = 'target'")).collect()
    assert [(r.partner, r.support, r.weighted_support) for r in got] == [("partner", 6, 6.0)]
    assert got[0].confidence == round(6 / 8, 3) and got[0].lift == round(6 * 28 / (8 * 7), 3)


def test_midrank(spark):
    v = spark.createDataFrame([("r", x) for x in (1, 1, 2, 5)], "repo_id string, v int")
    assert rows(history.midrank(v, ["repo_id"], "v", "p")) == [("r", 1, 0.25), ("r", 2, 0.625), ("r", 5, 0.875)]


def test_commits_cleaned(spark):
    schema = "repo_id string, file_path string, commit_sha string, author_name string, author_email string, message string, commit_date bigint"
    data = [("r", "./a", "s", "n", " ", "", 1_700_000_000), ("r", "a", "s", "n", None, "", 1_700_000_000_000), ("r", None, "s", "n", "m", "", 1), (None, "a", "s", "n", "m", "", 1), ("r", "d\\a", "t", None, None, None, None)]
    c = history.commits(spark.createDataFrame(data, schema))
    assert rows(c) == [("r", "a", "s", "n", 1_700_000_000), ("r", "d/a", "t", None, None)]
    churn = history.file_churn(c, 1_700_000_100).collect()
    assert [(r.path, r.commits, r.risk) for r in churn] == [("a", 1, "active")]


@pytest.fixture(scope="module")
def symbols(spark):
    data = [("1", "r", "fetchUser", "function", "a.ts", 0, 50, "export function fetchUser(x)", "Fetches.", 10, 12, 3, 2, 1, 2), ("1", "r", "fetchUser", "function", "a.ts", 0, 50, "export function fetchUser(x)", "Fetches.", 10, 12, 3, 2, 1, 2),
            ("2", "r", "userFetch", "function", "b.ts", 5, 9, "function userFetch()", None, None, None, None, None, None, None), ("3", "r", None, None, None, None, None, None, None, None, None, None, None, None, None), (None, "r", "x", "function", "a.ts", 0, 1, "x", "", 1, 1, 1, 1, 1, 1)]
    return metrics.distinct_symbols(spark.createDataFrame(data, SYMBOLS))


def test_metrics(spark, symbols):
    assert symbols.count() == 3
    assert {(r.id, r.score) for r in metrics.quality_top(symbols).collect()} == {("1", 17.0), ("2", 1.0), ("3", 1.0)}
    assert [(r.id_a, r.id_b, r.jaccard) for r in metrics.similar_names(symbols).collect()] == []  # one class: equal words
    assert rows(metrics.public_api(symbols)) == [("r", "1", "fetchUser", "function")]
    hot = {r.file_path: r.score for r in metrics.hotspots(symbols).collect()}
    assert hot["a.ts"] == scalars_round(12 / 30 * 35 + 12 / 50 * 30 + 20 + 0.2 * 15)
    assert metrics.hotspots(symbols.limit(0)).collect() == []


def scalars_round(x):
    import math

    return math.floor(x + 0.5)


def test_names_and_paths(spark):
    df = spark.createDataFrame([("parseHTTPResponse_v2", "src/a.test.ts"), ("x", "tests/b.py"), ("getUserById", "src/tester.py")], "n string, p string")
    got = df.select(scalars.name_tokens(F.col("n")), scalars.is_test_path(F.col("p")), scalars.directory(F.col("p")), scalars.file_stem(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(["http", "parse", "response", "v2"], True, "src", "a.test"), ([], True, "tests", "b"), (["by", "get", "id", "user"], False, "src", "tester")]


FILES = "repo_id string, path string, raw_content binary"


def test_text(spark):
    body = "a = 1\r\n# TODO(ann): tidy\nraise ValueError(é)\nend"
    f = spark.createDataFrame([("r", "a.py", body.encode()), ("r", "a.py", body.encode()), ("r", "n.py", None), ("r", "e.py", b"")], FILES)
    assert rows(text.tagged(f)) == [("r", "a.py", 2, "TODO", "ann", "tidy")]
    assert rows(text.search(f, r"\braise\b")) == [("r", "a.py", 3, 1)]
    assert rows(text.context(f, r"\braise\b", 1)) == [("r", "a.py", 3, "# TODO(ann): tidy", "end")]
    got = {r.line_no: r.offset for r in text.lines(f).filter("path = 'a.py'").distinct().collect()}
    assert got == {1: 0, 2: 7, 3: 25, 4: 46}
    assert text.search(f.limit(0), "x").collect() == []


def test_enclosing_prefers_narrow(spark):
    hits = spark.createDataFrame([("r", "a", 50), ("r", "a", 9000), ("r", "a", 99999)], "repo_id string, path string, offset bigint")
    spans = spark.createDataFrame([("r", "a", 0, 10_000, "class"), ("r", "a", 40, 60, "method")], "repo_id string, path string, start int, end int, id string")
    got = {r.offset: r.symbol_id for r in text.enclosing(hits, spans).collect()}
    assert got == {50: "method", 9000: "class", 99999: None}


def test_mentions(spark):
    f = spark.createDataFrame([("r", "t.py", b"use(fetchUser); fetchUserAll"), ("q", "t.py", b"fetchUser")], FILES)
    n = spark.createDataFrame([("r", "1", "fetchUser"), ("r", "2", "fetch"), ("r", "3", "a"), ("r", None, None)], "repo_id string, id string, name string")
    assert rows(text.mentions(n, f)) == [("r", "1", 1)]


def test_search(spark):
    d = spark.createDataFrame([(1, "load the planner"), (2, "planner planner"), (3, "nothing"), (4, None), (5, "")], "doc int, text string")
    got = [(r.doc, r.rank) for r in search.search(d.withColumn("text", F.coalesce("text", F.lit(""))), "fetch the planner").orderBy("rank").collect()]
    assert got[0] == (1, 1) and {g[0] for g in got} == {1, 2}
    a = spark.createDataFrame([(1, 1), (2, 2)], "doc int, rank int")
    b = spark.createDataFrame([(2, 1)], "doc int, rank int")
    assert {(r.doc, r.score) for r in search.fuse([(a, 1.0), (b, 1.0)]).collect()} == {(1, 0.016393), (2, 0.032522)}


def test_nearest(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [3.0, 0.0])], "id int, v array<float>")
    got = [(r.query, r.id, r.rank) for r in vectors.nearest(v, v.filter("id = 1"), 2).orderBy("rank").collect()]
    assert got == [(1, 2, 1), (1, 7, 2)]


def test_ingest(spark):
    r = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "z")], "path string, at int, hash string")
    assert rows(ingest.latest(r, ["path"], "at")) == [("a", 2, "y"), ("b", None, "z")]
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, hash string")
    assert dict(rows(ingest.staleness(old, new))) == {"a": "fresh", "b": "stale", "c": "missing", "d": "new"}
    assert rows(ingest.changed(old, new)) == [("b", "9"), ("d", "4")] and rows(ingest.vanished(old, new)) == [("c", "3")]


def test_incremental_edges_equal_rebuild(spark):
    before, after = "a>b b>c c>a d>a", "a>b b>a c>a"
    fresh, gone = edges(spark, "b>a"), spark.createDataFrame([("d",)], "path string")
    assert rows(ingest.replace_by_source(edges(spark, before), fresh, gone)) == rows(edges(spark, after))


def test_extract(spark):
    py = b"import os\nfrom a.b import c\nclass K:\n    def m(self):\n        pass\ndef f():\n    return 1\n"
    ts = b'import { x } from "./x";\nexport function go() {}\nconst y = require("./y");\nexport class Z {}\n'
    f = spark.createDataFrame([("r", "a.py", py), ("r", "b.ts", ts), ("r", "bad.py", b"def ("), ("r", "n.py", None)], FILES)
    got = {(r.path, r.what, r.name, r.kind) for r in ingest.extract(f).collect()}
    assert ("bad.py", "symbol") not in {x[:2] for x in got}
    assert got == {("a.py", "import", "os", None), ("a.py", "import", "a.b", None), ("a.py", "symbol", "K", "class"), ("a.py", "symbol", "m", "method"), ("a.py", "symbol", "f", "function"),
                   ("b.ts", "import", "./x", None), ("b.ts", "import", "./y", None), ("b.ts", "symbol", "go", "function"), ("b.ts", "symbol", "Z", "class")}


def test_discover(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.bin").write_bytes(b"\0\1")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "c.js").write_text("x")
    (tmp_path / "server.key").write_text("x")
    (tmp_path / "big.py").write_text("x = 1\n" * 500)
    kept, report = ingest.discover(spark, str(tmp_path), max_bytes=2000)
    assert [r.path.rsplit("/", 1)[-1] for r in kept.collect()] == ["a.py"]
    assert rows(report) == [("binary", 1), ("folder", 1), ("secret", 1), ("size", 1)]


def test_streams_equal_batches(spark, tmp_path):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    data = [(i, t0 + dt.timedelta(seconds=s), i % 2, k) for i, (s, k) in enumerate([(0, "a"), (1, "b"), (3, "c"), (30, "d"), (31, "e"), (200, "f")])]
    batch = spark.createDataFrame(data, schema)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    want = rows(changes.windowed_counts(batch, "1 minute", "user_id").select("start", "user_id", "events"))
    q = changes.windowed_counts(stream, "1 minute", "user_id", late="10 seconds").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("w")) == want
    assert rows(changes.debounce(batch, "user_id", "10 seconds").select("user_id", "events")) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 1)]
    assert rows(changes.last_event(batch, ["user_id"], "event_type")) == [(0, "e"), (1, "f")]

    seen = []
    q = changes.apply_changes(stream, lambda df, i: seen.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sum(seen) == len(data)


def test_token_bucket(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    data = [(i, t0 + dt.timedelta(seconds=s), 1) for i, s in enumerate([0, 0, 0, 1, 10])]
    batch = spark.createDataFrame(data, "event_id bigint, ts timestamp_ntz, user_id bigint")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = changes.token_bucket(stream, "user_id", rate=1.0, burst=2.0).writeStream.outputMode("append").format("memory").queryName("tb").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.event_id, r.allowed) for r in spark.table("tb").collect()} == {(0, True), (1, True), (2, False), (3, True), (4, True)}
