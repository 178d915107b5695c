"""Readers, writers and code relations on small inputs."""

import json

from graphloom.operators import code, history, metrics
from graphloom.sources import formats
from tests.conftest import rows

FILES = "repo_id string, path string, raw_content binary"
SYMBOLS = "id string, repo_id string, name string, kind string, file_path string, start_byte int, end_byte int, signature string"


def test_git_log(spark, tmp_path):
    text = "\x1eaaa\x1fAnn\x1fann@x\x1f1700000000\x1ffix: it\n\nsrc/a.py\nsrc/b.py\n\x1ebbb\x1fBob\x1fbob@x\x1f1700000100\x1fempty\n"
    (tmp_path / "log.txt").write_text(text)
    got = formats.git_log(spark, str(tmp_path / "log.txt")).select("commit_sha", "author_name", "commit_date", "message", "file_path")
    assert rows(got) == [("aaa", "Ann", 1700000000, "fix: it", "src/a.py"), ("aaa", "Ann", 1700000000, "fix: it", "src/b.py")]


def test_diffs(spark):
    patch = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@ def f\n-a\n+b\n@@ -9 +10,0 @@\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1,5 @@\n"
    got = formats.diffs(spark.createDataFrame([(1, patch), (2, None), (3, "")], "patch_id int, patch string"))
    assert rows(got) == sorted([(1, "x.py", "x.py", 1, 2, 1, 3), (1, "x.py", "x.py", 9, 1, 10, 0), (1, None, "new.py", 0, 0, 1, 5)], key=repr)


def test_istanbul(spark):
    report = json.dumps({"a.js": {"path": "a.js", "statementMap": {"0": {"start": {"line": 3}}, "1": {"start": {"line": 3}}, "2": {"start": {"line": 5}}}, "s": {"0": 0, "1": 4, "2": 0}}})
    got = formats.istanbul(spark.createDataFrame([(report,), (None,), ("no json",)], "report string"))
    assert rows(got) == [("a.js", 3, 4), ("a.js", 5, 0)]


def test_dbt_columns(spark):
    text = "models:\n  - name: orders\n    columns:\n      - name: id\n        description: key\n        tags: [pk]\n      - name: total\n"
    got = formats.dbt_columns(spark.createDataFrame([("s.yml", text), ("bad.yml", "a: ["), ("n.yml", None)], "path string, text string"))
    assert rows(got) == [("s.yml", "orders", "id", "key", ["pk"]), ("s.yml", "orders", "total", None, [])]


def test_bundle_and_snapshot(spark, tmp_path):
    t = spark.createDataFrame([("r", 1), ("q", 2)], "repo_id string, n int")
    formats.export_bundle({"t": t}, str(tmp_path), "r")
    assert rows(formats.import_bundle(spark, str(tmp_path), {"t": "repo_id string, n int"})["t"]) == [("r", 1)]
    for i in range(2):
        formats.append_snapshot(t, f"s{i}", i, str(tmp_path / "snap"))
    snaps = spark.read.parquet(str(tmp_path / "snap")).collect()
    assert len(snaps) == 4 and {json.loads(s.metrics)["n"] for s in snaps} == {1, 2}
    assert formats.render_mermaid([("a", "b")]) == 'graph LR\n  n0["a"]\n  n1["b"]\n  n0 --> n1'


def test_sources_and_calls(spark):
    body = "é = 1\ndef a():\n    b()\n    print(b)\n\ndef b():\n    if (x): b()\n".encode()
    one, two = body.index(b"def a"), body.index(b"def b")
    f = spark.createDataFrame([("r", "m.py", body), ("r", "m.py", body), ("r", "n.py", None)], FILES)
    s = spark.createDataFrame([("1", "r", "a", "function", "m.py", one, two, "def a()"), ("1", "r", "a", "function", "m.py", one, two, "def a()"), ("2", "r", "b", "function", "m.py", two, len(body), "def b()"), ("3", "r", "c", "function", "m.py", 9, 10_000, "c()"), ("4", "r", None, None, None, None, None, None)], SYMBOLS)
    got = {r.id: bytes(r.source) for r in code.sources(s, f).collect()}
    assert got == {"1": body[one:two], "2": body[two:]}
    assert rows(code.calls(s, f)) == [("r", "1", "2")]
    assert rows(code.file_slice(f, 2, 3)) == [("r", "m.py", "def a():\n    b()")]


def test_types_and_references(spark):
    s = spark.createDataFrame([("1", "r", "A", "class", "a.ts", 0, 1, "class A<T> extends B implements C, D"), ("2", "r", "B", "class", "a.ts", 0, 1, "class B"), ("3", "r", "E", "class", "a.py", 0, 1, "class E(B, F)"), ("4", "r", "X", "class", "a.py", 0, 1, None)], SYMBOLS)
    rel = code.type_relations(s)
    assert rows(rel) == sorted([("r", "1", "extends", "B", "2"), ("r", "1", "implements", "C", None), ("r", "1", "implements", "D", None), ("r", "3", "extends", "B", "2"), ("r", "3", "extends", "F", None)], key=repr)
    assert dict((t, n) for _, t, n in rows(code.implementors(rel)))["B"] == 2
    f = spark.createDataFrame([("r", "a.py", b'# B is used\nfrom m import B\nx = "B"\nB(1)\ny: B\n')], FILES)
    assert rows(code.reference_kinds(s.filter("name = 'B'"), f)) == sorted([("r", "B", k, 1) for k in ("comment", "import", "string", "call", "other")])
    d = spark.createDataFrame([("r", "a.py", b"@app.route('/')\ndef index():\n    pass\n")], FILES)
    assert rows(code.decorated(d)) == [("r", "a.py", "app.route", "index")]


def test_missing_partners(spark):
    b = spark.createDataFrame([("g", f"c{i}", x) for i in range(5) for x in ("a", "b")] + [("g", "z", "a")], "g string, b string, item string")
    assert rows(code.missing_partners(b, history.co_change(b))) == [("g", "z", "b")]


def test_snapshot_diff(spark):
    old = spark.createDataFrame([("r", "a", "1"), ("r", "b", "1")], "repo_id string, path string, hash string")
    new = spark.createDataFrame([("r", "a", "2"), ("r", "c", "1")], "repo_id string, path string, hash string")
    assert rows(metrics.snapshot_diff(old, new)) == [("r", "a", "changed"), ("r", "b", "removed"), ("r", "c", "added")]
