"""Extractors, resolvers, graph edges, search, health, safety and the library's entry points, on small inputs."""

import pytest

from graphloom import api
from graphloom.extract import process as px
from graphloom.extract import resolve as rs
from graphloom.extract.complexity import measure
from graphloom.extract.frameworks import ADAPTERS, Adapters
from graphloom.extract.languages import Language, standard
from graphloom.operators import edges as eg
from graphloom.operators import graph, safety
from graphloom.operators import symbolsearch as ss
from graphloom.sources import formats

from .conftest import rows

FILES = "repo_id string, path string, raw_content binary, declared_package string"


def files(spark, items):
    return spark.createDataFrame([("r", p, None if t is None else t.encode() if isinstance(t, str) else t, g) for p, t, g in [(*i, None)[:3] for i in items]], FILES)


HANDLERS = {
    "a.ts": ("import {A} from './a';\nexport class K {\n  run(a: string): void {\n    b();\n  }\n}\nexport const go = (a: number) => a;\ninterface I { a: string }\ntype T = string;\nenum E { A }\n", {"K:class", "run:method", "go:function", "I:interface", "T:type", "E:enum"}, {"./a"}),
    "a.js": ("const x = require('./x');\nfunction f() {}\nclass C { m() { return 1 } }\n", {"f:function", "C:class"}, {"./x"}), "a.go": ('package a\nimport "x/y"\nfunc (s *S) Run() {}\nfunc F() {}\nconst C = 1\n', {"Run:method", "F:function", "C:const"}, {"x/y"}),
    "A.java": ("import a.B;\npublic class A {\n  public List<String> run(int a) {\n    return null;\n  }\n  enum K { A }\n}\ninterface Q {}\n", {"A:class", "run:method", "K:enum", "Q:interface"}, {"a.B"}), "a.kt": ("import a.B\nclass A(val x: Int) {\n  fun run(): Int { return 1 }\n}\ntypealias T = Int\n", {"A:class", "run:method", "T:type"}, {"a.B"}),
    "a.cs": ("using System.Text;\npublic class A {\n  public int X { get; set; }\n  public int Run(int a) { return 1; }\n}\n", {"A:class", "X:property", "Run:method"}, {"System.Text"}), "a.rb": ("require 'json'\nmodule M\n  class A\n    def run\n    end\n  end\nend\n", {"M:type", "A:class", "run:method"}, {"json"}),
    "a.rs": ("use crate::a::B;\nstruct S;\ntrait T {}\nfn f() {}\nmacro_rules! m { () => {} }\n", {"S:struct", "T:interface", "f:function", "m:macro"}, {"crate::a::B"}), "a.c": ("#include <x.h>\n#define M 1\nstruct s { int a; };\nint run(int a) {\n  return 0;\n}\n", {"M:macro", "s:struct", "run:function"}, {"x.h"}),
    "a.cpp": ("#include \"x.h\"\nnamespace n {\nclass A {\n};\nint A::x() { return 1; }\n}\n", {"n:namespace", "A:class", "x:method"}, {"x.h"}), "a.m": ("#import \"A.h\"\n@interface A : B\n- (void)run;\n@end\n@protocol P\n@end\n", {"A:class", "run:method", "P:interface"}, {"A.h"}),
    "a.sh": ("source ./b.sh\nLIMIT=1\nrun() {\n  x\n}\n", {"LIMIT:const", "run:function"}, {"./b.sh"}), "a.sql": ("create table a.b (x int);\ncreate function f() returns int;\n", {"a.b:class", "f:function"}, set()), "a.proto": ('import "b.proto";\nmessage A {}\nservice S {\n  rpc Run(A) returns (A);\n}\n', {"A:class", "S:interface", "Run:method"}, {"b.proto"}),
    "a.php": ("<?php\nuse App\\User;\nclass A {\n  public function run() { return 1; }\n}\nfunction f() {}\n", {"A:class", "run:method", "f:function"}, {"App\\User"}), "a.swift": ("import UIKit\nstruct S {\n  func run() {}\n}\nprotocol P {}\n", {"S:struct", "run:method", "P:interface"}, {"UIKit"}), "a.dart": ("import 'b.dart';\nclass A {\n  int run(int a) { return 1; }\n}\n", {"A:class", "run:method"}, {"b.dart"}),
    "a.scala": ("import a.B\nobject A { def run(x: Int): Int = 1 }\ntrait T\n", {"A:class", "T:interface"}, {"a.B"}), "a.groovy": ("import a.B\nclass A {\n  def run(x) { 1 }\n}\n", {"A:class", "run:method"}, {"a.B"}), "a.ex": ("defmodule A.B do\n  alias C.D\n  def run(a) do\n    a\n  end\nend\n", {"A.B:class", "run:function"}, {"C.D"}),
    "a.erl": ("-module(a).\n-include(\"a.hrl\").\nrun(A) ->\n  A.\n", {"a:class", "run:function"}, {"a.hrl"}), "a.f90": ("module m\n  use n\ncontains\n  subroutine s(a)\n  end subroutine\nend module\n", {"m:class", "s:function"}, {"n"}), "a.gd": ("extends 'res://b.gd'\nclass_name A\nfunc run():\n\tpass\n", {"A:class", "run:function"}, {"res://b.gd"}),
    "a.gleam": ("import gleam/io\npub fn run(a) { 1 }\npub type T { A }\n", {"run:function", "T:class"}, {"gleam/io"}), "a.graphql": ("type A { x: Int }\nquery Q { a }\n", {"A:class", "Q:function"}, set()), "a.hs": ("import Data.Map\ndata T = A\nrun :: Int -> Int\nrun a = a\n", {"T:class", "run:function"}, {"Data.Map"}), "a.hcl": ('job "x" {\n}\ny = 1\n', {"job:class", "y:const"}, set()),
    "a.tf": ('variable "x" {}\nmodule "m" {\n  source = "./m"\n}\n', {"x:const", "m:class"}, {"./m"}), "a.css": ("@import 'b.css';\n.a { color: red }\n", {".a:const"}, {"b.css"}), "a.scss": ("@use 'b';\n@mixin m { a: b }\n$x: 1;\n", {"m:type", "x:const"}, {"b"}), "a.less": ("@x: 1;\n.m(@a) { a: b }\n", {"x:const", ".m:function"}, set()),
    "a.lua": ("local x = require('a.b')\nlocal function f(a)\nend\nfunction M:run() end\n", {"f:function", "run:method"}, {"a.b"}), "a.nix": ("{\n  x = import ./c.nix;\n  f = a: b;\n}\n", {"f:function"}, {"./c.nix"}), "a.pl": ("package A::B;\nuse C::D;\nsub run { 1 }\n", {"A::B:class", "run:function"}, {"C::D"}), "a.r": ("library(dplyr)\nrun <- function(a) {\n  1\n}\n", {"run:function"}, {"dplyr"}),
    "a.xml": ('<view id="x"/>', {"view:class", "x:const"}, set()), "a.html": ('<app-x #ref [val]="y"></app-x>', {"app-x:component", "ref:const", "val:property"}, set()), "a.yaml": ("openapi: 3.0.0\npaths:\n  /a:\n    get:\n      x: y\ncomponents:\n  schemas:\n    A:\n      type: object\n", {"GET /a:route", "A:type"}, set()),
    "a.py": ("import os\nfrom .a import b\nLIMIT = 1\nclass A:\n    def run(self): pass\ndef f(): pass\n", {"LIMIT:const", "A:class", "run:method", "f:function"}, {"os", ".a"}),
}


@pytest.mark.parametrize("path", sorted(HANDLERS))
def test_handlers(path):
    text, symbols, specs = HANDLERS[path]
    got = standard().parse(path, text)
    assert symbols <= {f"{s.name}:{s.kind}" for s in got.symbols}
    assert specs == {i.specifier for i in got.imports}
    raw = text.encode()
    for s in got.symbols:
        assert 0 <= s.start < s.end <= len(raw)
    for cut in range(0, len(text), 7):  # no prefix of a file makes a handler fail
        standard().parse(path, text[:cut])


def test_last_registration_holds():
    r = standard()
    r.add(Language("mine", (".py",), (("const", r"^(?P<name>\w+)"),), reach="line", hide="hash"))
    assert [s.kind for s in r.parse("a.py", "x\n").symbols] == ["const"]


FRAMEWORKS = [
    ("a.js", "const e = require('express');\napp.get('/u', h);\n// app.get('/no')\n", "express", "GET /u"), ("a.ts", "import f from 'fastify';\nfastify.post('/x', g);\n", "fastify", "POST /x"), ("a.ts", "import { Get } from '@nestjs/common';\n@Get(':id')\none() {}\n", "nestjs", "GET :id"), ("pages/u/[id].tsx", "export default function U() {}", "nextjs", "PAGE /u/:id"),
    ("server/a.ts", "export default defineEventHandler(() => 1)", "nuxt", "defineEventHandler"), ("a.jsx", "import React from 'react';\nfunction Card() {}\n", "react", "Card"), ("a.ts", "import { C } from '@angular/core';\n@Component({})\nexport class A {}\n", "angular", "A"), ("A.vue", "<template/>", "vue", "A"), ("B.svelte", "<p/>", "svelte", "B"), ("C.astro", "---", "astro", "C"),
    ("a.py", "from flask import Flask\n@app.route('/a')\n", "flask", "ANY /a"), ("a.py", "import fastapi\n@app.get('/b')\n", "fastapi", "GET /b"), ("u.py", "import django\npath('a/', views.a)\n", "django", "views.a"), ("m.py", "class M(models.Model):\n    x = models.CharField()\n", "django-orm", "M"), ("m.py", "import sqlalchemy\nclass U(Base):\n    id = Column(Integer)\n", "sqlalchemy", "U"),
    ("A.java", 'import org.springframework.x;\n@GetMapping("/a")\n', "spring-boot", "GET /a"), ("A.kt", 'import org.springframework.x\n@PostMapping("/a")\n', "spring-kotlin", "POST /a"), ("A.java", 'import io.micronaut.x;\n@Get("/y") String y() {}\n', "micronaut", "GET /y"), ("A.java", 'import jakarta.ws.rs.GET;\n@GET\n@Path("/x")\n', "quarkus", "GET /x"), ("E.java", "import jakarta.persistence.*;\n@Entity\npublic class E {}\n", "hibernate", "E"),
    ("k.kt", 'import io.ktor.x\nget("/a") {}\n', "ktor", "GET /a"), ("c.kt", "import androidx.x\n@Composable\nfun Home() {}\n", "android", "Home"), ("f.dart", "import 'package:flutter/m.dart';\nclass A extends StatelessWidget {}\n", "flutter", "A"), ("r.php", "use Illuminate\\X;\nRoute::get('/a', f);\n", "laravel", "GET /a"), ("s.php", "use Symfony\\X;\n#[Route('/a', methods: ['GET'])]\n", "symfony", "GET /a"),
    ("routes.rb", "Rails.x do\n  get '/a'\nend\n", "rails", "GET /a"), ("s.rb", "require 'sinatra'\nget '/a' do\n", "sinatra", "GET /a"), ("g.go", 'import "github.com/gin-gonic/gin"\nr.GET("/a", h)\n', "gin", "GET /a"), ("g.go", 'import "github.com/labstack/echo"\ne.POST("/a", h)\n', "echo", "POST /a"), ("g.go", 'import "github.com/gofiber/fiber"\napp.Get("/a", h)\n', "fiber", "GET /a"),
    ("a.rs", 'use actix_web::get;\n#[get("/a")]\n', "actix-web", "GET /a"), ("a.rs", 'use axum::Router;\nr.route("/a", get(h))\n', "axum", "GET /a"), ("a.rs", 'use rocket::x;\n#[post("/a")]\n', "rocket", "POST /a"), ("v.swift", 'import Vapor\napp.get("a") {}\n', "vapor", "GET a"),
]


@pytest.mark.parametrize(("path", "text", "framework", "name"), FRAMEWORKS)
def test_adapters(path, text, framework, name):
    assert (name, framework) in {(d.name, d.meta["framework"]) for d in Adapters().extract(path, text)}


def test_every_adapter_is_tested():
    assert {a.name for a in ADAPTERS} == {f for _, _, f, _ in FRAMEWORKS}


def test_complexity():
    m = measure("function f(a, b) {\n  if (a && b) { // if\n    for (;;) { g('if'); }\n  } else if (b) { return 1 }\n  return a ? 1 : 2;\n}")
    assert m == (6, 6, 5, 2, 2, 2)
    p = measure("def f(self, a, *b, c=1):\n    if a:\n        for x in b:\n            if x and c:\n                return 1\n    return 2\n")
    assert p.cyclomatic_complexity == 5 and p.param_count == 3 and p.return_count == 2 and p.nesting_depth == 3
    assert measure("") == (0, 1, 0, 0, 0, 0)


RESOLVED = [
    ("src/a.ts", "./b", ["src/b.ts"]), ("src/a.ts", "./b.js", ["src/b.ts"]), ("src/x/a.ts", "../b", ["src/b.ts"]), ("src/a.ts", "./lib", ["src/lib/index.ts"]), ("src/a.ts", "@/b", ["src/b.ts"]), ("src/a.ts", "@acme/core", ["packages/core/src/index.ts"]), ("src/a.ts", "@acme/core/util", ["packages/core/src/util.ts"]), ("src/a.ts", "react", []),
    ("app/m.py", ".n", ["app/n.py"]), ("app/s/m.py", "..n", ["app/n.py"]), ("x.py", "app.n", ["app/n.py"]), ("x.py", "app", ["app/__init__.py"]), ("x.py", "app.n.name", ["app/n.py"]), ("A.java", "a.b.C", ["j/C.java"]), ("A.java", "a.b.C.inner", ["j/C.java"]), ("A.java", "a.b.*", ["j/C.java", "j/D.java"]), ("m.go", "host.x/mod/pkg/u", ["pkg/u/a.go", "pkg/u/b.go"]),
    ("src/main.rs", "crate::net::tcp::Conn", ["src/net/tcp.rs"]), ("src/net/mod.rs", "tcp", ["src/net/tcp.rs"]), ("src/net/udp.rs", "super::tcp", ["src/net/tcp.rs"]), ("i.php", "App\\Models\\User", ["app/Models/User.php"]), ("lib/a.dart", "package:me/b.dart", ["lib/b.dart"]), ("lib/a.ex", "My.App.Repo", ["lib/my/app/repo.ex"]), ("src/a.erl", "x.hrl", ["include/x.hrl"]),
    ("src/a.f90", "numbers", ["src/numbers.f90"]), ("app/Main.hs", "Data.Tree", ["src/Data/Tree.hs"]), ("x.rb", "my/thing", ["lib/my/thing.rb"]), ("x.rb", "./y", ["y.rb"]), ("Sources/App/a.swift", "Core", ["Sources/Core/c.swift"]), ("s/a.scss", "vars", ["s/_vars.scss"]), ("c/a.c", "x.h", ["include/x.h"]),
]


@pytest.fixture(scope="module")
def tree(spark):
    paths = sorted({p for _, _, ts in RESOLVED for p in ts} | {s for s, _, _ in RESOLVED})
    package = {"j/C.java": "a.b", "j/D.java": "a.b"}
    content = {"packages/core/package.json": '{"name": "@acme/core", "main": "src/index.ts"}', "pubspec.yaml": "name: me\n"}
    return files(spark, [(p, "", package.get(p)) for p in paths] + [(p, t) for p, t in content.items()])


def test_resolvers(spark, tree):
    records = spark.createDataFrame([("r", s, x) for s, x, _ in RESOLVED] + [("r", None, "x"), (None, "a.ts", "./b"), ("r", "a.ts", None)], "repo_id string, source string, specifier string")
    got = {}
    for r in rs.resolve(records, tree).collect():
        got.setdefault((r.source, r.specifier), []).append(r.target)
    assert {k: sorted(v) for k, v in got.items()} == {(s, x): t for s, x, t in RESOLVED if t}
    given = spark.createDataFrame([("r", "src/a.ts", "zzz", "src/b.ts"), ("r", "src/a.ts", "yyy", "gone.ts")], "repo_id string, source string, specifier string, resolved_path string")
    assert [(r.specifier, r.target) for r in rs.resolve(given, tree).collect()] == [("zzz", "src/b.ts")]


def test_edges_and_refs(spark):
    f = files(spark, [
        ("src/a.ts", "import { Store } from './b';\nimport { helper } from './barrel';\nexport function go(): void {\n  const s = new Store();\n  helper(s); helper(s);\n}\nfunction local() {}\nlocal();\n"),
        ("src/b.ts", "export class Store {}\nexport function other() {}\n"), ("src/barrel.ts", "export { helper } from './c';\n"), ("src/c.ts", "export function helper(x: any) {}\n"),
        ("src/svc.ts", "@Injectable()\nexport class Mailer {}\n"), ("src/ctl.ts", "import x from './b';\nexport class Ctl {\n  constructor(private readonly m: Mailer) {\n  }\n}\n"), ("src/self.ts", "import './self';\n"), ("n.ts", None),
    ])
    r = px.process(f)
    res = rs.resolve(px.imports(r), f)
    assert rows(eg.file_edges(res)) == [("r", "src/a.ts", "src/b.ts", "./b", "import"), ("r", "src/a.ts", "src/barrel.ts", "./barrel", "import"), ("r", "src/barrel.ts", "src/c.ts", "./c", "re-export"), ("r", "src/ctl.ts", "src/b.ts", "./b", "import")]
    assert [tuple(x)[1:4] for x in eg.injected_edges(r).collect()] == [("src/ctl.ts", "src/svc.ts", "Mailer")]
    sym = px.symbols(r)
    name = {x.id: x.name for x in sym.collect()}
    refs = {(x.source_file, name.get(x.source_symbol), name[x.target_symbol], x.confidence): x.ref_count for x in eg.symbol_refs(px.name_uses(r), res, sym).collect()}
    assert refs[("src/a.ts", "go", "Store", "named")] == 1 and refs[("src/a.ts", "go", "helper", "named")] == 2
    assert not any(t == "local" for _, _, t, _ in refs)
    dead = {x.file_path for x in eg.dead_symbols(sym, eg.file_edges(res)).collect()}
    assert "src/b.ts" not in dead and "src/a.ts" in dead
    assert eg.symbol_refs(px.name_uses(r.limit(0)), res, sym).collect() == []


def test_links(spark):
    r = spark.createDataFrame([("1", "/w/a"), ("2", "/w/b/"), ("3", "/w/a/sub"), ("4", "/x")], "id string, root_path string")
    assert rows(eg.links(r)) == [("1", "2", "sibling", 2), ("1", "3", "nested", 1), ("2", "1", "sibling", 1), ("3", "1", "parent", 1)]
    back = {tuple(x) for x in eg.reverse_links(eg.links(r)).collect()}
    assert ("3", "1", "parent") in back and ("1", "3", "nested") in back


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("motoring", "motor"), ("hopping", "hop"), ("relational", "relat"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("rate", "rate"), ("controll", "control"), ("sky", "sky"), ("filing", "file")])
def test_porter(word, stem):
    assert ss.porter(word) == stem


@pytest.mark.parametrize("stemmer", ["porter", "light"])
def test_search_ranks_the_named_first(spark, stemmer):
    data = [("1", "loadUserConfig", "function", "src/config.ts", "function loadUserConfig(path)", "Reads settings."), ("2", "UserStore", "class", "src/store.ts", "class UserStore", None), ("3", "saveConfig", "function", "src/config.ts", None, "Writes the configuration of a user."), ("4", "render", "function", "src/view.ts", "function render()", ""), ("5", "loadUserConfig", "function", "vendor/x/config.ts", "function loadUserConfig()", None)]
    s = spark.createDataFrame(data, "id string, name string, kind string, file_path string, signature string, summary string")
    t = ss.content(s)
    got = ss.search(s, ss.postings(t, stemmer), ss.statistics(t), "load the user config", 3, stemmer).orderBy("rank").collect()
    assert [r.id for r in got][:2] == ["1", "5"] and len(got) == 3
    assert ss.search(s, ss.postings(t, stemmer), ss.statistics(t), "", 3, stemmer).collect() == []
    assert ss.search(s, ss.postings(t, stemmer), ss.statistics(t), "zzz qqq", 3, stemmer).collect() == []


def test_globs():
    import re

    for glob, path, want in [("src/**/*.ts", "src/a.ts", True), ("src/**/*.ts", "src/a/b.ts", True), ("src/*.ts", "src/a/b.ts", False), ("*.{js,ts}", "a.ts", True), ("a?.py", "ab.py", True), ("**", "x/y", True), ("a.b", "axb", False)]:
        assert bool(re.match(safety.glob_pattern(glob), path)) is want, (glob, path)


def test_components_of_chain_and_ring(spark):
    es = [(i, i + 1) for i in range(40)] + [(40, 20), (50, 51)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(es, "src int, dst int")).collect()}
    assert {n for n, c in got.items() if c == 20} == set(range(20, 41)) and got[50] == 50 and len(set(got.values())) == 23


def test_v8(spark):
    report = '{"result": [{"url": "file:///a.js", "functions": [{"functionName": "go", "ranges": [{"startOffset": 1, "endOffset": 9, "count": 3}]}, {"functionName": "", "ranges": [{"startOffset": 0, "endOffset": 99, "count": 1}]}]}]}'
    assert rows(formats.v8(spark.createDataFrame([(report,), (None,), ("{",)], "report string"))) == [("/a.js", "go", 1, 9, 3)]


def test_library(spark, tmp_path):
    root, index = tmp_path / "repo", str(tmp_path / "index")
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.ts").write_text("import { b } from './b';\nexport function a() { b(); }\n")
    (root / "src" / "b.ts").write_text("export function b() {}\n")
    (root / "server.pem").write_text("x")
    counts = api.index_folder(spark, str(root), index)
    assert counts["files"] == 2 and counts["symbols"] == 2 and counts["edges"] == 1 and counts["refs"] == 2 and counts["dropped_secret"] == 1
    me = api.repo_id_of(spark, str(root))
    change = spark.createDataFrame([(me, "src/b.ts", None, None), (me, "src/c.ts", b"import { a } from './a';\nexport class C {}\n", "h")], "repo_id string, path string, raw_content binary, content_hash string")
    api.reindex_files(spark, index, change)
    assert rows(api.table(spark, index, "edges").select("src", "dst")) == [("src/c.ts", "src/a.ts")]
    assert rows(api.list_repos(spark, index)) == [(me, 2, 2)]
    assert api.delete_index(spark, index, me)["files"] == 2
    api.delete_index(spark, index, me, dry_run=False)
    spark.catalog.clearCache()
    assert spark.read.schema("path string, repo_id string").parquet(f"{index}/files").filter(f"repo_id = '{me}'").count() == 0


def test_syntax_nodes(spark):
    from graphloom.operators import code

    f = files(spark, [("a.py", "def f():\n    assert x, \\\n        'm'\n"), ("b.py", "assert ("), ("c.js", "assert x"), ("n.py", None)])
    assert rows(code.syntax_nodes(f, "Assert")) == [("r", "a.py", 2, 3, "assert x, \\ 'm'")]
