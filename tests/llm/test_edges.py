"""Nulls in any column, empty tables, repeated rows, ties, long texts and clashing extra columns, per operator."""

import itertools

import numpy as np
import pytest

from graphloom.llm import cooccur, credentials, docpairs, encode, handwritten, mix, parses, quality, split, vectorgraph

FILES = "repo_id string, path string, content_hash string, raw_content binary, declared_package string, indexed_at bigint"
SYMBOLS = "id string, repo_id string, name string, kind string, file_path string, start_byte int, end_byte int, signature string, summary string"
EXTRA = ["b", "g", "n", "k", "leaf", "hash", "node", "pairs", "windows", "lang", "test", "block", "word", "words", "ids", "row", "counts", "shard", "home", "v", "salt", "bytes", "range_no", "at", "fid", "score"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def clash(df):
    """df with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    for c in EXTRA:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


def file_rows(spark, items):
    return clash(spark.createDataFrame([(r, p, "h", c, None, i) for i, (r, p, c) in enumerate(items)], FILES))


@pytest.fixture(scope="module")
def odd_files(spark):
    good, bad = b"x = 1\n", b"def f(:\n"
    return file_rows(
        spark,
        [("r", "a.py", good), ("r", "b.py", bad), ("r", "b.py", bad), ("r", "n.py", None), (None, "c.py", bad), ("r", None, bad), (None, None, None), ("r", "e.py", b""), ("r", "x.py", b"\xff\xfe\x00"),
         ("r", "l.py", b"y = [" + b"1, " * 60_000 + b"]\n"), ("r", "noext", b"key")],
    )


def test_parse_edges(spark, odd_files):
    assert rows(parses.found(odd_files)) == sorted([("r", "b.py"), (None, "c.py"), ("r", "x.py")], key=repr)
    assert rows(parses.found(odd_files.limit(0))) == []
    rate = {(r.repo_id, r.lang): (r.files, r.broken) for r in parses.rates(odd_files.filter("repo_id is not null")).collect()}
    assert rate == {("r", "py"): (5, 2)}


def test_handwritten_edges(spark, odd_files):
    assert rows(handwritten.found(odd_files.limit(0))) == []
    out = handwritten.classify(odd_files).collect()
    assert len({(r.repo_id, r.path) for r in out}) == len(out)
    assert ("r", "l.py") in {(r.repo_id, r.path) for r in out if r.reason == "data"}


def _module(name, n=12):
    return "".join(f"def {name}_{i}(first, second):\n    return first * {i} + second\n" for i in range(n)).encode()


def test_related_repositories_hold_no_copies_of_each_other(spark):
    own = [(r, f"src/m{i}.py", _module(f"m{i}")) for r in ("one", "two") for i in range(9)] + [("one", "src/last.py", _module("x")), ("two", "src/last.py", _module("y"))]
    deep = "/".join(f"d{i}" for i in range(20))
    lib = [("third", f"{deep}/{n}.py", _module(n)) for n in ("lib", "more")] + [("fourth", f"other/{n}2.py", _module(n)) for n in ("lib", "more")]
    alone = [(r, f"a{i}.py", _module(f"{r}{i}")) for r in ("third", "fourth") for i in range(5)]
    out = {(r.repo_id, r.path): r.reason for r in handwritten.classify(file_rows(spark, own + lib + alone)).collect()}
    assert {k for k, v in out.items() if v} == {(r, p) for r, p, _ in lib}
    forks = [(f"f{i}", f"m{j}.py", _module(f"m{j}")) for i in range(5) for j in range(8)] + [(f"f{i}", "own.py", _module(f"own{i}")) for i in range(5)]
    family = {r.repo_id: r.family for r in handwritten.families(handwritten.leaves(file_rows(spark, forks + lib)), 120).collect()}
    assert {family[f"f{i}"] for i in range(5)} == {"f0"} and family["third"] in ("third", "fourth")


def test_credentials_edges(spark):
    key = "AKIA" + "Q3ZX7PLM2KJH8WRT"
    text = f'a = 1\r\nkey = "{key}"\n'.encode()
    f = file_rows(spark, [("r", "a.py", text), ("r", "a.py", text), ("r", "n.py", None), (None, None, None), ("r", "e.py", b""), ("r", "l.py", b"z" * 300_000 + b'\ntoken = "' + key.encode() + b'"'), ("r", "x.py", b"\xff token = '" + key.encode() + b"'")])
    assert rows(credentials.find(f)) == [("r", "a.py", 2), ("r", "l.py", 2), ("r", "x.py", 1)]
    assert rows(credentials.find(f.limit(0))) == []
    red = {(r.path, r.redactions): r.raw_content for r in credentials.redact(f).collect()}
    got = bytes(red[("a.py", 1)])
    assert len(got) == len(text) and key.encode() not in got and got.startswith(b"a = 1\r\nkey = \"")
    assert red[("n.py", 0)] is None and bytes(red[("e.py", 0)]) == b""
    assert bytes(red[("x.py", 1)])[0] == 0xFF
    assert rows(credentials.find(credentials.redact(f))) == []


def test_vector_edges(spark):
    schema = "symbol_id string, repo_id string, embedding array<float>, dimension int, provider string"
    data = [("a", "r", [1.0, 0.0], 2, "p"), ("a", "r", [1.0, 0.0], 2, "p"), ("b", "r", [2.0, 0.1], 2, "p"), ("c", "r", [5.0, 0.1], 2, "q"), ("d", "r", None, 2, "p"), ("e", "r", [], 0, "p"), ("f", "r", [1.0], 2, "p"),
            ("g", "r", [0.0, 0.0], 2, "p"), ("h", "r", [float("nan"), 1.0], 2, "p"), ("i", "r", [None, 1.0], 2, "p"), (None, "r", [1.0, 0.0], 2, "p"), ("j", "r", [1.0, 0.0], 2, None), ("k", None, [1.0, 0.0], None, "p"), ("l", "r", [-1.0, 0.0], 2, "p")]
    v = clash(spark.createDataFrame(data, schema).withColumnRenamed("repo_id", "id"))
    assert rows(vectorgraph.found(v)) == [("a", "b")]
    assert rows(vectorgraph.found(v.limit(0))) == []


def test_neighbours_recall_with_many_shards(spark):
    rng = np.random.default_rng(2)
    x = np.tanh(rng.standard_normal((3000, 10)) @ rng.standard_normal((10, 32))) + 0.05 * rng.standard_normal((3000, 32))
    v = spark.createDataFrame([(f"{i:05d}", "r", list(map(float, e)), 32, "p") for i, e in enumerate(x)], "symbol_id string, repo_id string, embedding array<float>, dimension int, provider string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(f"{i:05d}", f"{j:05d}") for i, row in enumerate(np.argsort(-s, 1)[:, :5]) for j in row}
    got = {(r.id, r.neighbour) for r in vectorgraph.neighbours(v, shard_rows=10).collect()}
    assert len(got & want) / len(want) >= 0.98  # six visits reach 0.962 at most
    # a tree of centroids of three levels: cells are divided by samples of their own
    deep = vectorgraph.neighbours(v, shard_rows=20, fan=6, sample=400).collect()
    assert len({(r.id, r.neighbour) for r in deep} & want) / len(want) >= 0.9
    assert len({(r.id, r["rank"]) for r in deep}) == len(deep) == 15_000


def test_equal_vectors_pair_by_smallest_id(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16))
    x[50:150] = x[7]
    x[200:203] = x[9]
    v = spark.createDataFrame([(f"{i:05d}", "r", list(map(float, e)), 16, "p") for i, e in enumerate(x)], "symbol_id string, repo_id string, embedding array<float>, dimension int, provider string")
    first = ["00007", *(f"{i:05d}" for i in range(50, 55))]
    few = ["00009", "00200", "00201", "00202"]
    want = {p for g in (first, few) for p in itertools.combinations(g, 2)}
    near = {}
    for r in vectorgraph.neighbours(v, shard_rows=40).collect():
        near.setdefault(r.id, {})[r.rank] = r.neighbour
    assert len(near) == 300 and all(sorted(n) == [1, 2, 3, 4, 5] and len(set(n.values())) == 5 and i not in n.values() for i, n in near.items())
    assert list(map(near["00120"].get, range(1, 6))) == first[:5] and list(map(near["00050"].get, range(1, 6))) == [i for i in first if i != "00050"]
    assert set(rows(vectorgraph.found(v, min_similarity=0.999))) == want


def test_docpair_edges(spark):
    data = [("1", "r", "f", "function", "a.py", 0, 9, "def f(x)", "Drops rows that nobody reads."), ("1", "r", "f", "function", "a.py", 0, 9, "def f(x)", "Drops rows that nobody reads."), ("2", "r", "g", "method", "a.py", 0, 9, None, "Drops rows that nobody reads."),
            ("3", "r", "g", "method", "a.py", 0, 9, " ", "Drops rows that nobody reads."), ("4", "r", "g", "method", "a.py", 0, 9, "g()", None), ("5", "r", "g", "method", "a.py", 0, 9, "g()", "  "), (None, "r", "g", "method", "a.py", 0, 9, "g()", "Drops rows that nobody reads."),
            ("6", "r", None, "function", None, None, None, "g()", "Drops rows that nobody reads."), ("7", "r", "K", "class", "a.py", 0, 9, "class K", "Drops rows that nobody reads."), ("8", None, "h", "function", "a.py", 5, 9, "h()", "Keeps order stable. " * 20_000), ("9", "r", "h", None, "a.py", 5, 9, "h()", "Keeps order.")]
    s = clash(spark.createDataFrame(data, SYMBOLS))
    assert rows(docpairs.found(s)) == [("1",), ("6",), ("8",)]
    assert rows(docpairs.found(s.limit(0))) == []


def test_assignment_runs_to_the_end(spark):
    """Stray comments that contend for overloads are all settled, and no function loses its own comment for nothing."""
    stray = "mergeRows keeps the order of whatever arrives late.\n@param left the side that wins"
    data = [(f"o{i}", "r", "mergeRows", "function", "a.py", 100 * i, 9, "mergeRows(left, right)", None) for i in range(6)]
    data += [(f"s{i}", "r", f"other{i}", "function", "a.py", 100 * i + 7, 9, f"other{i}(x)", stray) for i in range(6)]
    data += [("z", "r", "plain", "function", "a.py", 5, 9, "plain(x)", "Drops rows that nobody reads.")]
    s = spark.createDataFrame(data, SYMBOLS)
    got = docpairs.pairs(s).collect()
    assert len({r.id for r in got}) == len(got) and {"z"} < {r.id for r in got}
    # each of the six stray comments has its own function or an overload, no comment is used twice
    assert len(got) == 7 and all(r.description for r in got)
    assert {r.id for r in docpairs.found(s).collect()} == {r.id for r in got}


def test_split_edges(spark):
    body = ("é" * 10 + " word;\n").encode() * 400
    f = file_rows(spark, [("r", "a.py", body), ("r", "a.py", body), ("r", "n.py", None), (None, None, body)])
    data = [("1", "r", "f", "function", "a.py", 0, 4995, None, None), ("1", "r", "f", "function", "a.py", 0, 4995, None, None), ("2", "r", "f", "function", "a.py", 5000, 10, None, None), ("3", "r", "f", "function", "a.py", None, 10, None, None), ("4", "r", "f", "function", "a.py", 0, 10**7, None, None),
            ("5", "r", "f", "function", "n.py", 0, 5000, None, None), ("6", "r", "f", "function", "a.py", -5, 5000, None, None), ("7", "r", "f", "function", "a.py", 100, 2100, None, None), ("8", "r", "f", "function", "gone.py", 0, 5000, None, None), ("9", None, None, None, None, 0, 5000, None, None)]
    s = clash(spark.createDataFrame(data, SYMBOLS))
    assert rows(split.found(s, f)) == [("1",)]
    got = sorted(split.pieces(s, f).collect(), key=lambda r: r.piece_no)
    assert got[0].start_byte == 0 and got[-1].end_byte == 4995
    for a, b in itertools.pairwise(got):
        assert 200 <= a.end_byte - b.start_byte <= 203
    for r in got:
        assert r.end_byte - r.start_byte <= 2000
        body[r.start_byte : r.end_byte].decode()
    assert rows(split.found(s.limit(0), f)) == [] and rows(split.found(s, f.limit(0))) == []
    out = {r.piece_no: bytes(r.content) for r in split.emit(s, f).collect()}
    assert out == {r.piece_no: body[r.start_byte : r.end_byte] for r in got}


def test_split_spans_ranges(spark):
    """An item over several byte ranges, without any natural boundary and with four-byte characters."""
    body = "🚧".encode() * 40_000
    f = file_rows(spark, [("r", "a.py", body)])
    s = spark.createDataFrame([("1", "r", "f", "function", "a.py", 0, len(body), None, None)], SYMBOLS)
    got = sorted(split.pieces(s, f).collect(), key=lambda r: r.piece_no)
    assert [r.piece_no for r in got] == list(range(len(got)))
    for a, b in itertools.pairwise(got):
        assert 200 <= a.end_byte - b.start_byte <= 203
    for r in got:
        body[r.start_byte : r.end_byte].decode()
    assert got[-1].end_byte == len(body)


def test_split_shuffles_no_contents(spark):
    f = file_rows(spark, [("r", "a.py", b"x = 1\n" * 900)])
    s = spark.createDataFrame([("1", "r", "f", "function", "a.py", 0, 5000, None, None)], SYMBOLS)
    for line in split.pieces(s, f)._jdf.queryExecution().optimizedPlan().toString().splitlines():
        if "Repartition" in line or "Join" in line:
            assert "raw_content" not in line
    plan = split.pieces(s, f)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2  # one of tables and items, one that takes repeated items together


@pytest.mark.parametrize("n", [0, 5, 5000, 30_000])
def test_packed_places(n):
    rng = np.random.default_rng(n)
    places = np.sort(rng.choice(split.RANGE, n, replace=False)).astype(np.int32) + 3 * split.RANGE + 1
    assert (split.unpacked(split.packed(places, 3 * split.RANGE), 3 * split.RANGE) == places).all()


def test_split_ends_at_lines(spark):
    """A piece ends in mid-line only if no line end beyond the overlap lies within its 2,000 bytes."""
    rng = np.random.default_rng(5)
    lines = [("a" * 9 + " ") * int(n) for n in rng.choice([1, 3, 6, 90, 130, 170, 250], 900)]
    body = "\n".join(lines).encode() + b"\n" + "é; ".encode() * 3000 + b"\r\n" * 2500 + "🚧".encode() * 3000
    f = file_rows(spark, [("r", "a.py", body), ("r", "a.py", body)])
    data = [("1", 0, len(body)), ("2", 12345, 200_000), ("3", 65_000, 67_500), ("4", 64_000, 131_100)]
    s = spark.createDataFrame([(i, "r", "f", "function", "a.py", a, b, None, None) for i, a, b in data], SYMBOLS)
    got = split.pieces(s, f).collect()
    for i, start, end in data:
        mine = sorted((r for r in got if r.id == i), key=lambda r: r.piece_no)
        assert [r.piece_no for r in mine] == list(range(len(mine))) and mine[0].start_byte == start and mine[-1].end_byte == end
        for a, b in itertools.pairwise(mine):
            assert 200 <= a.end_byte - b.start_byte <= 203
            part = body[a.start_byte : a.start_byte + 2000]
            assert a.end_byte - a.start_byte <= 2000 and body[a.end_byte - 1 : a.end_byte + 1] != b"\r\n"
            if b"\n" in part[203:]:
                assert part[a.end_byte - a.start_byte - 1] == 10, (i, a)
            elif b" " in part[203:]:
                assert part[a.end_byte - a.start_byte - 1] == 32, (i, a)
            body[a.end_byte : a.end_byte + 4].decode("utf-8", "ignore")
            assert body[a.end_byte] & 0xC0 != 0x80 and body[b.start_byte] & 0xC0 != 0x80


def test_cooccur_edges(spark):
    schema = "repo_id string, commit_sha string, file_path string, commit_date bigint"
    data = [("r", f"s{i}", p, None) for i in range(6) for p in ("a", "./b")] + [("r", "s1", "a", 5), ("r", "s1", None, 5), (None, "s", "a", 1), ("r", None, "a", 1)] + [("r", f"t{i}", "c", 1) for i in range(30)] + [("r", "big", f"f{i}", 1) for i in range(50)] + [("r", "big", "a", 1), ("r", "big", "b", 1)]
    c = clash(spark.createDataFrame(data, schema))
    assert rows(cooccur.found(c)) == [("r", "a", "b")]
    one = cooccur.cooccurrence(c).collect()[0]
    assert (one.support, one.n_a, one.n_b, one.n) == (6, 7, 7, 37)
    assert rows(cooccur.found(c.limit(0))) == []


def test_encode_edges(spark):
    data = [(1, "a a a"), (2, None), (3, ""), (4, "  \r\n\t "), (5, "x" * 30_000), (5, "x" * 30_000), (None, "b"), (7, "naïve 漢字 🚧 ab" * 2000), (8, "a1b2 don't I'LL")]
    d = clash(spark.createDataFrame(data, "doc_id bigint, text string"))
    out = encode.encode(d).collect()
    assert len(out) == len(data)
    by = {r.doc_id: r.ids for r in out}
    assert by[2] == [] and by[3] == []
    back = {r.doc_id: r.text for r in encode.decode(encode.encode(d)).collect()}
    for i, t in data:
        assert back[i] == (t or "")
    assert encode.encode(d.limit(0)).collect() == []


def test_encode_against_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = np.random.default_rng(1)
    alphabet = list("abcdefghij XYZ0123'\n\t.,;-_=<>|äß漢 🚧 ")
    texts = ["".join(rng.choice(alphabet, n)) for n in rng.integers(0, 400, 60)] + ["<|endoftext|>", "=" * 500, "ha" * 400]
    got = {r.doc_id: r.ids for r in encode.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    want = {i: t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert got == want
    # blocks of any size give the same ids and counts, also of repeated rows
    many = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] * 3, "doc_id int, text string").repartition(3)
    small = encode.encode(many, block_bytes=100).collect()
    assert len(small) == 3 * len(texts) and {r.doc_id: r.ids for r in small} == want
    assert sorted(map(tuple, encode.token_counts(many, ["doc_id"], block_bytes=100).collect())) == sorted((i, len(want[i])) for i in want for _ in range(3))


def test_mix_misses_a_source_by_a_document_at_most(spark):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, "word " * int(n), f"s{i % 4}") for i, n in enumerate(rng.integers(1, 60, 400))], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("s0", 0.4, 2), ("s1", 0.3, 2), ("s2", 0.2, 3), ("s3", 0.1, 1)], "source string, target_share double, max_repeats int")
    copies, plan = mix.mix(docs, targets, rows_per_group=16)
    got = {r.source: r for r in mix.report(copies, plan).collect()}
    largest = {r.source: r.m for r in mix.sizes(docs).groupBy("source").agg({"tokens": "max"}).withColumnRenamed("max(tokens)", "m").collect()}
    for r in plan.collect():
        assert abs(got[r.source].tokens - r.rate * r.supply) <= largest[r.source] + 1e-6


def test_mix_edges(spark):
    data = [(i, "word " * (i % 7 + 1), s) for i, s in enumerate([" A", "a", "b", "B", "c", None] * 40)] + [(999, None, "a"), (1000, "", "b"), (None, "text here", "a"), (5, "dup", "a"), (5, "dup", "a")]
    docs = clash(spark.createDataFrame(data, "doc_id bigint, text string, source string"))
    targets = clash(spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1), ("none", 0.1, 3), ("zero", None, None)], "source string, target_share double, max_repeats int"))
    copies, plan = mix.mix(docs, targets)
    rep = {r.source: r for r in mix.report(copies, plan).collect()}
    assert abs(rep["a"].actual_share - 0.5) < 0.03 and rep["a"].most_copies <= 2 and rep["b"].most_copies <= 1
    assert rep["none"].tokens == 0 and set(rep) == {"a", "b", "none", "zero"}
    assert mix.mix(docs.limit(0), targets)[0].collect() == []


def test_pivot_keeps_tokens():
    group = [(i, 3 + i % 5, 0.3) for i in range(200)]
    out = mix.pivot(group, 1)
    assert sorted(i for i, _ in out) == list(range(200))
    assert sum(0 < f < 1 for _, f in out) <= 1
    assert abs(sum(group[i][1] * f for i, f in out) - sum(w * f for _, w, f in group)) < 1e-6


def test_quality_edges(spark):
    common = clash(spark.createDataFrame([("en", "the"), ("en", "is"), ("en", "of"), (None, None)], "lang string, word string"))
    prose = "The order of the rows is part of the contract. It is kept by the writer of the table."
    table = "\n".join("| 12 | 7 | 9.5 |" for _ in range(40))
    docs = clash(spark.createDataFrame([(1, prose), (2, table), (3, None), (4, ""), (5, " \r\n "), (2, table), (None, prose), (6, table * 2000), (7, (prose + "\r\n") * 3000)], "doc_id bigint, text string"))
    out = quality.statistics(docs, common).collect()
    assert len(out) == 9
    by = {r.doc_id: r for r in out}
    assert by[1].is_prose and not by[2].is_prose and by[3].word_count is None and by[4].word_count == 0 and by[4].is_prose is None and by[5].is_prose is None
    assert not by[6].is_prose and by[7].is_prose
    assert rows(quality.found(docs, common)) == [(2,), (6,)]
    assert rows(quality.found(docs.limit(0), common)) == []


def _prosaic():
    lines = ["The order of the rows is kept by the writer of the table and", "goes on here", "a | b | c", "", "x" * 900, "The end of it is near.", "short line", "which is the rest of the sentence.", "{;}"]
    return "\r\n".join(lines[i * j % len(lines)] for i in range(40) for j in (1, 2, 4, 5))


def test_quality_chunks_equal_whole():
    """Chunks of any size, joined in any grouping, give the same counts as the whole text."""
    common = frozenset(["the", "is", "of", "by", "and"])
    text = _prosaic()
    whole = quality.text_counts(text, common)
    assert 0 < whole[quality.COUNTS.index("prose_chars")] < whole[quality.SOLID]
    flat = text.replace("\r\n", "\n")
    for size in (1, 7, 64, 701, 4096):
        states = [quality.boundary_state(flat[i : i + size], common) for i in range(0, len(flat), size)]
        for fan in (2, 64, len(states)):
            level = states
            while len(level) > 1:
                level = [quality.join_states(level[i : i + fan], common) for i in range(0, len(level), fan)]
            assert quality.closed(level[0], common) == whole, (size, fan)


def test_quality_chunk_path(spark, monkeypatch):
    """The plan over chunks and a merge tree of several levels gives the rows of the plan over whole documents."""
    common = spark.createDataFrame([("en", w) for w in ("the", "is", "of", "by", "and")], "lang string, word string")
    docs = spark.createDataFrame([(1, _prosaic()), (2, "\r" * 50 + "word"), (3, "z" * 5000), (4, "The\r\nend of it is near. " * 300), (5, None), (6, "")], "doc_id bigint, text string")
    want = rows(quality.statistics(docs, common))
    monkeypatch.setattr(quality, "CHUNK", 50)
    monkeypatch.setattr(quality, "RUN", 16)
    assert rows(quality.statistics(docs, common)) == want
