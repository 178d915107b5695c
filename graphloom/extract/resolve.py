"""Import resolution by families: a record's specifier gives ordered keys, files answer to keys, the first that is met holds.

Both sides are small rows made by a map; one equi-join on (repo_id, key) replaces the resolvers' probes.  A key may be
answered by several files (a Go package, a wildcard import, a Swift module): all of them are targets.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.tables import spread

SCRIPT_ENDS = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".json", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
ROOTS = ("", "src/", "lib/", "app/")


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def _near(source: str, spec: str) -> str:
    return posixpath.normpath(posixpath.join(posixpath.dirname(source), spec))


def scripts(source: str, spec: str) -> list[str]:
    if spec.startswith("."):
        base = _near(source, spec)
        stem = re.sub(r"\.(?:js|mjs|cjs|jsx)$", "", base)
        ends = [base + e for e in SCRIPT_ENDS]
        return [*ends[:1], *([stem + ".ts", stem + ".tsx"] if stem != base else []), *ends[1:]]
    if spec.startswith(("@/", "~/", "#/")):
        return [r + spec[2:] + e for r in ("src/", "", "app/") for e in SCRIPT_ENDS]
    parts = spec.split("/")
    name, rest = ("/".join(parts[:2]), "/".join(parts[2:])) if spec.startswith("@") else (parts[0], "/".join(parts[1:]))
    return [f"pkg:{name}|{rest}{e}" for e in (SCRIPT_ENDS if rest else ("",))] + [f"pkg:{name}|src/{rest}{e}" for e in (SCRIPT_ENDS if rest else ())] + [spec + e for e in SCRIPT_ENDS[1:]]


def python(source: str, spec: str) -> list[str]:
    if spec.startswith("."):
        level = len(spec) - len(spec.lstrip("."))
        base = posixpath.dirname(source)
        for _ in range(level - 1):
            base = posixpath.dirname(base)
        path = posixpath.join(base, *filter(None, spec.lstrip(".").split("."))) if spec.strip(".") else base
        return [f"{path}.py", posixpath.join(path, "__init__.py")]
    parts = spec.split(".")
    out = []
    for n in range(len(parts), 0, -1):  # the last parts may be names in the module
        out += ["py:" + ".".join(parts[:n])]
    return [posixpath.join(posixpath.dirname(source), *parts) + ".py", *out] if len(parts) == 1 else out


def jvm(source: str, spec: str) -> list[str]:
    spec = re.sub(r"\{.*", "*", spec.strip()).replace("._", ".*")
    if spec.endswith(".*"):
        return ["jvmpkg:" + spec[:-2], "jvm:" + spec[:-2]]
    parts = spec.split(".")
    return ["jvm:" + ".".join(parts[:n]) for n in range(len(parts), 1, -1)]


def go(source: str, spec: str) -> list[str]:
    if spec.startswith("."):
        return ["go:" + _near(source, spec)]
    parts = spec.split("/")
    return ["go:" + "/".join(parts[i:]) for i in range(len(parts))] if "." in parts[0] or len(parts) > 1 else []


def rust(source: str, spec: str) -> list[str]:
    here, stem = posixpath.dirname(source), posixpath.basename(source)[:-3]
    inner = here if stem in ("mod", "lib", "main") else posixpath.join(here, stem)
    spec = re.sub(r"::\{.*|::\*$|\s+as\s+\w+$", "", spec.strip())
    if "::" not in spec and spec not in ("crate", "self", "super"):
        return [posixpath.join(inner, spec + ".rs"), posixpath.join(inner, spec, "mod.rs")]
    parts = spec.split("::")
    m = re.match(r"(.*?\bsrc)/", source)
    base = {"crate": m[1] if m else "src", "self": inner}.get(parts[0])
    if parts[0] == "super":
        base = posixpath.dirname(inner)
        while len(parts) > 1 and parts[1] == "super":
            base, parts = posixpath.dirname(base), parts[1:]
    if base is None:
        return [f"crate:{parts[0]}"]
    out = []
    for n in range(len(parts), 1, -1):
        path = posixpath.join(base, *parts[1:n])
        out += [path + ".rs", posixpath.join(path, "mod.rs")]
    return out


def php(source: str, spec: str) -> list[str]:
    if "/" in spec or spec.endswith(".php"):
        return [_near(source, spec.lstrip("/")), spec.lstrip("/")]
    parts = spec.strip("\\").split("\\")
    return [r + "/".join(parts[i:]) + ".php" for i in range(len(parts)) for r in ("", "src/", "app/", "lib/")]


def dart(source: str, spec: str) -> list[str]:
    if spec.startswith("dart:"):
        return []
    if spec.startswith("package:"):
        name, _, rest = spec[8:].partition("/")
        return [f"dartpkg:{name}|lib/{rest}", f"lib/{rest}"]
    return [_near(source, spec)]


def elixir(source: str, spec: str) -> list[str]:
    parts = [_snake(x) for x in spec.split(".")]
    return [r + "/".join(parts[i:]) + e for i in range(len(parts)) for r in ("lib/", "test/support/", "") for e in (".ex", ".exs")]


def erlang(source: str, spec: str) -> list[str]:
    if spec.endswith(".hrl"):
        name = spec.split("/", 1)[-1] if "/include/" in spec else spec
        return [_near(source, spec), posixpath.normpath("include/" + posixpath.basename(spec)), _near(source, "../include/" + posixpath.basename(spec)), name]
    return [_near(source, spec + ".erl"), f"src/{spec}.erl"]


def fortran(source: str, spec: str) -> list[str]:
    return [_near(source, spec), f"fstem:{posixpath.splitext(posixpath.basename(spec))[0].lower()}"]


def haskell(source: str, spec: str) -> list[str]:
    path = spec.replace(".", "/")
    return [r + path + e for r in ("src/", "", "lib/", "app/") for e in (".hs", ".lhs")]


def ruby(source: str, spec: str) -> list[str]:
    end = "" if spec.endswith(".rb") else ".rb"
    near = [_near(source, spec + end)]
    return (near if spec.startswith(".") else []) + ["lib/" + spec + end, "rb:" + spec, *near, spec + end]


def swift(source: str, spec: str) -> list[str]:
    return ["swift:" + spec.split(".")[0]]


def plain(source: str, spec: str) -> list[str]:
    """Includes, style sheets, Lua, R, shell, protobuf and the like: by the file's folder, then by the usual roots."""
    ext = "." + source.rsplit(".", 1)[-1].lower()
    spec = spec.removeprefix("res://")
    if ext == ".lua":
        spec = spec.replace(".", "/") + ".lua"
    names = [spec]
    if ext in (".scss", ".sass", ".less", ".css"):
        folder, _, leaf = spec.rpartition("/")
        lead = folder + "/" if folder else ""
        names += [spec + e for e in (ext, ".css")] + [f"{lead}_{leaf}{ext}", f"{spec}/_index{ext}"]
    if ext in (".sql",):
        return [f"sqlstem:{spec.split('.')[-1].lower()}"]
    return [_near(source, n) for n in names] + [r + n for n in names for r in ("", "include/", "src/", "lib/", "proto/", "protos/")]


FAMILIES: dict[str, Callable[[str, str], list[str]]] = {
    **dict.fromkeys((".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".astro"), scripts), ".py": python, **dict.fromkeys((".java", ".kt", ".kts", ".scala", ".sc", ".groovy"), jvm), ".go": go, ".rs": rust, ".php": php,
    ".dart": dart, **dict.fromkeys((".ex", ".exs"), elixir), **dict.fromkeys((".erl", ".hrl"), erlang), **dict.fromkeys((".f90", ".f95", ".f03", ".f08", ".for", ".f"), fortran), **dict.fromkeys((".hs", ".lhs"), haskell), ".rb": ruby, ".swift": swift,
}


def keys_of(path: str, package: str | None, content: bytes | None) -> list[str]:
    """The keys that a file answers to."""
    out = [path]
    folder, name = posixpath.split(path)
    stem, _, ext = name.rpartition(".")
    if ext == "py":
        parts = path[:-3].split("/")
        if parts[-1] == "__init__":
            parts = parts[:-1]
        out += ["py:" + ".".join(parts)] + (["py:" + ".".join(parts[1:])] if len(parts) > 1 and parts[0] in ("src", "lib", "python", "app") else [])
    elif ext in ("java", "kt", "kts", "scala", "sc", "groovy"):
        if package:
            out += [f"jvm:{package}.{stem}", f"jvmpkg:{package}"]
        elif m := re.search(r"(?:src/(?:main|test)/(?:java|kotlin|scala|groovy)|src)/(.+)/[^/]+$", path):
            dotted = m[1].replace("/", ".")
            out += [f"jvm:{dotted}.{stem}", f"jvmpkg:{dotted}"]
    elif ext == "go" and not name.endswith("_test.go"):
        out.append("go:" + folder)
    elif ext == "rb" and (m := re.match(r"(?:lib|app/[^/]+)/(.+)\.rb$", path)):
        out.append("rb:" + m[1])
    elif ext == "swift" and (m := re.search(r"(?:^|/)(?:Sources|Tests)/([^/]+)/", path)):
        out.append("swift:" + m[1])
    elif ext.lower() in ("f90", "f95", "f03", "f08", "for", "f"):
        out.append("fstem:" + stem.lower())
    elif ext == "sql":
        out.append("sqlstem:" + stem.lower())
    return [k for k in out if k]


def packages(files: DataFrame) -> DataFrame:
    """(repo_id, package, folder, entry): workspace packages that package.json, pubspec.yaml and Cargo.toml name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for repo, path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                folder, name = posixpath.split(path)
                text = raw.decode("utf-8", "replace")
                if name == "package.json":
                    try:
                        doc = json.loads(text)
                    except ValueError:
                        continue
                    if isinstance(doc, dict) and isinstance(doc.get("name"), str):
                        exports = doc.get("exports")
                        dot = exports.get(".") if isinstance(exports, dict) else exports
                        dot = next((v for v in dot.values() if isinstance(v, str)), None) if isinstance(dot, dict) else dot
                        entry = next((x for x in (doc.get("source"), dot, doc.get("module"), doc.get("main"), doc.get("types")) if isinstance(x, str)), "index.js")
                        rows.append((repo, "pkg:" + doc["name"], folder, posixpath.normpath(entry)))
                elif name == "pubspec.yaml" and (m := re.search(r"^name:\s*(\w+)", text, re.M)):
                    rows.append((repo, "dartpkg:" + m[1], folder, f"lib/{m[1]}.dart"))
                elif name == "Cargo.toml" and (m := re.search(r"^\[package\][^\[]*?^name\s*=\s*\"([\w-]+)\"", text, re.M | re.S)):
                    rows.append((repo, "crate:" + m[1].replace("-", "_"), folder, "src/lib.rs"))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["repo_id", "package", "folder", "entry"])

    manifests = files.filter(F.col("path").rlike(r"(^|/)(package\.json|pubspec\.yaml|Cargo\.toml)$") & F.col("raw_content").isNotNull())
    return manifests.select("repo_id", "path", "raw_content").mapInArrow(run, "repo_id string, package string, folder string, entry string").distinct()


def file_keys(files: DataFrame) -> DataFrame:
    """(repo_id, key, path) of all files; `files` has repo_id, path and, for the JVM, declared_package."""
    package = F.col("declared_package") if "declared_package" in files.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r, k, p) for r, p, g in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for k in keys_of(p, g, None)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["repo_id", "key", "path"])

    return files.filter(F.col("repo_id").isNotNull() & F.col("path").isNotNull()).select("repo_id", "path", package.alias("g")).distinct().mapInArrow(run, "repo_id string, key string, path string")


def candidates(records: DataFrame) -> DataFrame:
    """(repo_id, source, specifier, ordinal, key, package, rest): ordered keys of every record; package and rest where the
    key goes through a workspace package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for repo, source, spec in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                family = FAMILIES.get("." + source.rsplit(".", 1)[-1].lower(), plain)
                for i, k in enumerate(dict.fromkeys(family(source, spec))):
                    package, _, rest = k.partition("|") if k.startswith(("pkg:", "dartpkg:", "crate:")) else (None, "", None)
                    rows.append((repo, source, spec, i, k, package, rest))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.string()] * 3 + [pa.int32()] + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["repo_id", "source", "specifier", "ordinal", "key", "package", "rest"])

    keyed = records.filter(F.col("repo_id").isNotNull() & F.col("source").isNotNull() & F.col("specifier").isNotNull()).select("repo_id", "source", "specifier").distinct()
    return spread(keyed).mapInArrow(run, "repo_id string, source string, specifier string, ordinal int, key string, package string, rest string")


def resolve(records: DataFrame, files: DataFrame) -> DataFrame:
    """`records` (repo_id, source, specifier, ...) with target, one row per target of the first key that files answer to;
    what no file answers to is left out.  A column `resolved_path`, where it is not null and a file, comes first."""
    c = candidates(records)
    known = packages(files)
    through = c.filter(F.col("package").isNotNull()).join(known, ["repo_id", "package"])
    joined = F.when(F.col("rest") == "", F.concat_ws("/", F.nullif("folder", F.lit("")), "entry")).otherwise(F.concat_ws("/", F.nullif("folder", F.lit("")), "rest"))
    by_key = c.filter(F.col("package").isNull()).select("repo_id", "source", "specifier", "ordinal", "key").unionByName(through.select("repo_id", "source", "specifier", "ordinal", joined.alias("key")))
    if "resolved_path" in records.columns:
        given = records.filter(F.col("resolved_path").isNotNull()).select("repo_id", "source", "specifier", F.lit(-1).alias("ordinal"), F.col("resolved_path").alias("key"))
        by_key = by_key.unionByName(given)
    hits = by_key.join(file_keys(files), ["repo_id", "key"]).filter("source <> path")
    first = hits.groupBy("repo_id", "source", "specifier").agg(F.min("ordinal").alias("ordinal"))
    targets = hits.join(first, ["repo_id", "source", "specifier", "ordinal"]).select("repo_id", "source", "specifier", F.col("path").alias("target")).distinct()
    return records.join(targets, ["repo_id", "source", "specifier"])


def cross_repo(records: DataFrame, resolved: DataFrame, files: DataFrame, links: DataFrame) -> DataFrame:
    """(repo_id, source, specifier, target_repo_id, target) of records that nothing in their own repository answers to.

    links: (repo_id, linked, position); the first linked repository that answers holds.  Relative specifiers and those
    that begin at the own crate are no cases.
    """
    open_ = records.join(resolved.select("repo_id", "source", "specifier").distinct(), ["repo_id", "source", "specifier"], "left_anti")
    open_ = open_.filter(~F.col("specifier").rlike(r"^(\.|/|(crate|self|super)(::|$))"))
    c = candidates(open_)
    far = packages(files).withColumnRenamed("repo_id", "linked")
    offered = c.join(links.select("repo_id", "linked", "position"), "repo_id")
    joined = F.when(F.col("rest") == "", F.concat_ws("/", F.nullif("folder", F.lit("")), "entry")).otherwise(F.concat_ws("/", F.nullif("folder", F.lit("")), "rest"))
    keep = ["repo_id", "source", "specifier", "linked", "position", "ordinal"]
    by_key = offered.filter(F.col("package").isNull() & F.col("key").contains(":")).select(*keep, "key").unionByName(offered.filter(F.col("package").isNotNull()).join(far, ["linked", "package"]).select(*keep, joined.alias("key")))
    hits = by_key.join(file_keys(files).withColumnRenamed("repo_id", "linked"), ["linked", "key"])
    best = hits.groupBy("repo_id", "source", "specifier").agg(F.min(F.struct("position", "ordinal")).alias("b"))
    return hits.join(best, ["repo_id", "source", "specifier"]).filter((F.col("position") == F.col("b.position")) & (F.col("ordinal") == F.col("b.ordinal"))).select(
        "repo_id", "source", "specifier", F.col("linked").alias("target_repo_id"), F.col("path").alias("target")
    ).distinct()
