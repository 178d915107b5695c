"""From files to index rows: symbols, imports, uses of names, injected types, in one map over the contents.

Contents are read once and go no further; what leaves the map are small rows.  Every occurrence of a name is counted at
the innermost symbol that holds it while the file is at hand, so that references need no join of byte ranges later.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.extract.complexity import Metrics, measure
from graphloom.extract.frameworks import Adapters
from graphloom.extract.languages import Declared, Parsed, Registry, hidden, standard
from graphloom.functions.scalars import short_id
from graphloom.sources.tables import spread

METRIC_NAMES = Metrics._fields
FIELDS = {
    "repo_id": "string", "path": "string", "what": "string", "name": "string", "kind": "string", "start_byte": "int", "end_byte": "int", "signature": "string", "summary": "string", "framework_meta": "string",
    **dict.fromkeys(METRIC_NAMES, "int"), "specifier": "string", "names": "array<string>", "form": "string", "type_only": "boolean", "position": "int", "amount": "int",
}
WORD = re.compile(r"[A-Za-z_$][\w$]*")
#: Annotations and calls that make a class available for injection.
PROVIDES = re.compile(r"@(?:Injectable|Service|Component|Repository|Singleton|ApplicationScoped|Controller|RestController|Bean|Module|Provider)\b(?:\([^)]*\))?\s*(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:(?:export|public|final|open|abstract|internal|data|default)\s+)*class\s+(?P<name>\w+)")
CONSUMES = (
    re.compile(r"\bconstructor\s*\((?P<params>[^)]*)\)"), re.compile(r"@(?:Autowired|Inject)\b(?:\([^)]*\))?\s*(?:(?:private|public|protected|final|lateinit|var|val)\s+)*(?P<type>[A-Z]\w*)(?:<[^>]*>)?\s+\w+\s*[;=]"),
    re.compile(r"^[ \t]*public\s+(?P<ctor>[A-Z]\w*)\s*\((?P<params2>[^)]*)\)\s*(?:throws[^{]*)?\{", re.M), re.compile(r"\bclass\s+\w+\s*(?:@Inject\s+constructor\s*)?\((?P<params3>[^)]*\bva[lr]\b[^)]*)\)"),
)
INJECTED = (".ts", ".mts", ".java", ".kt", ".cs", ".php", ".scala")


class LanguageHandler(Protocol):
    """What reads a file of a language: see `languages.Language` for handlers that are tables."""

    extensions: tuple[str, ...]

    def read(self, text: str) -> Parsed: ...


class FrameworkAdapter(Protocol):
    name: str

    def extract(self, path: str, text: str) -> list[Declared]: ...


class ContextProvider(Protocol):
    """Gives rows about the entities of a repository: (repo_id, entity, metadata JSON)."""

    def rows(self, files: DataFrame) -> DataFrame: ...


class EmbeddingProvider(Protocol):
    name: str
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Summarizer(Protocol):
    def summarize(self, name: str, signature: str, source: str) -> str | None: ...


def first_summary(d: Declared) -> str:
    """The first that there is of: the comment, what the framework says of it, the signature."""
    if d.summary.strip():
        return d.summary.strip()
    if d.meta and "framework" in d.meta:
        return " ".join(str(v) for v in d.meta.values() if isinstance(v, str))
    return d.signature


def injected(path: str, text: str) -> tuple[list[str], list[str]]:
    """(types that the file's constructors and fields ask for, types that it provides)."""
    if not path.endswith(INJECTED):
        return [], []
    code = hidden(text, "c")
    wanted: list[str] = []
    for p in CONSUMES:
        for m in p.finditer(code):
            g = m.groupdict()
            if g.get("type"):
                wanted.append(g["type"])
            for params in (g.get("params"), g.get("params2"), g.get("params3")):
                if params:
                    wanted += re.findall(r":\s*([A-Z]\w*)", params) if ":" in params else re.findall(r"\b([A-Z]\w*)(?:<[^>]*>)?\s+\w+\s*(?:,|$)", params)
    return list(dict.fromkeys(wanted)), list(dict.fromkeys(m["name"] for m in PROVIDES.finditer(code)))


def uses(text: str, raw: bytes, symbols: list[Declared]) -> Counter:
    """(place of the innermost symbol or -1, name) -> occurrences outside comments and strings' quotes."""
    spans = sorted((d.start, d.end, i) for i, d in enumerate(symbols))
    out: Counter = Counter()
    stack: list[tuple[int, int]] = []  # (end, symbol) of the spans around the current place
    at = 0
    shift = 0
    ascii_ = len(raw) == len(text)
    last = 0
    for m in WORD.finditer(text):
        if not ascii_:
            shift += len(text[last : m.start()].encode("utf-8", "replace")) - (m.start() - last)
            last = m.start()
        place = m.start() + shift
        while at < len(spans) and spans[at][0] <= place:
            stack.append((spans[at][1], spans[at][2]))
            at += 1
        while stack and stack[-1][0] <= place:
            stack.pop()
        out[stack[-1][1] if stack else -1, m[0]] += 1
    return out


def process(files: DataFrame, registry: Registry | None = None, adapters: Adapters | None = None, with_uses: bool = True) -> DataFrame:
    """Rows of FIELDS; what is symbol, import, use, consumes or provides.

    Null content and unknown extensions give nothing; repeated rows of a file repeat its rows, `symbols` and the others
    below take them together; bytes that are no UTF-8 are replaced.
    """
    registry, adapters = registry or standard(), adapters or Adapters()

    def rows_of(repo: str, path: str, raw: bytes) -> Iterator[dict]:
        text = raw.decode("utf-8", "replace")
        if text.startswith("﻿"):
            text = " " + text[1:]  # keeps the number of characters; the mark has three bytes
            raw = text.encode("utf-8", "replace")
        parsed = registry.parse(path, text)
        declared = [*parsed.symbols, *adapters.extract(path, text)]
        for d in declared:
            source = raw[d.start : d.end].decode("utf-8", "replace")
            code = measure(source) if d.kind in ("function", "method", "class", "struct", "interface", "component", "hook") else Metrics(source.count("\n") + 1, 1, 0, 0, 0, 0)
            yield {"what": "symbol", "name": d.name, "kind": d.kind, "start_byte": d.start, "end_byte": d.end, "signature": d.signature, "summary": first_summary(d), "framework_meta": json.dumps(d.meta, sort_keys=True, ensure_ascii=False) if d.meta else None, **code._asdict()}
        for i, x in enumerate(parsed.imports):
            yield {"what": "import", "specifier": x.specifier, "names": list(x.names), "form": x.form, "type_only": x.type_only, "position": i}
        wanted, given = injected(path, text)
        yield from ({"what": "consumes", "name": n} for n in wanted)
        yield from ({"what": "provides", "name": n} for n in given)
        if with_uses and (parsed.symbols or parsed.imports):
            for (i, name), n in uses(text, raw, parsed.symbols).items():
                d = parsed.symbols[i] if i >= 0 else None
                yield {"what": "use", "name": name, "kind": d.kind if d else None, "signature": d.name if d else None, "start_byte": d.start if d else None, "amount": n}

    schema = pa.schema([(k, {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}[t]) for k, t in FIELDS.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for repo, path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if raw.is_valid and path is not None:
                    out += [{"repo_id": repo, "path": path} | r for r in rows_of(repo, path, raw.as_py())]
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema)

    return spread(files.select("repo_id", "path", "raw_content")).mapInArrow(run, ", ".join(f"{k} {t}" for k, t in FIELDS.items()))


def symbols(rows: DataFrame) -> DataFrame:
    """(id, repo_id, name, kind, file_path, start_byte, end_byte, signature, summary, framework_meta, metrics): one row an
    id; of several declarations of one path, name and kind the last holds."""
    s = rows.filter("what = 'symbol'").withColumn("id", short_id(F.col("path"), F.col("name"), F.col("kind")))
    rest = ["name", "kind", "start_byte", "end_byte", "signature", "summary", "framework_meta", *METRIC_NAMES]
    last = s.groupBy("id", "repo_id", F.col("path").alias("file_path")).agg(F.max_by(F.struct(*rest), F.struct("start_byte", "end_byte")).alias("r"))
    return last.select("id", "repo_id", "file_path", "r.*")


def imports(rows: DataFrame) -> DataFrame:
    """(repo_id, source, specifier, names, form, type_only, position): import records, the first of equal specifiers."""
    r = rows.filter("what = 'import'").select("repo_id", F.col("path").alias("source"), "specifier", "names", "form", "type_only", "position").distinct()
    return r.groupBy("repo_id", "source", "specifier").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("names"), F.min_by("form", "position").alias("form"), F.min("type_only").alias("type_only"), F.min("position").alias("position")
    )


def name_uses(rows: DataFrame) -> DataFrame:
    """(repo_id, path, symbol_id, name, amount): occurrences of names, by the innermost symbol around them (null: none)."""
    u = rows.filter("what = 'use'").withColumn("symbol_id", F.when(F.col("signature").isNotNull(), short_id(F.col("path"), F.col("signature"), F.col("kind"))))
    return u.groupBy("repo_id", "path", "symbol_id", "name", "start_byte").agg(F.max("amount").alias("n")).groupBy("repo_id", "path", "symbol_id", "name").agg(F.sum("n").alias("amount"))


def embedding_text(symbols_: DataFrame, max_tokens: int = 512) -> DataFrame:
    """(id, text): name and signature, then the summary, cut where the provider's input ends."""
    text = F.concat_ws("\n", F.concat_ws(": ", "name", "signature"), F.nullif(F.trim("summary"), F.lit("")))
    return symbols_.select("id", F.substring(text, F.lit(1), F.lit(4 * max_tokens)).alias("text"))


def embed(texts: DataFrame, provider: EmbeddingProvider, batch: int = 500) -> DataFrame:
    """(id, provider, dimension, embedding) of (id, text), in batches of at most `batch` texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                vectors = provider.embed([t or "" for t in part.column(1).to_pylist()])
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([provider.name] * n), pa.array([provider.dimension] * n, pa.int32()), pa.array(vectors, pa.list_(pa.float32()))], ["id", "provider", "dimension", "embedding"])

    return texts.select("id", "text").mapInArrow(run, "id string, provider string, dimension int, embedding array<float>")
