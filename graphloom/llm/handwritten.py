"""Generated, minified, vendored and bulk-data files (problem 2), told from hand-written source.

1. One pass over the contents (Arrow batches) reduces every file to a leaf: the hash of its code without comments,
   white space, byte order mark and line ends (so that a changed licence line hides no copy), its size, and what its
   header, its layout and its path say by themselves.  Contents are read once and go no further.
2. Merkle hashes are built bottom-up over the directory trees: a directory's hash combines its children's, whatever
   they are called; each level is one aggregation with partial sums, so no directory is collected anywhere.
3. Repositories that share most of the hand-written files of both are one family (clones, forks, renamed copies).
4. A subtree (file or directory) whose hash occurs in more than one family is a third-party copy.

Defined results: null content is no case and takes no part in any hash; empty files are hand-written; files shared
with fewer than `min_code` characters of code are too common to be copies; repeated rows of a file count once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.tables import cut, spread

#: Directories that package managers and people keep other people's code in.
VENDORED_DIR = frozenset(
    "node_modules bower_components jspm_packages vendor vendors vendored _vendor third_party third-party thirdparty 3rdparty 3rd_party 3rd-party external externals extern godeps site-packages dist-packages .venv venv virtualenv pods carthage deps .tox elm-stuff .yarn .cargo .gradle .m2".split()
)
#: Directories that tools write to.
GENERATED_DIR = frozenset(
    "generated __generated__ _generated .generated generated-sources generated-src generated_sources generated-code gen autogen auto-generated autogenerated codegen-out dist build out target bin obj .next .nuxt .output __pycache__ .parcel-cache coverage".split()
)
#: File names that tools write.
GENERATED_NAME = re.compile(
    r"(?i)(_pb2(_grpc)?\.pyi?|\.pb(\.gw)?\.(go|cc|h|ts|js)|_pb\.(js|ts|d\.ts)|_grpc_pb\.(js|ts)|[._-]gen(erated)?\.\w+|^zz_generated.*|[._-]autogen\.\w+|^mock_\w+\.go|\.g\.(ts|dart|cs)|\.designer\.cs|\.freezed\.dart|_string\.go|bindata\.go|"
    r"[._-]min\.(js|mjs|cjs|css|ts)|[._-]bundle\.(js|mjs|cjs|css|ts)|\.chunk\.js|[._-]umd\.js|"
    r"^(package-lock|npm-shrinkwrap|composer-lock|packages\.lock)\.json|^(yarn|pnpm-lock|cargo|poetry|gemfile|composer|pipfile|bun)\.(lock|yaml)|^go\.sum|^r\.java|^buildconfig\.java)$"
)
#: What generators write at the head of a file, in several languages.
GENERATED_HEAD = re.compile(
    r"(?i)(@generated\b|<auto-?generated|\bauto[- ]?generated\b|\bautomatically[- ](?:generated|created|produced|built|written)\b|\b(?:code|file|source|class|module|script|this) (?:is |was |has been )?(?:auto(?:matically)?[- ]?)?generated (?:by|from|with|using)\b|"
    r"^\W*(?:eslint-disable\W*(?:\*/\s*/\*)?\W*)?(?:this (?:file|code) (?:is|was) )?generated (?:by|from|with|using|on)\b|"
    r"\b(?:do not|don't|don’t|never) (?:edit|modify|change|touch)(?: this file| it| them)?(?: by hand| manually| directly)?\W*(?:$|produced|generated|created|-|\()|\b(?:machine[- ](?:made|generated|written)|computer[- ]generated)\b|"
    r"\b(?:changes|edits|modifications)(?: to this file| made here)? (?:will be|are|get) (?:lost|overwritten|discarded)\b|\bany (?:changes|edits) .*(?:lost|overwritten)|\b(?:produced|rebuilt|emitted|compiled|transpiled|built|created|derived) (?:automatically )?(?:by|from) \S+.*(?:\bfrom\b|\bnever\b|\bdo not\b|\bdon't\b|\bon every\b|\bversion\b|\bv\d)|"
    r"automatisch (?:erzeugt|generiert|erstellt)|(?:generiert|erzeugt) (?:von|durch|mit|aus)\b|nicht (?:manuell )?(?:bearbeiten|editieren|ändern)\W*$|(?:est |été )?généré(?:e|s)? (?:automatiquement|par|à partir)|ne (?:pas )?(?:modifier|éditer)|"
    r"generad[oa] (?:automáticamente|por|a partir|desde)|no (?:editar|modificar)|gerad[oa] (?:automaticamente|por|a partir)|não (?:edit|modif)|generato (?:automaticamente|da)|non modificare|自动生成|自動生成|機械生成|机器生成|请勿(?:手动)?(?:编辑|修改)|編集しないで|自動的に生成|автоматически сгенерирован|сгенерирован|не редактировать|자동 생성|생성된 파일)"
)
#: What a human writes about generated code.
HAND_HEAD = re.compile(r"(?i)hand[- ]?written|written by hand|not (?:auto-?)?generated|isn't generated|edit (?:freely|away)|generated (?:client|code|files?) (?:lives?|is|are) (?:elsewhere|in)")
#: Banners of published libraries (a name with a version or a licence, or an upstream).
VENDOR_HEAD = re.compile(
    r"(?i)(^\W*!?\s*@?(?:license\s+)?[\w.\-/@]+\s+v?\d+\.\d+(?:\.\d+)?\S*\s*(?:$|\*/|[|\-–—(,].*)|@license\s+[\w.\-/@]+ v?\d+\.\d+|\b(?:copied|vendored|taken|imported|forked|adapted|borrowed|ported|synced|mirrored|backported)(?: verbatim| unchanged)? from (?:upstream|the|https?:|github|gitlab|npm|pypi|\S+@\d|\S+ v?\d)|\bkeep in sync with (?:their|upstream)|\bupstream(?: version|:| source| release)|"
    r"\(c\)\s*\d{4}(?:[-–,]\s*\d{4})? (?:the )?(?!contributors of this)[\w.\-]+ (?:authors|contributors|team|project|developers|foundation|inc|ltd|gmbh)|copyright\s*(?:\(c\)|©)?\s*\d{4}.{0,20}\b(?:the )?[\w.\-]+ (?:authors|contributors)|^\W*released under the (?:mit|bsd|apache|isc|mpl|lgpl|gpl)\b|\bsee https?://\S+ for (?:the )?(?:license|licence|original))"
)
LINE = re.compile(r"[^\n]+")
COMMENT_LINE = re.compile(r'^\s*(?://|#|/\*|\*|<!--|--(?=\s)|;(?=\s)|"""|\'\'\')')
STRIP = {
    "py": re.compile(r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|#[^\n]*'),
    "c": re.compile(r"/\*[\s\S]*?\*/|(?<![:\"'/\\])//[^\n]*"),
}
LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|[-+]?\b(?:0x[0-9a-fA-F]+|\d[\d._eE]*)\b")
CODE = ("py", "js", "jsx", "mjs", "cjs", "ts", "tsx", "go", "java", "c", "cc", "cpp", "h", "hpp", "rs", "rb", "php", "cs", "kt", "swift", "scala", "lua", "css")


#: What compilers to JavaScript leave, anywhere in a file.
SOURCE_MAP = re.compile(r"^//[#@] sourceMappingURL=", re.M)
ES_MODULE = re.compile(r'(?:^|;)[ \t]*Object\.defineProperty\(exports, "__esModule"', re.M)
SCRIPT = ("js", "mjs", "cjs", "jsx", "ts", "tsx", "css")


def _one_dense_line(text: str) -> bool:
    """Whether a short script is one line of several statements with hardly a space, as a minifier writes it."""
    line = text.strip()
    code = LITERAL.sub("", line)
    marks = sum(map(code.count, ";{}"))
    return "\n" not in line and marks >= 5 and line.count(" ") < 0.12 * len(line) and marks + code.count("(") + code.count(")") > 0.08 * len(line)


def _ext(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()


def head_lines(text: str) -> list[str]:
    """The comment lines before the first line of code, however many; a generator writes its mark there."""
    out: list[str] = []
    inside = ""
    for m in LINE.finditer(text):
        s = m[0].strip()
        if inside:
            out.append(s)
            if inside in s:
                inside = ""
        elif not s or s in ('"use strict";', "'use strict';", "<?php", "package main"):
            continue
        elif COMMENT_LINE.match(s):
            out.append(s)
            if s.startswith("/*") and "*/" not in s:
                inside = "*/"
            elif s[:3] in ('"""', "'''") and s.count(s[:3]) < 2:
                inside = s[:3]
        else:
            break
    return out


def says(path: str, text: str) -> str | None:
    """What path, header and layout say: generated, vendored, minified or data; null if nothing."""
    steps = path.replace("\\", "/").lower().split("/")
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    if any(s in VENDORED_DIR for s in steps[:-1]):
        return "vendored"
    if GENERATED_NAME.search(name) or any(s in GENERATED_DIR for s in steps[:-1]):
        return "generated"
    raw = head_lines(text)
    head = [re.sub(r"^\W*(?:\*/)?", "", h) if not h.startswith(("<", "@")) else h for h in raw]
    if not any(HAND_HEAD.search(h) for h in raw):
        for h, r in zip(head, raw, strict=True):
            quoted = r.startswith(('"""', "'''"))
            if GENERATED_HEAD.search(r) or GENERATED_HEAD.search(h):
                return "generated"
            if not quoted and VENDOR_HEAD.search(h):
                return "vendored"
    ext = _ext(path)
    if ext not in CODE:
        return None
    if SOURCE_MAP.search(text) or ('defineProperty(exports, "__esModule"' in text[:400] or ES_MODULE.search(text)) and "require(" in text and re.search(r"\b_\w+", text):
        return "generated"
    if len(text) < 400:
        return "minified" if ext in SCRIPT and _one_dense_line(text) else None
    solid = len(text) - sum(text.count(c) for c in " \t\n")
    lines = text.split("\n")
    long = [x for x in lines if len(x) > 400]
    if long:
        dense = [x for x in long if x.count(" ") < 0.12 * len(x) and len(re.findall(r"[;{}()]", LITERAL.sub("", x))) > 0.08 * len(x)]
        if sum(map(len, dense)) > 0.5 * len(text):
            return "minified"
    if len(lines) < 0.008 * len(text) and text.count(";") > 0.02 * len(text) and text.count(" ") < 0.1 * len(text):
        return "minified"
    if len(text) >= 1000 and (text.count('"') + text.count("'") > 0.01 * len(text) or sum(map(text.count, "0123456789")) > 0.2 * len(text) or len(lines) < 5):
        # literals go first, as they may hold comment marks; then comments, and what is left is code
        literals = LITERAL.findall(text)
        body = STRIP["py" if ext == "py" else "c"].sub("", LITERAL.sub("", text))
        rest = re.sub(r"[\s,\[\]{}():;=]+", "", body)
        values = len(literals)
        if len(rest) < 0.12 * max(1, solid) and (values >= 40 or solid > 1500):
            return "data"
    return None


def leaf_hash(path: str, text: str) -> tuple[int | None, int]:
    """(hash of the code, characters of code); comments, white space and line ends take no part."""
    ext = _ext(path)
    if ext == "json":
        code = text
    else:
        code = STRIP["py" if ext in ("py", "yml", "yaml", "toml", "ini", "env", "properties", "sh", "rb") else "c"].sub("", text)
    code = "".join(code.split())
    if not code:
        return None, 0
    return int.from_bytes(hashlib.blake2b(code.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True), len(code)


def leaves(files: DataFrame) -> DataFrame:
    """(repo_id, path, leaf bigint, code_chars int, says string) of every file with content, each once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for repo, path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if not raw.is_valid or path is None:
                    continue
                text = raw.as_py().decode("utf-8", "replace").lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
                rows.append((repo, path, *leaf_hash(path, text), says(path, text)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["repo_id", "path", "leaf", "code_chars", "says"])

    schema = "repo_id string, path string, leaf bigint, code_chars int, says string"
    return spread(files.select("repo_id", "path", "raw_content")).mapInArrow(scan, schema).dropDuplicates(["repo_id", "path"])


STEPS = "split(replace(path, '\\\\', '/'), '/')"


def merkle(leaves_: DataFrame) -> DataFrame:
    """(repo_id, node, depth, hash, code_chars, n_files): hashes of directories, bottom-up; '' is the root.

    One aggregation a level, each materialised once: the level above reads it.
    """
    placed = leaves_.filter(F.col("leaf").isNotNull()).withColumn("steps", F.expr(STEPS)).withColumn("depth", F.size("steps") - 1)
    items = placed.select("repo_id", "depth", F.array_join(F.expr("slice(steps, 1, depth)"), "/").alias("dir"), F.col("leaf").alias("hash"), F.col("code_chars").cast("long").alias("code_chars"), F.lit(1).cast("long").alias("n_files"))
    deepest = items.agg(F.max("depth")).first()[0] or 0
    levels: list[DataFrame] = []
    for depth in range(deepest, -1, -1):
        here = items.filter(F.col("depth") == depth).drop("depth")
        if levels:
            up = levels[-1].select("repo_id", F.array_join(F.slice(F.split("dir", "/"), 1, depth), "/").alias("dir"), "hash", "code_chars", "n_files")
            here = here.unionByName(up)
        # a sum of mixed child hashes: partial sums combine, and neither names nor order matter
        sums = here.groupBy("repo_id", "dir").agg(F.sum(F.xxhash64("hash").cast("decimal(38,0)")).alias("mix"), F.sum("code_chars").alias("code_chars"), F.sum("n_files").alias("n_files"))
        levels.append(cut(sums.select("repo_id", "dir", F.xxhash64(F.col("mix").cast("string"), "n_files").alias("hash"), "code_chars", "n_files", F.lit(depth).alias("depth"))))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select("repo_id", F.col("dir").alias("node"), "depth", "hash", "code_chars", "n_files")


def families(all_leaves: DataFrame, min_code: int) -> DataFrame:
    """(repo_id, family): repositories that share more than half of the hand-written files of both, linked in turn.

    A leaf that several repositories hold links each of them with the smallest one that holds it, so a leaf in n
    repositories gives n links; what nothing but its hash speaks against counts as hand-written.
    """
    own = all_leaves.filter(F.col("leaf").isNotNull() & F.col("says").isNull() & (F.col("code_chars") >= min_code) & F.col("repo_id").isNotNull()).select("repo_id", "leaf").distinct()
    counts = own.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    least = own.groupBy("leaf").agg(F.min("repo_id").alias("parent"), F.count(F.lit(1)).alias("repos")).filter("repos > 1").drop("repos")
    shared = own.join(least, "leaf").filter("repo_id <> parent").groupBy("repo_id", "parent").agg(F.count(F.lit(1)).alias("shared"))
    above = counts.withColumnRenamed("repo_id", "parent").withColumnRenamed("n", "m")
    # a leaf has one parent, so at most one parent holds more than half of a repository's leaves
    links = shared.join(counts, "repo_id").join(above, "parent").filter("2 * shared > n and 2 * shared > m").select("repo_id", "parent")
    links = cut(links)
    while True:  # a link leads to a smaller id; pointers are doubled until all lead to the smallest
        up = links.withColumnRenamed("repo_id", "p").withColumnRenamed("parent", "top")
        further = cut(links.join(up, F.col("parent") == F.col("p"), "left").select("repo_id", F.coalesce("top", "parent").alias("parent"), F.col("top").isNotNull().alias("moved")))
        links = further.select("repo_id", "parent")
        if further.filter("moved").isEmpty():
            break
    every = all_leaves.select("repo_id").distinct()
    return every.join(links, "repo_id", "left").select("repo_id", F.coalesce("parent", "repo_id").alias("family"))


def classify(files: DataFrame, min_code: int = 120) -> DataFrame:
    """(repo_id, path, reason): reason is null for hand-written files, else generated, minified, data or vendored."""
    all_leaves = cut(leaves(files))
    tree = merkle(all_leaves)
    family = cut(families(all_leaves, min_code))
    nodes = (
        tree.filter("node <> '' and n_files > 1").select("repo_id", "hash", "code_chars", F.col("node"))
        .unionByName(all_leaves.filter(F.col("leaf").isNotNull()).select("repo_id", F.col("leaf").alias("hash"), F.col("code_chars").cast("long").alias("code_chars"), F.lit(None).cast("string").alias("node")))
        .filter(F.col("code_chars") >= min_code)
    )
    # one and another family are enough: the smallest and the largest differ
    of_hash = nodes.join(family, "repo_id").groupBy("hash").agg(F.min("family").alias("one"), F.max("family").alias("other"))
    shared = cut(of_hash.filter("one <> other").select("hash"))
    shared_leaf = all_leaves.join(shared, F.col("leaf") == F.col("hash"), "left_semi").filter(F.col("code_chars") >= min_code).select("repo_id", "path")
    shared_dir = nodes.filter(F.col("node").isNotNull()).join(shared, "hash", "left_semi").select("repo_id", "node").distinct()
    above = F.expr(f"transform(sequence(1, size({STEPS}) - 1), i -> array_join(slice({STEPS}, 1, i), '/'))")
    ups = all_leaves.filter(F.expr(f"size({STEPS}) > 1")).select("repo_id", "path", F.explode(above).alias("node"))
    below_shared = ups.join(shared_dir, ["repo_id", "node"], "left_semi").select("repo_id", "path")
    copies = shared_leaf.unionByName(below_shared).distinct().withColumn("copied", F.lit(True))
    return all_leaves.join(copies, ["repo_id", "path"], "left").select(
        "repo_id", "path", F.coalesce("says", F.when(F.col("copied"), F.lit("vendored"))).alias("reason")
    )


def found(files: DataFrame) -> DataFrame:
    """(repo_id, path) of files that nobody wrote by hand for their repository."""
    return classify(files).filter(F.col("reason").isNotNull()).select("repo_id", "path").distinct()
