"""Functions paired with their documentation (problem 4).

Every function of a file competes for the file's comments.  Edges of the bipartite graph join a comment to its own
function (distance 0) and to functions of the same file whose name it begins with or whose parameters its tags name;
their weight adds evidence from names, tags and distance.  A comment and a function that no other edge touches are
matched at once, without a shuffle; the rest of the graph is settled in rounds of mutual best choices until no edge is
left: a comment takes its best function and a function its best comment, and what is taken leaves the graph.  Links
with contradicting tags are implausible and no edges; comments that say nothing beyond the signature are no candidates.

Defined results: null or blank signatures and summaries give no pair; repeated rows count once, and of several
informative comments of one id the smallest holds; a function has at most one description; kinds other than `function`
and `method` are left out; any language counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.sources.tables import cut, spread

#: Stray comments that may be broadcast to the functions of their files; beyond, both are shuffled.
MOST_STRAYS = 200_000

MARKS = re.compile(r'^\s*(?:/\*+!?|\*+/|\*(?!\S*\*$)|//[/!]*|#+!?(?=\s|$)|"""|\'\'\'|<!--|--(?=\s)|;+(?=\s)|%+(?=\s))\s?|\s*(?:\*+/|"""|\'\'\'|-->)\s*$')
TAG = re.compile(r"^\s*(?:[@\\](?:param|arg|argument|returns?|throws?|raises?|exception|type|rtype|tparam|property)\b|:(?:param|type|returns?|rtype|raises?)\b[^:]*:?|(?:args|arguments|params|parameters|returns?|raises|throws|yields?)\s*:\s*$)", re.I)
TAG_NAME = re.compile(r"^\s*(?:[@\\](?:param|arg|argument)|:param)\s+(?:\{[^}]*\}\s*)?\[?(?:[\w.<>\[\]]+\s+(?=\w+:))?(\w+)", re.I)
#: Beginnings of lines that stand in for text still to be written.
STAND_IN = re.compile(
    r"^\W*(?:todo|to do|fixme|xxx|tbd|tba|wip|hack|undocumented|not documented|no (?:description|docs?|documentation|comment|summary)|(?:missing|needs?|add|write|insert|fill in) (?:the )?(?:a )?(?:docs?|description|documentation|docstring|comments?|summary|me)|"
    r"(?:description|docs?|documentation|docstring|summary|comment)(?: (?:goes|comes) here| here| pending| missing| to follow| follows)?|(?:auto[- ]?|automatically )?(?:generated|default|sample|example) (?:by .*|docstring|documentation|docs?|comment|description|javadoc|(?:method|function|constructor|catch|code)(?: (?:stub|block|body|comment))?)|placeholder(?: (?:text|comment|doc\w*|description))?|lorem ipsum.*|stub|n/?a|none|null|empty|coming soon|work in progress|to be (?:documented|written|done|completed|added)|your (?:description|docs?).*|dummy|"
    r"待补充|待完善|待办|待定|待写|暂无.*|无|未完成|未记录|描述|说明|なし|未記入|説明なし|後で書く|todo\b.*|pendiente.*|por (?:hacer|documentar|completar)|sin (?:descripción|documentar)|documentación pendiente|à (?:compléter|faire|documenter|remplir)|a completer|sans description|noch (?:zu )?(?:dokumentieren|offen|schreiben|nicht dokumentiert)|fehlt noch|folgt|beschreibung (?:folgt|fehlt)|keine beschreibung|da (?:completare|fare)|a fazer|不明|作成中|작성 예정|설명 없음|описание отсутствует)\W*$",
    re.I,
)
TODO_LINE = re.compile(r"^\W*(?:todo|fixme|xxx|hack|tbd|wip)\b", re.I)
#: Lines that only point elsewhere.
POINTER = re.compile(
    r"^\W*(?:(?:please )?(?:see|cf\.?|c\.f\.|refer to|check|look at|read|ref|refs|reference|consult|siehe|vgl\.?|voir|cf|ver|véase|vea|参见|参见上文|见|参考|參見|同上|見)(?:[: ]|(?=\W*$))|(?:same )?as above|same as (?:above|below|before)|ditto|idem|dito|(?:see )?(?:above|below)|link|inherit(?:ed|s)?(?: from)?|overrid(?:es|den)|implements?|上記参照|同上|見上文|见上文|参照)", re.I
)
#: A line that is one sentence and sends its reader elsewhere, whatever it adds about the place.
SENDS = re.compile(r"^\W*(?:please )?(?:see also|see|cf\.?|refer to|check|consult|siehe(?: auch)?|voir(?: aussi)?|véase(?: también)?|ver también) (?:(?:the|die|den|das|la|le|el) )?[^\s.;]*[A-Za-z0-9][_./#:(][^\s;]*(?: [^.;!?]*)?[.!]?\W*$", re.I)
MARKER = re.compile(
    r"^\W*(?:nolint|pylint|eslint|tslint|jshint|jscs|prettier|noqa|noinspection|suppresswarnings|type:\s*ignore|mypy|flake8|ruff|pragma|istanbul|c8 ignore|v8 ignore|ts-(?:ignore|expect-error|nocheck)|go:|\+build|region|endregion|mark:|coding[:=]|vim:|sourcemappingurl|spdx|copyright|license|codecov|coverage|gosec|nosec|nosonar|checkstyle|clang-format|fmt:|yapf|isort|black|skipcq|rubocop|shellcheck|section|begin|end)\b.*$|"
    r"^\W*\{?@(?:internal|inheritdoc|override|deprecated|private|public|protected|package|api|hidden|ignore|see\b.*|since\b.*|version\b.*|author\b.*|link\b.*|example|todo\b.*|static|final|readonly|beta|alpha|experimental|generated|nullable|nonnull|test|async|class|constructor|module|memberof\b.*|function|method|name\b.*|suppress\w*\b.*)\}?\W*$|^\W*(?:deprecated|internal|private|public|override|overridden|generated)\W*$",
    re.I,
)
CODE = re.compile(
    r"^\s*(?:[\w.$\[\]]+\s*(?:[-+*/%|&^]|<<|>>|\?\?)?:?=(?!=)\s*\S.*|[\w.$]+\([^()]*(?:\([^()]*\)[^()]*)*\)\s*;?|(?:return|await|yield|throw|raise|assert|del|goto|defer|go)\b[^.]*[;)\]]\s*;?|.*[;{}]|"
    r"(?:if|for|while|switch|elif|else|try|catch|except|with)\b.*[:{})]\s*|(?:export |default |public |private |protected |static |final |async |abstract |override |virtual |inline |const )*(?:def|func|function|fn|fun|sub|void|class)\b.*[)>\]:\w]\s*|(?:import|from|require|include|using|package)\b[^.]*|@\w+(?:\(.*\))?|\w+\[[^\]]*\](?:\s*=.*)?|(?:const|let|var|val)\s+\w+.*|\w+(?:\+\+|--)|(?:return|break|continue|pass)(?: [\w.\[\]]+)?|for \w+ in [\w.()\[\]]+: ?\S.*|(?:while|if|elif) [\w.()\[\] !<>=]+: ?(?:pass|break|continue|return)\b.*)\s*$"
)
#: Words that add nothing to a name.
GENERIC = frozenset(
    """a an the this that these those of to for in on at by with from into and or as is are be it its does do done doing perform performs performing given
    function functions method methods func helper helpers utility util utils routine procedure subroutine implementation implements implement member operation op callback lambda
    return returns returned returning result results value values output outputs input inputs take takes taking argument arguments arg args parameter parameters param params
    get gets set sets getter setter constructor ctor main wrapper method's simple simply basic generic default some any all new instance object type types int integer string str bool boolean
    number float double list map dict array any void none null self class which used use uses using handle handles handling call calls called one two three four five six seven eight nine ten zero no
    internal internally default auto generated stub docstring comment private public only just own actual code logic stuff thing things work magic business
    see note description summary name named our my we you your here where when will can should
    look looks count counts inspect inspects process processes compute computes execute executes run runs also object item items data information info input something
    die der das den dem ein eine einer eines für von zu und funktion methode hilfsfunktion el la los las un una de del para y función método le les une des du pour et fonction méthode""".split()
)
SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+|\d+")
WIDE = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯]")


FIRST_WORD = re.compile(r"\W*([A-Za-z_]\w*)")


def stem(word: str) -> str:
    """A rough stem: English plural, third person, -ing and -ed; the final e goes."""
    w = word.lower()
    while len(w) > 3 and w.endswith("s"):
        w = w[:-1]
    for end in ("ing", "ed"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    if len(w) > 3 and w.endswith("e"):
        w = w[:-1]
    return w[:-1] + "y" if len(w) > 3 and w.endswith("i") else w


FLAT = GENERIC | {stem(g) for g in GENERIC}


def parts(text: str) -> set[str]:
    return {stem(w) for w in SPLIT.findall(text)}


def bare(text: str) -> list[str]:
    """Lines without comment marks."""
    out = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        before = None
        while before != line:
            before, line = line, MARKS.sub("", line)
        out.append(line.strip())
    return [x for x in out if x]


def squeezed(text: str) -> str:
    return re.sub(r"[\W_]+", "", text).lower()


def describe(name: str | None, signature: str, summary: str) -> tuple[str | None, list[str]]:
    """The description in a summary, null if it is trivial; and the parameters its tags name."""
    lines = bare(summary)
    tags = [m[1] for x in lines if (m := TAG_NAME.match(x))]
    text, tagged = [], []
    in_tags = False
    for x in lines:
        if TAG.match(x):
            in_tags = True
            tagged.append(x)
        elif STAND_IN.match(x) or TODO_LINE.match(x) or MARKER.match(x) or not re.search(r"[^\W_]", x):
            continue
        elif in_tags and not re.match(r"[A-Z]", x):
            tagged.append(x)
        else:
            text.append(x)
    known = parts(name or "") | parts(signature)
    signature_flat = squeezed(signature)
    good = []
    for x in text:
        words = re.findall(r"[^\W\d_]+", x)
        wide = len(WIDE.findall(x))
        if CODE.match(x) or squeezed(x) == signature_flat or len(squeezed(x)) > 12 and squeezed(x) in signature_flat:
            continue
        if POINTER.match(x) and (len(words) <= 5 or re.search(r"#\d+|://|[A-Z]{2,}-\d+", x) and len(words) <= 7) and wide < 8:
            continue
        if SENDS.match(x):
            continue
        if re.fullmatch(r"\W*(?:https?://\S+|#?\d+|[A-Z]{2,}-\d+)\W*", x):
            continue
        left = parts(re.sub(r"\b\w+://\S+", "", x)) - known - FLAT
        left = {w for w in left if not w.isdigit() and (len(w) > 1 or WIDE.match(w))}
        if wide:
            left = {w for w in left if len(w) >= 2}
        if left and (wide >= 4 or len(words) >= 2 and sum(map(len, left)) >= 3):
            good.append(x)
    if not good:
        for x in tagged:
            rest = parts(TAG.sub("", TAG_NAME.sub("", x))) - known - FLAT
            if len({w for w in rest if len(w) > 2}) >= 3:
                good.append(x)
    return ("\n".join(good) if good else None), tags


def candidates(symbols: DataFrame, texts: bool = True) -> DataFrame:
    """(id, repo_id, file_path, name, start_byte, signature, description, word, fits, named): one informative comment of
    every symbol that has one.

    fits: the share of the tags that the symbol's own signature holds; word: the word that a stray comment begins with,
    one whose tags name no parameter of its own symbol and whose text does not name it; null for all others.
    """
    kept = (
        symbols.filter(F.col("kind").isin("function", "method") & (F.length(F.trim("signature")) > 0) & F.col("id").isNotNull() & (F.length(F.trim("summary")) > 0))
        .select("id", "repo_id", "file_path", "name", "start_byte", "signature", "summary")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, signatures, summaries = (batch.column(i).to_pylist() for i in (3, 5, 6))
            at, rows = [], []
            for i, (name, signature, summary) in enumerate(zip(names, signatures, summaries, strict=True)):
                description, tags = describe(name, signature, summary)
                if description is None:
                    continue
                own = sum(t in signature for t in tags)
                first = FIRST_WORD.match(description)
                stray = tags and not own and name is not None and name not in description and first and len(first[1]) > 3
                at.append(i)
                rows.append((description if texts or stray else None, first[1].lower() if stray else None, own / len(tags) if tags else 0.0, bool(name and len(name) > 3 and description.lower().startswith(name.lower())), tags if stray else None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.list_(pa.string())]
            kept_ = [batch.column(i).take(pa.array(at, pa.int64())) for i in (range(6) if texts else range(5))]
            yield pa.RecordBatch.from_arrays([*kept_, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], schema)

    schema = ["id", "repo_id", "file_path", "name", "start_byte", *(["signature"] if texts else []), "description", "word", "fits", "named", "tags"]
    types = dict(kept.dtypes) | {"description": "string", "word": "string", "fits": "double", "named": "boolean", "tags": "array<string>"}
    found_ = spread(kept).mapInArrow(read, ", ".join(f"{c} {types[c]}" for c in schema))
    rest = [c for c in schema if c not in ("id", "description")]
    return found_.groupBy("id").agg(F.min(F.struct("description", *rest)).alias("c")).select("id", "c.*")


def pairs(symbols: DataFrame, texts: bool = True) -> DataFrame:
    """(id, signature, description, score): each function with the comment that the assignment gives it; without `texts`
    only (id, score)."""
    comments = cut(candidates(symbols, texts))
    named = lambda c: F.when(c, 1.0).otherwise(0.0)
    own = comments.withColumn("score", 3.0 + F.col("fits") + named(F.col("named")))
    # a comment that begins with the name of another function of its file, and whose tags name none of its own parameters
    stray = comments.filter(F.col("word").isNotNull()).select("id", "repo_id", "file_path", "word", "tags", "description", F.col("start_byte").alias("at"))
    functions = (
        symbols.filter(F.col("kind").isin("function", "method") & (F.length(F.trim("signature")) > 0) & F.col("id").isNotNull())
        .select("repo_id", "file_path", F.lower("name").alias("word"), F.col("id").alias("fid"), F.col("signature").alias("fsig"), "start_byte")
    )
    near = F.broadcast(stray) if stray.count() <= MOST_STRAYS else stray  # checked
    fits = F.when(F.size("tags") == 0, 0.0).otherwise(F.expr("size(filter(tags, t -> instr(fsig, t) > 0)) / size(tags)"))
    far = F.least(F.coalesce(F.abs(F.col("at") - F.col("start_byte")), F.lit(0)) / 100_000.0, F.lit(0.5))
    other = cut(
        functions.join(near, ["repo_id", "file_path", "word"]).filter(F.col("id") != F.col("fid"))
        .groupBy("id", "fid").agg(F.max(1.5 + fits + named(F.expr("startswith(lower(description), word)")) - far).alias("score"))
    )
    touched = other.select(F.explode(F.array("id", "fid")).alias("id")).distinct()
    free = own.join(touched, "id", "left_anti")
    edges = cut(own.join(touched, "id", "left_semi").select("id", F.col("id").alias("fid"), "score").unionByName(other))
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        by_comment = W.partitionBy("id").orderBy(F.desc("score"), "fid")
        by_function = W.partitionBy("fid").orderBy(F.desc("score"), "id")
        # the best edge of all is the first choice of both its ends, so every round takes some
        best = cut(
            edges.withColumn("c", F.row_number().over(by_comment)).withColumn("f", F.row_number().over(by_function))
            .filter("c = 1 and f = 1").select("id", "fid", "score")
        )
        rounds.append(best)
        edges = cut(edges.join(best.select("id"), "id", "left_anti").join(best.select("fid"), "fid", "left_anti").select("id", "fid", "score"))
    if not texts:
        out = free.select("id", "score")
        for r in rounds:
            out = out.unionByName(r.select(F.col("fid").alias("id"), "score"))
        return out
    out = free.select("id", "signature", "description", "score")
    for r in rounds:
        settled = r.join(comments.select("id", "description"), "id").join(functions.select("fid", "fsig").dropDuplicates(["fid"]), "fid")
        out = out.unionByName(settled.select(F.col("fid").alias("id"), F.col("fsig").alias("signature"), "description", "score"))
    return out


def found(symbols: DataFrame) -> DataFrame:
    """(id) of functions and methods that come out as a pair."""
    return pairs(symbols, texts=False).select("id").distinct()
