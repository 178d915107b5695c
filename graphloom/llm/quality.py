"""Per-document text quality statistics, and whether a document is natural prose (problem 10).

Documents are split into chunks of a fixed number of characters (most have one); each chunk yields partial counts over
its complete lines, how prose flows through these lines, and the two fragments at its ends (the boundary state).  States
are associative: a merge joins the right fragment of one chunk with the left fragment of the next, counts the lines that
close, and adds the rest, so that the size of the chunks changes no result.  States of huge documents are merged in a
tree of fan-in `RUN`; a document of one chunk is closed in the map.

Prose is decided line by line.  A line is part of a running sentence when it has enough words, most of it is letters
and blanks, and function words hold it together (common words of any of the given languages, or else short words, as
every language has them); in scripts without spaces, when those letters and sentence marks make up the line.  A short
line goes with the line before it if that one is prose and ends in mid-sentence.

Defined results: null text gives null statistics, empty and blank text zeros, and neither is ever flagged; repeated
`doc_id`s are separate documents; \r\n and \r end a line like \n; HTML entities count as the character they stand for.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.tables import spread

CHUNK = 65_536
RUN = 64

WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
#: Letters of scripts that are written without spaces between words.
UNSPACED = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿฀-๿຀-໿က-႟ក-៿]")
SENTENCE_END = re.compile(r"[.!?…。！？؟।:;,)\"'»”’]*[.!?…。！？؟।][\"'»”’)\]]*\s*$")
LINE_PUNCT = re.compile(r"[.!?…。！？；;:,，、؟।][\"'»”’)\]]*$")
CODE_MARK = re.compile(r"[{};]\s*$|^\s*(?:def |class |import |from \S+ import |return\b|if .*:\s*$|for .*[:{]\s*$|func |const |let |var |public |private |package |#include|\$ |>>> |@@ |diff --git|at \S+\()|[=!<>]=|=>|->|::|\w\(\w*\)|\w+\.\w+\(|\" ?: ?[\[{\"\d]")
LEAD = re.compile(r"^\s*(?:>\s*)*(?:[-*+•]\s+|\d{1,3}[.)]\s+|#{1,6}\s+)?")

COUNTS = ["chars", "words", "word_chars", "symbols", "spaces", "lines", "punct_lines", "common", "prose_chars", "solid_chars"]
ODD = re.compile(r"[^\w\s.,;:!?'\"’‘“”«»()\-–—…¿¡`。，！？、；：（）「」『』《》]|_")
SYMBOL = re.compile(r"[^\w\s]|_")
DIGIT = re.compile(r"\d")
AROUND = ".,;:!?'\"’‘“”«»()–—…¿¡`*_"
#: ASCII characters that SYMBOL and ODD match; deleting them is faster than finding them.
ASCII_SYMBOL = {i: None for i in range(128) if SYMBOL.match(chr(i))}
ASCII_ODD = {i: None for i in range(128) if ODD.match(chr(i))}
NO, MAYBE, PROSE = 0, 1, 2
SOLID = COUNTS.index("solid_chars")
LINE_END = re.compile(r"\r\n?")


def line_counts(line: str, common: frozenset) -> tuple[list[int], int, bool]:
    """Counts of one line (without prose_chars); whether it may be or is prose; whether its sentence ends with it."""
    text = html.unescape(line) if "&" in line else line
    bare = text.strip()
    if not bare:
        return [len(text), 0, 0, 0, len(text), 0, 0, 0, 0, 0], NO, True
    body = bare[LEAD.match(bare).end() :] or bare
    ascii_ = bare.isascii()
    tokens = WORD.findall(body)
    unspaced = len(UNSPACED.findall(body)) if not ascii_ else 0
    sizes = list(map(len, tokens))
    letters = sum(sizes)
    parts = body.split()
    solid = sum(map(len, parts))
    odd = len(body) - len(body.translate(ASCII_ODD)) if ascii_ else len(ODD.findall(body))
    ends = bool(SENTENCE_END.search(bare))
    hits = sum(map(common.__contains__, map(str.lower, tokens)))
    kind = NO
    if unspaced * 2 >= max(1, letters):
        words = sum(1 for t in tokens if not UNSPACED.search(t)) + max(1, unspaced // 2)
        hits += sum(body.count(w) for w in common if UNSPACED.match(w))
        marks = len(re.findall(r"[，。！？；：]", body))
        if unspaced >= 6 and odd <= 0.1 * solid + 1 and (body.count("、") + body.count(",")) * 4 <= unspaced:
            kind = PROSE if marks or ends else MAYBE
    else:
        words = len(tokens)
        wordlike = sum([w.isalpha() or (x := w.strip(AROUND)).isalpha() or WORD.fullmatch(x) is not None or w[0] == "`" and x.isidentifier() for w in parts])
        n = len(parts)
        commas = body.count(",") + body.count("|") + body.count(";")
        if (
            wordlike >= 0.7 * n
            and odd <= 0.06 * solid + 1
            and commas * 3 <= n + 2
            and len({*map(str.lower, parts)}) * 10 >= min(n, 30) * 3
            and not bare.startswith(("//", "/*", '"""', "<"))
            and not CODE_MARK.search(re.sub(r"`[^`]*`", "x", body) if "`" in body else body)
        ):
            short = sum([n_ <= 3 for n_ in sizes])
            glue = hits + 0.4 * short
            if n >= 4 and hits >= 1 and glue >= 0.2 * n or n >= 8 and glue >= 0.25 * n and hits:
                kind = PROSE
            elif n >= 4 and ends and body[0].isupper() | (not body[0].isascii()):
                kind = PROSE
            elif n >= 5 and glue >= 0.15 * n or n < 5 and n >= 1:
                kind = MAYBE
            elif n >= 5:
                kind = MAYBE if hits or short else NO
    counts = [len(text), words, letters, len(bare) - len(bare.translate(ASCII_SYMBOL)) if ascii_ else len(SYMBOL.findall(bare)), len(text) - solid, 1, int(bool(LINE_PUNCT.search(bare))), hits, 0, len("".join(bare.split()))]
    return counts, kind, ends


#: A block of lines as a function of what lies before it.  Before it either a prose line goes on (T), or not (F), then
#: with some characters pending in lines that may be prose.  [T: prose characters added, whether the block ends in prose
#: that goes on, characters pending at its end; F: the same, whether the block claims what was pending, whether it
#: leaves it pending]
T_PROSE, T_ON, T_PENDING, F_PROSE, F_ON, F_PENDING, F_CLAIMS, F_PASSES = range(8)
UNMOVED = [0, 1, 0, 0, 0, 0, 0, 1]


def then(x: list[int], y: list[int]) -> list[int]:
    """The flow of two blocks of lines one after the other; associative."""
    if x[T_ON]:
        t = y[:3]
    else:
        t = [y[F_PROSE] + x[T_PENDING] * y[F_CLAIMS], y[F_ON], y[F_PENDING] + x[T_PENDING] * y[F_PASSES]]
    if x[F_ON]:
        f = [*y[:3], x[F_CLAIMS], 0]
    else:
        f = [y[F_PROSE] + x[F_PENDING] * y[F_CLAIMS], y[F_ON], y[F_PENDING] + x[F_PENDING] * y[F_PASSES], x[F_CLAIMS] | x[F_PASSES] & y[F_CLAIMS], x[F_PASSES] & y[F_PASSES]]
    return [x[T_PROSE] + t[0], *t[1:], x[F_PROSE] + f[0], *f[1:]]


def block_counts(lines: list[str], common: frozenset) -> list[int]:
    """COUNTS of whole lines, and their flow.

    A line that may be prose is, if a neighbour without a blank line between is: the line before goes on in it, or it
    goes on in the line after.
    """
    if not lines:
        return [0] * len(COUNTS) + UNMOVED
    rows = []
    t_prose, t_on, t_pending = 0, 1, 0
    f_prose, f_on, f_pending, claims, passes = 0, 0, 0, 0, 1
    for line in lines:
        c, kind, ends = line_counts(line, common)
        rows.append(c)
        on, size = int(not ends), c[SOLID]
        if kind == PROSE:
            t_prose, t_on, t_pending = t_prose + size + t_pending, on, 0
            f_prose, f_on, f_pending, claims, passes = f_prose + size + f_pending, on, 0, claims | passes, 0
        elif kind == MAYBE:
            if t_on:
                t_prose, t_on = t_prose + size, on
            else:
                t_pending = (t_pending + size) * on
            if f_on:
                f_prose, f_on = f_prose + size, on
            else:
                f_pending, passes = (f_pending + size) * on, passes & on
        else:
            t_on = t_pending = f_on = f_pending = passes = 0
    return [*map(sum, zip(*rows, strict=True)), t_prose, t_on, t_pending, f_prose, f_on, f_pending, claims, passes]


def joined(a: list[int], b: list[int]) -> list[int]:
    """The counts of two neighbouring blocks of lines as those of one."""
    n = len(COUNTS)
    return [x + y for x, y in zip(a[:n], b[:n], strict=True)] + then(a[n:], b[n:])


def boundary_state(chunk: str, common: frozenset) -> dict:
    """Counts of the lines that lie whole in the chunk, and its fragments.  broken: the chunk holds a line end."""
    lines = chunk.split("\n")
    if len(lines) == 1:
        return {"counts": block_counts([], common), "head": chunk, "tail": None, "broken": False}
    return {"counts": block_counts(lines[1:-1], common), "head": lines[0], "tail": lines[-1], "broken": True}


def join_states(states: list[dict], common: frozenset) -> dict:
    """Neighbouring states as one; associative.  A line that spans many of them is put together once."""
    counts, head, open_ = None, [], []
    for s in states:
        (head if counts is None else open_).append(s["head"])
        if not s["broken"]:
            continue
        if counts is None:
            counts = list(s["counts"])
        else:
            counts = joined(joined(counts, block_counts(["".join(open_)], common)), list(s["counts"]))
        open_ = [s["tail"]]
    if counts is None:
        return {"counts": block_counts([], common), "head": "".join(head), "tail": None, "broken": False}
    return {"counts": counts, "head": "".join(head), "tail": "".join(open_), "broken": True}


def closed(state: dict, common: frozenset) -> list[int]:
    """COUNTS of a text whose chunks were joined to `state`."""
    first = block_counts([state["head"]], common)
    counts = joined(joined(first, list(state["counts"])), block_counts([state["tail"]], common)) if state["broken"] else first
    n = len(COUNTS)
    return [*counts[: n - 2], counts[n + F_PROSE], counts[n - 1]]


def text_counts(text: str, common: frozenset) -> list[int]:
    """COUNTS of a text of one chunk."""
    return closed(boundary_state(LINE_END.sub("\n", text) if "\r" in text else text, common), common)


def statistics(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the statistics, and is_prose."""
    # a fixed vocabulary of function words (about a hundred rows); its size is checked before it is sent along
    rows = common_words.select(F.lower("word").alias("w")).dropna().distinct().limit(20_001).collect()
    if len(rows) > 20_000:
        raise ValueError("common_words is a list of function words; more than 20,000 are none")
    common = frozenset(r.w for r in rows)

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = kept.withColumn("row", F.monotonically_increasing_id())
    small = keyed.filter(F.coalesce(F.length("text"), F.lit(0)) <= CHUNK)
    large = keyed.filter(F.length("text") > CHUNK)
    id_type = dict(kept.dtypes)["doc_id"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [None if t is None else text_counts(t, common) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "counts"])

    short = spread(small.select("doc_id", "text")).mapInArrow(whole, f"doc_id {id_type}, counts array<bigint>")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(2).to_pylist()):
                text = LINE_END.sub("\n", text)
                for at in range(0, len(text), size * 64):
                    chunks = [text[j : j + size] for j in range(at, min(at + size * 64, len(text)), size)]
                    same = pa.array([i] * len(chunks), pa.int32())
                    numbers = pa.array(range(at // size, at // size + len(chunks)), pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), numbers, pa.array(chunks, pa.string())], ["row", "doc_id", "no", "chunk"])

    size = CHUNK
    chunks = large.select("row", "doc_id", "text").mapInArrow(cut_up, f"row bigint, doc_id {id_type}, no int, chunk string").repartition("row", "no")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [boundary_state(chunk, common) for chunk in pdf["chunk"]]
            yield pd.concat([pdf[["row", "doc_id", "no"]].reset_index(drop=True), pd.DataFrame(out)], axis=1)

    schema = f"row bigint, doc_id {id_type}, no int, counts array<bigint>, head string, tail string, broken boolean"
    states = chunks.mapInPandas(part, schema)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("no")
        state = join_states(rows.to_dict("records"), common)
        return pd.DataFrame([{"row": rows["row"].iloc[0], "doc_id": rows["doc_id"].iloc[0], "no": rows["no"].iloc[0] // RUN, **state}])

    # a text is at most 2 GB, so that many rounds always leave one state of it
    for _ in range(math.ceil(math.log(2**31 / size, RUN))):
        states = states.withColumn("run", F.expr(f"no div {RUN}")).groupBy("row", "run").applyInPandas(lambda p: fold(p.drop(columns=["run"])), schema)

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "counts": [closed(s, common) for s in pdf.to_dict("records")]})

    long = states.mapInPandas(close, f"doc_id {id_type}, counts array<bigint>")
    both = short.unionByName(long)
    c = {name: F.get("counts", F.lit(i)) for i, name in enumerate(COUNTS)}

    def ratio(a: str, b: str) -> F.Column:
        return F.when(c[b] > 0, F.round(c[a] / c[b], 6)).when(c[b] == 0, 0.0)

    solid = c["solid_chars"]
    return both.select(
        "doc_id", c["words"].alias("word_count"), ratio("word_chars", "words").alias("mean_word_length"), ratio("symbols", "solid_chars").alias("symbol_ratio"),
        ratio("punct_lines", "lines").alias("punctuated_line_share"), ratio("common", "words").alias("common_word_share"), c["lines"].alias("line_count"),
        ratio("prose_chars", "solid_chars").alias("prose_share"), F.when(solid > 0, c["prose_chars"] * 2 >= solid).alias("is_prose"),
    )


def found(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id) of documents of which more than half the characters are no running sentences."""
    return statistics(docs, common_words).filter(F.col("is_prose") == F.lit(False)).select("doc_id").distinct()
