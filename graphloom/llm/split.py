"""Splitting oversized items at natural boundaries (problem 6), without loading whole files.

1. A map over byte ranges of the files (with a halo of a few bytes), in the stage that scans them, emits the table of
   boundaries: where a cut may lie, by kind, as 2-byte places in the range.  A lesser kind is listed only where the
   kinds above it leave more than a piece's room, so the table is a small fraction of the bytes.
2. The tables of a file's ranges are stitched in order, its items stream past them, and every item is walked: a piece
   ends at the best boundary within `limit` of its start, the next one starts `overlap` before that.

The best boundary is the last blank line in the second half of the piece, else its last line end, sentence or statement
end, white space, or any character.  A boundary inside the overlap with the piece before does not count: a piece that
ended there would not go beyond that piece.  Tables and items are shuffled once, contents never; a task holds the tables
of one file at a time, and none of its items.

Defined results: null, swapped or negative spans, spans beyond the content and items of at most `limit` bytes give
no piece; repeated rows count once; of several versions of a file the latest with content holds; CRLF is not
split; bytes that are no UTF-8 may be cut anywhere, characters are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.tables import cut

RANGE = 65_536


HALO = 4
KINDS = ("blank", "line", "sentence", "space")


def _beyond(lesser: np.ndarray, better: np.ndarray, room: int, first: int, last: int) -> np.ndarray:
    """The lesser boundaries in stretches of `room` or more without a better one; stretches at an edge count as long."""
    edges = np.concatenate([[first - room], better, [last + room]])
    at = np.searchsorted(edges, lesser, "right")
    return lesser[edges[np.minimum(at, len(edges) - 1)] - edges[at - 1] >= room]


def boundaries(data: bytes, first: int, last: int, room: int) -> dict[str, np.ndarray]:
    """Where data may be cut in (first, last], as numbers of bytes on the left, by kind; `inner`: where it must not be."""
    x = np.frombuffer(data, np.uint8)
    before = np.concatenate([np.zeros(HALO, np.uint8), x])  # before[p + HALO - i]: byte p - i

    def back(i: int) -> np.ndarray:
        return before[first + 1 + HALO - i : last + 1 + HALO - i]

    b1, b2, b3 = back(1), back(2), back(3)
    nl = b1 == 10
    blank = nl & ((b2 == 10) | (b2 == 13) & (b3 == 10))
    sentence = (b1 == 32) & np.isin(b2, np.frombuffer(b";}.!?:,", np.uint8))
    for mark in "。！？；":
        c3, c2, c1 = mark.encode()
        sentence |= (b1 == c1) & (b2 == c2) & (b3 == c3)
    here = np.arange(first + 1, last + 1)
    out = {"blank": here[blank], "line": here[nl]}
    out["sentence"] = _beyond(here[sentence], out["line"], room, first, last)
    better = np.union1d(out["line"], out["sentence"])
    out["space"] = _beyond(here[(b1 == 32) | (b1 == 9)], better, room, first, last)
    after = np.concatenate([x, [0]])[first + 1 : last + 1]
    out["inner"] = here[(after & 0xC0 == 0x80) | (b1 == 13) & (after == 10)]
    return out


def char_start(inner: np.ndarray, at: int) -> int:
    """The position at or up to 3 bytes before `at` at which no character and no CRLF is cut."""
    for p in range(at, at - 4, -1):
        i = np.searchsorted(inner, p)
        if i == len(inner) or inner[i] != p:
            return p
    return at


def packed(places: np.ndarray, first: int) -> bytes:
    """Places in (first, first + RANGE] in two bytes each; many of them as one bit for each byte of the range."""
    if 16 * len(places) <= RANGE:
        return (places - first - 1).astype(np.uint16).tobytes()
    bits = np.zeros(RANGE, bool)
    bits[places - first - 1] = True
    return np.packbits(bits).tobytes() + b"\0"  # an odd length tells it from the other form


def unpacked(data: bytes, first: int) -> np.ndarray:
    places = np.flatnonzero(np.unpackbits(np.frombuffer(data[:-1], np.uint8))) if len(data) % 2 else np.frombuffer(data, np.uint16)
    return places.astype(np.int32) + first + 1


def walk(marks: dict[str, np.ndarray], start: int, end: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of an item."""
    out = []
    while end - start > limit:
        least, most = start + overlap + 4, start + limit
        for kind, first in zip(KINDS, (max(least, start + limit // 2), least, least, least), strict=True):
            i = np.searchsorted(marks[kind], most, "right")
            if i and marks[kind][i - 1] >= first:
                cut = int(marks[kind][i - 1])
                break
        else:
            cut = char_start(marks["inner"], most)
        out.append((start, cut))
        start = char_start(marks["inner"], cut - overlap)
    return [*out, (start, end)]


def ranges(files: DataFrame, halo: int, after: int = 0) -> DataFrame:
    """(repo_id, path, at, version, range_no, from_byte, bytes, n_bytes): byte ranges with a halo on either side, of all contents."""
    there = files.filter(F.col("raw_content").isNotNull() & F.col("repo_id").isNotNull() & F.col("path").isNotNull())
    kept = there.select("repo_id", "path", F.coalesce("indexed_at", F.lit(-1)).alias("at"), F.xxhash64("raw_content").alias("version"), F.octet_length("raw_content").alias("n_bytes"), "raw_content")
    numbered = kept.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"cast(greatest(n_bytes - 1, 0) div {RANGE} as int)"))).alias("range_no"))
    start = F.greatest(F.lit(0), F.col("range_no") * RANGE - halo)
    return numbered.select(
        "repo_id", "path", "at", "version", "range_no", "n_bytes", start.alias("from_byte"),
        F.substring("raw_content", start + 1, (F.col("range_no") + 1) * RANGE + after - start).alias("bytes"),
    )


def oversized(symbols: DataFrame, limit: int) -> DataFrame:
    wide = symbols.select("id", "repo_id", F.col("file_path").alias("path"), "start_byte", "end_byte")
    return wide.filter((F.col("start_byte") >= 0) & (F.col("end_byte").cast("long") - F.col("start_byte") > limit)).dropDuplicates()


def pieces(symbols: DataFrame, files: DataFrame, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """(id, piece_no, start_byte, end_byte) of every item longer than `limit`; byte offsets into the file."""
    room = limit - overlap - 8
    if overlap < 0 or room < 8:
        raise ValueError("the overlap leaves no room for a piece")
    wide = oversized(symbols, limit)
    lists = [*KINDS, "inner"]

    @F.pandas_udf(", ".join(f"{k} binary" for k in lists).join(["struct<", ">"]).replace(" binary", ":binary"))
    def table(data: pd.Series, from_byte: pd.Series, range_no: pd.Series) -> pd.DataFrame:
        rows = []
        for d, at, no in zip(data, from_byte, range_no, strict=True):
            found_ = boundaries(bytes(d), no * RANGE - at, min((no + 1) * RANGE - at, len(d)), room)
            rows.append([packed(found_[k] + at, no * RANGE) for k in lists])
        return pd.DataFrame(rows, columns=lists)

    tables = ranges(files, HALO, 1).select("repo_id", "path", F.lit(0).alias("kind"), "at", "version", "range_no", "n_bytes", table("bytes", "from_byte", "range_no").alias("t"))
    items = wide.filter(F.col("repo_id").isNotNull() & F.col("path").isNotNull()).select("repo_id", "path", F.lit(1).alias("kind"), "id", "start_byte", "end_byte")
    met = tables.select("repo_id", "path", "kind", "at", "version", "range_no", "n_bytes", "t.*").unionByName(items, allowMissingColumns=True)
    # the tables of the latest content come first, then the items
    order = ["repo_id", "path", "kind", F.desc("at"), "version", "range_no"]
    met = met.repartition("repo_id", "path").sortWithinPartitions(*order)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "repo_id", "path", "piece_no", "start_byte", "end_byte"]
        types = [pa.string()] * 3 + [pa.int32()] * 3
        out: list[tuple] = []
        key, version, size, seen, marks, whole = None, None, 0, -1, {k: [] for k in lists}, None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            out.clear()
            return batch

        for batch in batches:
            for r in batch.to_pylist():
                if (r["repo_id"], r["path"]) != key:
                    key, version, size, seen, marks, whole = (r["repo_id"], r["path"]), None, 0, -1, {k: [] for k in lists}, None
                if r["kind"] == 0:
                    if version in (None, (r["at"], r["version"])) and r["range_no"] > seen:  # one content, each range once
                        version, size, seen = (r["at"], r["version"]), r["n_bytes"], r["range_no"]
                        for k in lists:
                            marks[k].append((r[k], r["range_no"] * RANGE))
                elif r["end_byte"] <= size:
                    if whole is None:
                        whole = {k: np.concatenate([unpacked(*part) for part in v]) for k, v in marks.items()}
                    out.extend((r["id"], *key, n, *piece) for n, piece in enumerate(walk(whole, r["start_byte"], r["end_byte"], limit, overlap)))
                    if len(out) >= 10_000:
                        yield flush()
        yield flush()

    return met.mapInArrow(walked, "id string, repo_id string, path string, piece_no int, start_byte int, end_byte int")


#: Keys of files that may be broadcast to the scan, of 8 bytes each; beyond, contents meet their pieces in a shuffle.
MOST_KEYS = 2_000_000


def emit(symbols: DataFrame, files: DataFrame, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """`pieces` with their bytes, read by offset from the ranges: (id, repo_id, path, piece_no, start_byte, end_byte, content)."""
    pieces_ = cut(pieces(symbols, files, limit, overlap))
    at = pieces_.withColumn("range_no", F.expr(f"cast((end_byte - 1) div {RANGE} as int)"))
    key = F.xxhash64("repo_id", "path", "range_no").alias("key")
    keys = at.select(key).distinct()
    there = ranges(files, limit).withColumn("key", key)
    if keys.count() <= MOST_KEYS:
        there = there.join(F.broadcast(keys), "key", "left_semi")  # checked
    latest = there.groupBy("repo_id", "path").agg(F.max(F.struct("at", F.bitwise_not("version").alias("other"))).alias("latest"))
    first = there.join(latest, ["repo_id", "path"]).filter((F.col("at") == F.col("latest.at")) & (F.bitwise_not("version") == F.col("latest.other")))
    once = first.drop("latest", "key").dropDuplicates(["repo_id", "path", "range_no"])
    return at.join(once, ["repo_id", "path", "range_no"]).select(
        "id", "repo_id", "path", "piece_no", "start_byte", "end_byte",
        F.substring("bytes", F.col("start_byte") - F.col("from_byte") + 1, F.col("end_byte") - F.col("start_byte")).alias("content"),
    )


def found(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id) of the items that come out in pieces."""
    return pieces(symbols, files).select("id").distinct()
