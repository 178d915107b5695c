"""Encoding a corpus with a public byte-level BPE vocabulary (problem 8).

Words are cut by the vocabulary's own pattern on the JVM.  Only *distinct* words are encoded: a Spark
higher-order function folds the ranked merges over the array of the word's bytes, looking ranks up in a literal
table that the optimizer folds into one constant (an array of hash buckets, so that a lookup is one index and a
scan of one or two entries).  The encoded words are handed to blocks of documents: a block is a bounded number of
bytes of text, whatever the session's partitions, and its documents stream past its words.

Defined results
---------------
* null, empty text: an empty list of ids.
* repeated `doc_id`s: one row of output per row of input.
* columns beyond the two that are named are ignored, whatever their names.
* decoding concatenates the byte strings of the ids, so `decode(encode(x)) == x` for every text.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the word pattern published with the vocabulary; (?U) gives \s its Unicode meaning on the JVM.
WORD_PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words of more bytes than this are merged with a heap, in O(n log n); the fold is quadratic in a word's length.
FOLD_BYTES = 96

#: Buckets of the literal rank table; prime, a little more than one per entry.
BUCKETS = 65_537


def tokenizer_path(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("GRAPHLOOM_TOKENIZERS", "/opt/tokenizers"), name)


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def _bucket_json(path: str) -> str:
    buckets: list[list[dict]] = [[] for _ in range(BUCKETS)]
    for piece, rank in read_ranks(path).items():
        buckets[zlib.crc32(piece) % BUCKETS].append({"p": base64.b64encode(piece).decode(), "r": rank})
    return json.dumps(buckets, separators=(",", ":"))


def rank_table(path: str) -> Column:
    """The vocabulary as a foldable expression: buckets of (piece, rank)."""
    return F.from_json(F.lit(_bucket_json(path)), "array<array<struct<p:binary,r:int>>>")


def rank_of(table: Column, piece: Column) -> Column:
    """The rank of a byte string, null if it is no piece of the vocabulary."""
    bucket = F.get(table, (F.crc32(piece) % BUCKETS).cast("int"))
    return F.aggregate(bucket, F.lit(None).cast("int"), lambda found, e: F.when(e["p"] == piece, e["r"]).otherwise(found))


def fold_merges(word: Column, table: Column) -> Column:
    """Ids of one word (binary), by folding ranked merges over the array of its bytes.

    A step joins the leftmost pair of the best rank; only the ranks of the pairs on its two sides are looked up anew.
    """
    whole = rank_of(table, word)
    single = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))
    ranks = F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: rank_of(table, F.substring(word, i, F.lit(2))))

    def merged(state: Column, i: Column) -> Column:
        """The state after pieces i and i + 1 (from 1) are joined."""
        pieces, ranks = state["pieces"], state["ranks"]
        piece = F.concat(F.get(pieces, i - 1), F.get(pieces, i))
        none = F.slice(ranks, 1, 0)
        before = F.when(i > 1, F.array(rank_of(table, F.concat(F.get(pieces, i - 2), piece)))).otherwise(none)
        after = F.when(i + 1 < F.size(pieces), F.array(rank_of(table, F.concat(piece, F.get(pieces, i + 1))))).otherwise(none)
        return F.struct(
            F.concat(F.slice(pieces, 1, i - 1), F.array(piece), F.slice(pieces, i + 2, F.size(pieces))).alias("pieces"),
            F.concat(F.slice(ranks, 1, F.greatest(i - 2, F.lit(0))), before, after, F.slice(ranks, i + 2, F.size(pieces))).alias("ranks"),
        )

    folded = F.aggregate(
        F.sequence(F.lit(2), F.length(word)),
        F.struct(single.alias("pieces"), ranks.alias("ranks")),
        lambda acc, _: F.when(F.array_min(acc["ranks"]).isNull(), acc).otherwise(
            # a one-element transform binds the place, so that it is looked for once
            F.get(F.transform(F.array(F.array_position(acc["ranks"], F.array_min(acc["ranks"])).cast("int")), lambda i: merged(acc, i)), F.lit(0))
        ),
    )
    ids = F.transform(folded["pieces"], lambda p: rank_of(table, p))
    return F.when(whole.isNotNull(), F.array(whole)).when(F.length(word) < 2, F.transform(single, lambda p: rank_of(table, p))).otherwise(ids)


def heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long word: a heap of candidate merges over a linked list of pieces."""
    n = len(word)
    end = list(range(1, n + 1))
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    alive = bytearray(b"\1") * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop:
            continue
        alive[j] = 0
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(word string) distinct -> (word, ids)."""
    table = rank_table(path)
    raw = words.select("word", F.encode("word", "UTF-8").alias("bytes"))
    # the table is bound once, by a one-element transform: the plan then carries one copy of the constant
    ids = F.get(F.transform(F.array(table), lambda bound: fold_merges(F.col("bytes"), bound)), F.lit(0))
    short = raw.filter(F.length("bytes") <= FOLD_BYTES).select("word", ids.alias("ids"))

    @F.pandas_udf("array<int>")
    def by_heap(values: pd.Series) -> pd.Series:
        ranks = read_ranks(path)
        return values.map(lambda w: ranks_or_merge(bytes(w), ranks))

    long = raw.filter(F.length("bytes") > FOLD_BYTES).select("word", by_heap("bytes").alias("ids"))
    return short.unionByName(long)


def ranks_or_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    return [ranks[word]] if word in ranks else heap_merges(word, ranks)


#: Bytes of text in a block, about: the distinct words of so much text are what a task holds at a time.
BLOCK_BYTES = 16 << 20
#: Blocks of a small corpus, so that it is spread over some cores.
LEAST_BLOCKS = 32


def blocked(docs: DataFrame, keep: list[str], text_col: str, block_bytes: int) -> DataFrame:
    """(block, keep..., text): every row by itself goes to a block, so that repeated rows fill none."""
    kept = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = kept.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(LEAST_BLOCKS, -(-size // block_bytes))
    return kept.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).alias("block"), *keep, "text")


def by_blocks(docs: DataFrame, keep: list[str], text_col: str, path: str, count: bool, block_bytes: int) -> DataFrame:
    """(keep..., ids) or (keep..., tokens int) for every row of `docs`.

    Plan: a word occurs at most once per block in what is shuffled, so a word that makes up a third of the corpus is no
    hot key; the text is shuffled once, to its block, where it meets the block's words, sorted before it.  Nothing is
    broadcast but the vocabulary, whose size is fixed.
    """
    placed = blocked(docs, keep, text_col, block_bytes)
    words_of = F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0))
    per_block = placed.select("block", F.explode(F.array_distinct(words_of)).alias("word")).distinct()
    coded = encode_words(per_block.select("word").distinct(), path)
    lexicon = per_block.join(coded, "word").select("block", F.lit(0).alias("kind"), "word", "ids")
    met = lexicon.unionByName(placed.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    met = met.repartition("block").sortWithinPartitions("block", "kind")
    met = met.select("block", "kind", "word", "ids", *keep, F.when(F.col("kind") == 1, words_of).alias("words"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, known, codes = None, [], None, None
        for batch in batches:
            of, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            edges = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (kind[1:] != kind[:-1])) + 1), len(of)]
            for a, b in itertools.pairwise(edges):
                if a == b:
                    continue
                if of[a] != block:
                    block, parts, known = of[a], [], None
                run = batch.slice(a, b - a)
                if kind[a] == 0:
                    parts.append((run.column(2), run.column(3)))
                    continue
                if known is None:
                    known = pa.concat_arrays([w for w, _ in parts]) if parts else pa.array([], pa.string())
                    codes = pa.concat_arrays([c for _, c in parts]) if parts else pa.array([], pa.list_(pa.int32()))
                lists = run.column(4 + len(keep))
                flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
                at = pc.index_in(flat, value_set=known)
                if at.null_count:  # rows that come in another order when they are read again change blocks
                    missing = pc.unique(flat.filter(pc.is_null(at)))
                    ranks = read_ranks(path)
                    known = pa.concat_arrays([known, missing])
                    codes = pa.concat_arrays([codes, pa.array([ranks_or_merge(w.encode(), ranks) for w in missing.to_pylist()], codes.type)])
                    at = pc.index_in(flat, value_set=known)
                found = codes.take(at)
                through = np.concatenate([[0], np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False))])[ends]
                if count:
                    last = pa.array(np.diff(through).astype(np.int32))
                else:
                    last = pa.ListArray.from_arrays(pa.array(through.astype(np.int32)), found.flatten().cast(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(run.column(4 + i) for i in range(len(keep))), last], names)

    names = [*keep, "tokens" if count else "ids"]
    types = dict(placed.dtypes)
    return met.mapInArrow(assemble, ", ".join([*(f"`{k}` {types[k]}" for k in keep), "tokens int" if count else "ids array<int>"]))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, ids array<int>) for every row of `docs`."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return by_blocks(named, ["doc_id"], "text", path or tokenizer_path("byte_bpe_50k.tiktoken"), False, block_bytes)


def token_counts(docs: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(keep..., tokens int) for every row of `docs`; no list of ids is built."""
    return by_blocks(docs.select(*keep, F.col(text_col).alias("text")), keep, "text", path or tokenizer_path("byte_bpe_50k.tiktoken"), True, block_bytes)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text): the byte strings of the ids, concatenated.  Null ids give null, no ids an empty text."""
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")
    pieces = [b""] * (max(read_ranks(path).values()) + 1)
    for piece, rank in read_ranks(path).items():
        pieces[rank] = piece
    table = F.from_json(F.lit(json.dumps([base64.b64encode(p).decode() for p in pieces])), "array<binary>")
    joined = F.aggregate(F.col(ids_col), F.lit(b"").cast("binary"), lambda acc, i: F.concat(acc, F.get(table, i)))
    return encoded.select(F.col(id_col).alias("doc_id"), F.decode(joined, "UTF-8").alias("text"))
