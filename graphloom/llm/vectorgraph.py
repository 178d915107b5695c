"""Most similar vectors for every vector (problem 3): robust-pruned directed graphs in shards, searched by beams.

1. Vectors are checked, scaled to length one and routed to shards by a tree of centroids: those of its root are fitted
   on a bounded sample (`sample` rows, a parameter), and every cell that its sample shows to outgrow `shard_rows` twice
   is divided by centroids fitted on a bounded sample of its own, in the cluster.  Every vector is indexed in the shard
   of its nearest centroids and queried against the shards of the next nearest (`probes`, more where there are many).
2. In a shard a graph is built: neighbours proposed inside blocks and then by greedy searches from every vector are
   pruned so that an edge stays only if no kept neighbour is `alpha` times closer to its end; reverse edges are added.
3. Beam searches over the graph answer the queries of a shard, many at once as array operations.
4. The answers of all shards are merged per vector.

Only (vector, shard) rows and k answers per row are shuffled; nothing is compared across shards.

Defined results: null, empty, short, all-zero vectors and ones that hold null, NaN or infinity are left out, as are
null ids and providers; providers and lengths are never mixed; a repeated row counts once, and of several vectors of
one id the one with the smallest hash holds; ties in similarity go to the smaller id (equal unit vectors
are searched as one and told apart by id afterwards); an empty table gives no rows.
"""

from __future__ import annotations

import ctypes
import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.sources.tables import cut

INPUT = ["symbol_id", "provider", "dimension", "embedding"]


def usable(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, positions, unit vectors) of the usable rows of a batch of INPUT columns."""
    lists = batch.column(3)
    length = pc.list_value_length(lists).fill_null(-1).to_numpy(zero_copy_only=False)
    dim = batch.column(2).fill_null(-2).to_numpy(zero_copy_only=False)
    ok = (length == dim) & (length > 0) & pc.is_valid(batch.column(0)).to_numpy(zero_copy_only=False) & pc.is_valid(batch.column(1)).to_numpy(zero_copy_only=False)
    for d in np.unique(length[ok]):
        at = np.flatnonzero(ok & (length == d))
        x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)  # nulls become NaN
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        good = np.isfinite(norm) & (norm > 0)
        if good.any():
            yield int(d), at[good], (x[good] / norm[good, None]).astype(np.float32) + np.float32(0)  # no negative zeros


def _hashes(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every vector."""
    return np.array([int.from_bytes(hashlib.blake2b(v.tobytes(), digest_size=8).digest(), "little", signed=True) for v in np.ascontiguousarray(x)], np.int64)


# ------------------------------------------------------------------------------------------------ one shard


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Edges of `nodes` out of `cand` (sorted by similarity, -1 for none); free places are filled with the nearest."""
    out = np.full((len(nodes), degree), -1, np.int32)
    buffer: dict = {}
    for at in range(0, len(nodes), 256):
        c = cand[at : at + 256]
        p = x[nodes[at : at + 256]]
        there = c >= 0
        y = gathered(x, c, buffer)
        far = 1.0 - np.matmul(y, p[:, :, None])[:, :, 0]
        between = 1.0 - np.matmul(y, y.transpose(0, 2, 1))
        alive = there.copy()
        kept = np.zeros_like(alive)
        count = np.zeros(len(c), np.int32)
        for i in range(c.shape[1]):
            take = alive[:, i] & (count < degree)
            kept[:, i] = take
            count += take
            alive &= ~(take[:, None] & (alpha * between[:, i, :] <= far))
        # kept first, then the nearest others
        order = np.argsort(np.where(kept, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :degree]
        chosen = np.take_along_axis(c, order, 1)
        out[at : at + 256, : chosen.shape[1]] = chosen
    return out


def gathered(x: np.ndarray, index: np.ndarray, buffer: dict) -> np.ndarray:
    """x[index] in a buffer that is used again: fresh memory would cost more than the copy."""
    flat = np.maximum(index, 0).ravel()
    room = buffer.get("room")
    if room is None or len(room) < len(flat) or room.shape[1] != x.shape[1]:
        room = buffer["room"] = np.empty((len(flat), x.shape[1]), np.float32)
    out = room[: len(flat)]
    np.take(x, flat, axis=0, out=out, mode="clip")
    return out.reshape(*index.shape, x.shape[1])


def with_reverse(graph: np.ndarray, width: int) -> np.ndarray:
    """Candidates of every node: its edges, and the edges that lead to it, those first that rank high at their start."""
    n, degree = graph.shape
    dst = graph.T.ravel()
    src = np.tile(np.arange(n, dtype=np.int32), degree)
    ok = dst >= 0
    dst, src = dst[ok], src[ok]
    order = np.argsort(dst, kind="stable")
    dst, src = dst[order], src[order]
    rank = np.arange(len(dst)) - np.searchsorted(dst, np.arange(n))[dst]
    keep = rank < width - degree
    out = np.full((n, width), -1, np.int32)
    out[:, :degree] = graph
    out[dst[keep], degree + rank[keep]] = src[keep]
    return out


def beam_search(x: np.ndarray, graph: np.ndarray, pivots: np.ndarray, queries: np.ndarray, beam: int, steps: int, expand: int = 2, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities), best first, of the `beam` best nodes that searches over the graph come across.

    Searches begin at the best of the pivots, and at `start` (a node per query, -1 for none): a member of the graph
    begins at itself.
    """
    n = len(x)
    beam = min(beam, n)
    nodes_out, sims_out = np.empty((len(queries), beam), np.int32), np.empty((len(queries), beam), np.float32)
    batch = 256
    buffer: dict = {}
    at_pivots = x[pivots].T.copy()
    marks = np.zeros((batch, n + 1), np.int32)  # the batch that saw a node last: no clearing between batches
    for stamp, at in enumerate(range(0, len(queries), batch), 1):
        q = queries[at : at + batch]
        m = len(q)
        seen = marks[:m]
        seen[:, n] = stamp
        rows = np.arange(m)[:, None]
        sims0 = q @ at_pivots
        k = min(beam, len(pivots), 16)
        top = np.argpartition(-sims0, k - 1, axis=1)[:, :k]
        nodes = np.full((m, beam), n, np.int32)
        sims = np.full((m, beam), -2.0, np.float32)
        nodes[:, :k], sims[:, :k] = pivots[top], sims0[rows, top]
        if start is not None and k < beam:
            own = start[at : at + m]
            known = own >= 0
            again = (nodes[:, :k] == own[:, None]).any(1)
            nodes[known & ~again, k] = own[known & ~again]
            sims[known & ~again, k] = 1.0
        seen[rows, nodes] = stamp
        done = nodes == n
        for _ in range(steps):
            open_sims = np.where(done, -3.0, sims)
            pick = np.argpartition(-open_sims, expand - 1, axis=1)[:, :expand] if expand < beam else np.argsort(-open_sims, axis=1)[:, :expand]
            if open_sims[rows, pick].max() <= -3.0:
                break
            here = np.where(done[rows, pick], n, nodes[rows, pick])
            done[rows, pick] = True
            next_ = graph[here].reshape(m, -1)
            next_[next_ < 0] = n
            fresh = seen[rows, next_] != stamp
            seen[rows, next_] = stamp
            s = np.matmul(gathered(x, np.minimum(next_, n - 1), buffer), q[:, :, None])[:, :, 0]
            s[~fresh] = -2.0
            next_[~fresh] = n
            all_nodes = np.concatenate([nodes, next_], 1)
            all_sims = np.concatenate([sims, s], 1)
            all_done = np.concatenate([done, ~fresh], 1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            nodes, sims, done = all_nodes[rows, best], all_sims[rows, best], all_done[rows, best]
        order = np.argsort(-sims, axis=1, kind="stable")
        nodes, sims = nodes[rows, order], sims[rows, order]
        # expansions of one step may bring the same node twice; it keeps its first place
        again = np.zeros_like(nodes, bool)
        for shift in range(1, 2 * expand):
            again[:, shift:] |= (nodes[:, shift:] == nodes[:, :-shift]) & (nodes[:, shift:] < n)
        nodes[again], sims[again] = n, -2.0
        order = np.argsort(-sims, axis=1, kind="stable")
        nodes_out[at : at + m], sims_out[at : at + m] = nodes[rows, order], sims[rows, order]
    return np.where(nodes_out == n, -1, nodes_out), sims_out


def keep_memory() -> None:
    """Let the C library keep freed memory: returning and fetching pages would take most of a search's time."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 28)
        libc.mallopt(-1, 1 << 29)
    except (OSError, AttributeError):  # another C library
        pass


class Shard:
    """A robust-pruned graph over the vectors of one shard."""

    def __init__(self, x: np.ndarray, degree: int = 16, beam: int = 24, alpha: float = 1.2, seed: int = 7, block: int = 384, steps: int = 8):
        keep_memory()
        self.x, self.beam, n = np.ascontiguousarray(x), beam, len(x)
        rng = np.random.default_rng(seed)
        self.pivots = np.sort(rng.choice(n, min(n, 256), replace=False)).astype(np.int32)
        width = 2 * degree
        proposals = [rng.integers(0, n, (n, 3)).astype(np.int32)]
        for _ in range(2):
            anchors = x[rng.choice(n, min(n, 64), replace=False)]
            order = np.lexsort((x @ rng.standard_normal(x.shape[1]).astype(np.float32), np.argmax(x @ anchors.T, 1))).astype(np.int32)
            found = np.full((n, 8), -1, np.int32)
            for at in range(0, n, block):
                part = order[at : at + block]
                s = x[part] @ x[part].T
                np.fill_diagonal(s, -2)
                k = min(8, len(part) - 1)
                if k > 0:
                    found[part, :k] = part[np.argpartition(-s, k - 1, axis=1)[:, :k]]
            proposals.append(found)
        self.graph = self._prune(with_reverse(self._prune(np.concatenate(proposals, 1), width, degree, 0.0), width), width, degree, 1.0)
        self._close()
        # greedy searches from every vector propose its neighbours
        nodes, _ = self.search(self.x, beam, steps, np.arange(n))
        merged = self._prune(np.concatenate([nodes, self.graph[:n]], 1), width, degree, alpha)
        self.graph = self._prune(with_reverse(merged, width), width, degree, alpha)
        self._close()

    def _close(self) -> None:
        """A last row, of node n, that leads nowhere."""
        self.graph = np.concatenate([self.graph, np.full((1, self.graph.shape[1]), -1, np.int32)])

    def _prune(self, cand: np.ndarray, width: int, degree: int, alpha: float) -> np.ndarray:
        """Sort candidates by similarity, drop repeats and the node itself, prune; without alpha the nearest stay."""
        x, n = self.x, len(self.x)
        cand = np.where(cand == np.arange(n)[:, None], -1, cand)
        cand = np.sort(cand, axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        wide = min(width, cand.shape[1]) if alpha else degree
        best = np.full((n, wide), -1, np.int32)
        buffer: dict = {}
        for at in range(0, n, 256):
            c = cand[at : at + 256]
            s = np.matmul(gathered(x, c, buffer), x[at : at + 256][:, :, None])[:, :, 0]
            order = np.argsort(np.where(c < 0, 3.0, -s), axis=1)[:, :wide]
            best[at : at + 256, : order.shape[1]] = np.take_along_axis(c, order, 1)
        return robust_prune(x, np.arange(n), best, degree, alpha) if alpha else best

    def search(self, queries: np.ndarray, beam: int | None = None, steps: int = 16, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        return beam_search(self.x, self.graph, self.pivots, queries, beam or self.beam, steps, start=start)


def shard_answers(x: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, effort: int) -> tuple[np.ndarray, np.ndarray]:
    """k + 1 best nodes of a shard for every query; own: the node that a query is, -1 for visitors; effort 1 or more."""
    graph = Shard(x, degree=12 + 4 * effort, beam=16 + 8 * effort, steps=6 + 2 * effort)
    nodes, sims = graph.search(queries, steps=4 + 4 * effort, start=own)
    return nodes[:, : k + 1], sims[:, : k + 1]


# ------------------------------------------------------------------------------------------------- routing


def fit_centroids(sample: np.ndarray, parts: int, seed: int = 3, rounds: int = 12) -> np.ndarray:
    """Spherical k-means on a sample."""
    rng = np.random.default_rng(seed)
    if parts <= 1 or len(sample) <= parts:
        return sample[:1] if len(sample) else sample
    c = sample[rng.choice(len(sample), parts, replace=False)]
    for _ in range(rounds):
        near = np.argmax(sample @ c.T, 1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c.astype(np.float32)


def visits(probes: int, shards: int) -> int:
    """Shards that a vector is queried against: they grow with the root of the number of shards, from `probes` up."""
    return min(shards, max(probes, math.ceil(probes * math.sqrt(shards) / 6)))


def _census(vectors: DataFrame) -> DataFrame:
    """(provider, dim, id, h): usable rows without their vectors."""

    def scan(batches):
        for b in batches:
            for d, at, x in usable(b):
                yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(at)), pa.array(np.full(len(at), d, np.int32)), b.column(0).take(pa.array(at)), pa.array(_hashes(x))], ["provider", "dim", "id", "h"])

    return vectors.select(*INPUT).mapInArrow(scan, "provider string, dim int, id string, h bigint")


def _sample(vectors: DataFrame, provider: str, dim: int, share: float, most: int) -> np.ndarray:
    """Unit vectors of about `share` of a provider's rows, `most` at most: the only vectors the driver sees."""
    limit = int(share * 1_000_000)

    def scan(batches):
        for b in batches:
            for d, at, x in usable(b):
                names = b.column(0).take(pa.array(at)).to_pylist()
                keep = np.array([d == dim and zlib.crc32(n.encode()) % 1_000_000 < limit for n in names], bool)
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x[keep]], pa.binary())], ["v"])

    rows = vectors.filter(F.col("provider") == provider).select(*INPUT).mapInArrow(scan, "v binary").limit(most).collect()
    return np.array([np.frombuffer(r.v, np.float32) for r in rows], np.float32).reshape(-1, dim)


#: Sub-cells of a cell are routed to in this many parts of its rows, so that a cell of a third of all rows is no hot key.
SALTS = 16
#: Every level divides by up to `fan`; with three levels of 512 a shard is left of 2 ** 41 vectors at 16,384 a shard.
MOST_LEVELS = 4


def divided(routed: DataFrame, big: DataFrame, fan: int, shard_rows: int, probes: int, sample: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """`routed` with the cells of `big` (cell, size) divided, and the sizes (cell, size) of the cells that this gave.

    Sub-cells get the ids cell * fan + number; undivided cells keep their rows, as cell * fan.
    """
    spark = routed.sparkSession
    asked = cut(big.withColumn("share", sample / F.col("size")))  # one row per cell of thousands of vectors
    limit = F.col("share") * 1_000_000
    drawn = routed.filter("home").join(asked, "cell").filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < limit)

    def fit(t: pa.Table) -> pa.Table:
        size = t.column("size")[0].as_py()
        x = np.unique(np.frombuffer(b"".join(t.column("v").to_pylist()), np.float32).reshape(len(t), -1), axis=0)
        c = fit_centroids(x, min(fan, math.ceil(size / shard_rows)), seed)
        share = np.bincount(np.argmax(x @ c.T, 1), minlength=len(c)) / len(x) * size
        n = len(c)
        return pa.table([pa.array([t.column("cell")[0].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([e.tobytes() for e in c], pa.binary()), pa.array(share, pa.float64())], names=["cell", "number", "c", "size"])

    # a cell's sample is bounded by the parameter, whatever the cell's size
    fitted = cut(drawn.select("cell", "size", "v").groupBy("cell").applyInArrow(fit, "cell bigint, number int, c binary, size double"))
    sizes = fitted.select((F.col("cell") * fan + F.col("number")).alias("cell"), "size")
    salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")
    known = fitted.select("cell", salts, F.lit(0).alias("kind"), "number", "c")
    # the divided cells are known by now: one row each, checked, decide which rows are routed on
    rows = routed.join(F.broadcast(asked.select("cell", F.lit(True).alias("parted"))) if asked.count() <= 1_000_000 else asked.select("cell", F.lit(True).alias("parted")), "cell", "left")
    still = rows.filter(F.col("parted").isNull()).drop("parted").withColumn("cell", F.col("cell") * fan)
    columns = ["provider", "dim", "id", "v", "home"]
    going = rows.filter("parted").select("cell", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("kind"), *columns)
    met = known.unionByName(going, allowMissingColumns=True).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind", "number")

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, c = None, [], None
        for batch in batches:
            of, kind = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            salt = batch.column(1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (kind[1:] != kind[:-1]) | (salt[1:] != salt[:-1])) + 1), len(of)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                run = batch.slice(a, b - a)
                if (of[a], salt[a]) != cell:
                    cell, parts, c = (of[a], salt[a]), [], None
                if kind[a] == 0:
                    parts += run.column(4).to_pylist()
                    continue
                if c is None:
                    c = np.frombuffer(b"".join(parts), np.float32).reshape(len(parts), -1)
                x = np.frombuffer(b"".join(run.column(8).to_pylist()), np.float32).reshape(b - a, -1)
                home = run.column(9).to_numpy(zero_copy_only=False).astype(bool)
                take = visits(probes, len(c))
                fewer = max(1, math.ceil(0.8 * take))
                near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :take]
                for j in range(take):
                    here = np.flatnonzero(home | (j < fewer))
                    pick = pa.array(here)
                    yield pa.RecordBatch.from_arrays([*(run.column(i).take(pick) for i in (5, 6, 7, 8)), pa.array(home[here] & (j == 0)), pa.array(of[a] * fan + near[here, j])], [*columns, "cell"])

    moved = met.select("cell", "salt", "kind", "number", "c", *columns).mapInArrow(on, "provider string, dim int, id string, v binary, home boolean, cell bigint")
    return still.select(*columns, "cell").unionByName(moved), sizes


def neighbours(vectors: DataFrame, k: int = 5, at_least: float = -2.0, shard_rows: int = 8_192, probes: int = 6, effort: int = 3, sample: int = 20_000, fan: int = 512) -> DataFrame:
    """(provider, dim, id, neighbour, similarity, rank): the k most similar vectors that the search finds, per vector.

    probes and effort (beam, degree, steps) buy recall with time.  Answers below `at_least` are not passed on: they
    cannot change the rank of those above.  An answer counts for both of its ends.  A cell is divided into `fan` at most.
    """
    census = _census(vectors)
    per_id = census.groupBy("provider", "dim", "id").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    # one row per provider and length: what the vectors were made by, not how many there are
    groups = per_id.groupBy("provider", "dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lo") != F.col("hi")).alias("torn"), F.countDistinct("lo").alias("distinct")).collect()
    centroids: dict[tuple[str, int], np.ndarray] = {}
    first_cell: dict[tuple[str, int], int] = {}
    sizes: list[tuple[int, float]] = []
    shards = 0  # at the end, about
    for g in groups:
        key = (g["provider"], g["dim"])
        first_cell[key] = len(sizes)
        wanted = math.ceil(g["distinct"] / shard_rows)
        shards += wanted
        if wanted > 1:
            x = np.unique(_sample(vectors, *key, min(1.0, sample / g["n"]), 2 * sample), axis=0)
            centroids[key] = c = fit_centroids(x, min(fan, wanted))
            share = np.bincount(np.argmax(x @ c.T, 1), minlength=len(c)) / max(1, len(x))
        else:
            centroids[key], share = np.zeros((1, g["dim"]), np.float32), [1.0]
        sizes += [(len(sizes) + i, float(r * g["distinct"])) for i, r in enumerate(share)]

    over = any(z[1] > 2 * shard_rows for z in sizes)
    if over:  # a level more to miss a neighbour at: a third more visits at each
        probes = math.ceil(4 * probes / 3)

    def route(batches):
        for b in batches:
            providers = b.column(1)
            for d, at, x in usable(b):
                names = np.array(providers.take(pa.array(at)).to_pylist(), object)
                for p in set(names):
                    c = centroids.get((p, d))
                    if c is None:
                        continue
                    mine = names == p
                    y, ids = x[mine], b.column(0).take(pa.array(at[mine]))
                    take = visits(probes, len(c))
                    s = y @ c.T
                    near = np.argsort(-s, axis=1, kind="stable")[:, :take] if take > 1 else np.argmax(s, 1)[:, None]
                    raw = pa.array([v.tobytes() for v in y], pa.binary())
                    h = pa.array(_hashes(y)) if torn else pa.nulls(len(y), pa.int64())
                    n = len(y)
                    for j in range(take):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([p] * n, pa.string()), pa.array(np.full(n, d, np.int32)), ids, raw, pa.array(np.full(n, j == 0)), pa.array(first_cell[p, d] + near[:, j].astype(np.int64)), h],
                            ["provider", "dim", "id", "v", "home", "cell", "h"],
                        )

    torn = sum(g["torn"] for g in groups) > 0
    schema = "provider string, dim int, id string, v binary, home boolean, cell bigint, h bigint"
    routed = vectors.select(*INPUT).mapInArrow(route, schema)
    if torn:  # ids with several vectors: the one with the smallest hash holds
        held = per_id.filter(F.col("lo") != F.col("hi")).select("provider", "dim", "id", "lo")
        routed = routed.join(held, ["provider", "dim", "id"], "left").filter(F.col("lo").isNull() | (F.col("lo") == F.col("h")))
    routed = routed.drop("h", "lo")
    # equal vectors are searched as one, the one with the smallest id
    twins = any(g["distinct"] < g["n"] for g in groups)
    if twins:
        alike = per_id.groupBy("provider", "dim", "lo").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
        copies = cut(per_id.select("provider", "dim", "id", "lo").join(alike, ["provider", "dim", "lo"]).select("provider", "dim", "id", "first"))
        routed = routed.join(copies.filter("id <> first"), ["provider", "dim", "id"], "left_anti")

    spark = vectors.sparkSession
    big = spark.createDataFrame([z for z in sizes if z[1] > 2 * shard_rows], "cell bigint, size double")
    for level in range(1, MOST_LEVELS):
        if not over:
            break
        routed, below = divided(routed, big, fan, shard_rows, probes, sample, level)
        big = below.filter(F.col("size") > 2 * shard_rows)
        over = big.count() > 0

    def answer(t: pa.Table) -> pa.Table:
        names = ["provider", "dim", "id", "neighbour", "similarity"]
        provider, dim = t.column("provider")[0].as_py(), t.column("dim")[0].as_py()
        ids = np.array(t.column("id").to_pylist(), dtype=object)
        home = t.column("home").to_numpy(zero_copy_only=False).astype(bool)
        # repeated rows count once, and a home row stands before a visit
        order = np.lexsort((~home, ids))
        ids, home = ids[order], home[order]
        first = np.append(True, ids[1:] != ids[:-1])
        order, ids, home = order[first], ids[first], home[first]
        x = np.frombuffer(b"".join(t.column("v").take(pa.array(order)).to_pylist()), np.float32).reshape(len(order), -1)
        base = np.flatnonzero(home)
        rows = np.zeros(0, np.int64)
        hit, value = rows, np.zeros(0, np.float32)
        if len(base):
            place = np.full(len(x), -1)
            place[base] = np.arange(len(base))
            nodes, sims = shard_answers(x[base], x, place, k, effort)
            own = base[np.maximum(nodes, 0)] == np.arange(len(x))[:, None]
            rows, places = np.nonzero((nodes >= 0) & ~own & (sims >= at_least))
            hit, value = base[nodes[rows, places]], sims[rows, places]
        return pa.table([pa.array([provider] * len(rows), pa.string()), pa.array(np.full(len(rows), dim, np.int32)), pa.array(ids[rows], pa.string()), pa.array(ids[hit], pa.string()), pa.array(value.astype(np.float32))], names=names)

    # a shard to a partition: their hashes would collide, and some tasks hold several
    tasks = min(max(1, len(sizes), shards), 100_000)
    placed = routed.withColumn("task", F.pmod("cell", F.lit(tasks)).cast("int")).repartitionById(tasks, F.col("task"))
    answers = placed.groupBy("task", "cell").applyInArrow(answer, "provider string, dim int, id string, neighbour string, similarity float")
    ends = F.array(F.struct("id", "neighbour"), F.struct(F.col("neighbour").alias("id"), F.col("id").alias("neighbour")))
    both = answers.select("provider", "dim", "similarity", F.explode(ends).alias("e")).select("provider", "dim", "e.id", "e.neighbour", "similarity")
    once = both.groupBy("provider", "dim", "id", "neighbour").agg(F.max("similarity").alias("similarity"))
    best = W.partitionBy("provider", "dim", "id").orderBy(F.desc("similarity"), "neighbour")
    ranked = once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return _expanded(ranked.drop("rank"), copies, k, at_least) if twins else ranked


def _expanded(near: DataFrame, copies: DataFrame, k: int, at_least: float) -> DataFrame:
    """`near`, found for the first of equal vectors, with the rank for all copies (id, first); no more than the k + 1
    smallest ids of a group can be anyone's neighbours."""
    by_id = W.partitionBy("provider", "dim", "first").orderBy("id")
    smallest = copies.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1)
    members = smallest.groupBy("provider", "dim", F.col("first").alias("neighbour")).agg(F.collect_list("id").alias("ids"))
    own = members.select("provider", "dim", F.col("neighbour").alias("id"), "neighbour", F.lit(1.0).cast("float").alias("similarity")).filter(F.lit(at_least <= 1))
    wide = near.select("provider", "dim", "id", "neighbour", "similarity").unionByName(own).join(members, ["provider", "dim", "neighbour"], "left")
    wide = wide.select("provider", "dim", "id", "similarity", F.explode(F.coalesce("ids", F.array("neighbour"))).alias("neighbour"))
    best = W.partitionBy("provider", "dim", "id").orderBy(F.desc("similarity"), "neighbour")
    most = wide.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k + 1)
    lists = most.groupBy("provider", "dim", F.col("id").alias("first")).agg(F.collect_list(F.struct("rank", "neighbour", "similarity")).alias("list"))
    every = lists.join(copies, ["provider", "dim", "first"], "left").withColumn("id", F.coalesce("id", "first"))
    others = F.filter(F.array_sort("list"), lambda e: e["neighbour"] != F.col("id"))
    out = every.select("provider", "dim", "id", F.posexplode(F.slice(others, 1, k)).alias("at", "e"))
    return out.select("provider", "dim", "id", "e.neighbour", "e.similarity", (F.col("at") + 1).alias("rank"))


def found(vectors: DataFrame, min_similarity: float = 0.9, probes: int = 2, effort: int = 1) -> DataFrame:
    """(symbol_id_a, symbol_id_b), smaller first: each is among the other's five nearest, at `min_similarity` or more."""
    near = neighbours(vectors, at_least=min_similarity, probes=probes, effort=effort)
    a = near.select("provider", "dim", F.least("id", "neighbour").alias("symbol_id_a"), F.greatest("id", "neighbour").alias("symbol_id_b"))
    both = a.groupBy("provider", "dim", "symbol_id_a", "symbol_id_b").agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
    return both.select("symbol_id_a", "symbol_id_b").distinct()
