"""Approximate nearest neighbours with a forest of hash prefixes.

A tree gives every vector a string of bits, the signs of its products with random directions, and
keeps the strings sorted. A query descends to the vectors that share the longest prefix with it;
then all trees ascend in step, one bit at a time, until the distinct vectors under the query's nodes
are enough. Those are scored exactly.

Vectors are dealt into blocks of bounded size by a hash of their id. A block has its own trees (the
same directions everywhere), and the stated queries visit every block; each block gives back its
best few, and the best of all blocks are the answer. What is collected per query grows with the
number of blocks, never with a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 4096
BITS = 32
# Queries whose candidates are marked at a time.
SEARCH_ROWS = 512


def usable(vectors: DataFrame, name: str = "embedding") -> DataFrame:
    """``vec_id, v`` of the vectors with a direction: not NULL, all numbers finite, not zero."""
    v = F.col(name).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (vectors.select("vec_id", v.alias("v")).filter("vec_id is not null and v is not null")
            .filter(~F.exists("v", bad) & F.exists("v", lambda x: x != 0.0)))


def directions(size: int, trees: int, seed: int) -> np.ndarray:
    """``trees`` groups of ``BITS`` random directions; those of a group are orthogonal in runs."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows: list[np.ndarray] = []
        while len(rows) < BITS:
            rows.extend(np.linalg.qr(rng.standard_normal((size, size)))[0].T)
        out.append(np.array(rows[:BITS]))
    return np.array(out)


class Forest:
    """The trees of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, ways: np.ndarray):
        self.ids, self.vectors, self.ways = ids, vectors, ways
        self.norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        # Rows of one id with different vectors are one candidate.
        self.known, self.code = np.unique(ids, return_inverse=True)
        strings = self.strings(vectors)
        order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, order, axis=1)
        self.held = self.code[order]

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """Bit strings per tree, the first direction in the highest bit."""
        bits = [np.packbits((vectors @ way.T) > 0, axis=1) for way in self.ways]
        return np.array([b.view(f">u{BITS // 8}")[:, 0] for b in bits]).astype(np.uint64)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, share: float) -> Iterator[np.ndarray]:
        """Positions of the candidates of each query.

        They are of at least ``k`` distinct ids other than the query's own, and of ``share`` of all
        such ids; of all, if there are fewer.
        """
        for a in range(0, len(queries), SEARCH_ROWS):
            yield from self.search_some(query_ids[a:a + SEARCH_ROWS], queries[a:a + SEARCH_ROWS], k, share)

    def search_some(self, query_ids: np.ndarray, queries: np.ndarray, k: int, share: float) -> Iterator[np.ndarray]:
        strings = self.strings(queries)
        n, size = strings.shape[1], len(self.known)
        at = np.minimum(np.searchsorted(self.known, query_ids), size - 1)
        own = self.known[at] == query_ids
        others = size - own
        enough = np.minimum(others, np.maximum(k, np.ceil(share * others))).astype(np.int64)
        # All trees of a query stand at the same depth. What its nodes hold grows while they
        # ascend. Repeats included it must be enough at least: the deepest such level is found by
        # halving. From there on distinct ids are counted, level by level; the root is enough.
        top, deep = np.zeros(n, dtype=np.int64), np.full(n, BITS, dtype=np.int64)
        while (top < deep).any():
            middle = (top + deep + 1) // 2
            low, high = self.nodes(strings, middle)
            held = (high - low).sum(axis=0) >= enough
            top, deep = np.where(held, middle, top), np.where(held, deep, middle - 1)
        low, high = self.nodes(strings, top)
        hit = np.zeros((n, size), dtype=bool)
        for q in range(n):
            self.mark(hit[q], low[:, q], high[:, q])
        rows = np.arange(n)
        while True:
            hit[rows[own], at[own]] = False
            open_ = np.flatnonzero((np.count_nonzero(hit, axis=1) < enough) & (top > 0))
            if not len(open_):
                break
            top[open_] -= 1
            left, right = self.nodes(strings[:, open_], top[open_])
            for j, q in enumerate(open_):
                self.mark(hit[q], np.concatenate([left[:, j], high[:, q]]), np.concatenate([low[:, q], right[:, j]]))
            low[:, open_], high[:, open_] = left, right
        for q in range(n):
            yield np.flatnonzero(hit[q][self.code])

    def mark(self, hit: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Mark the ids in the ranges of the trees, which come in turn (and again, for a second range)."""
        sizes = high - low
        first = np.arange(len(low)) % len(self.held) * self.held.shape[1] + low
        ends = np.cumsum(sizes)
        hit[self.held.ravel()[np.arange(ends[-1]) + np.repeat(first - ends + sizes, sizes)]] = True

    def nodes(self, strings: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the node of each query at its depth begins and ends in the sorted array of each tree."""
        shift = (BITS - depth).astype(np.uint64)
        node = (strings >> shift) << shift
        beyond = node + (np.uint64(1) << shift)
        low = np.array([np.searchsorted(s, x) for s, x in zip(self.sorted, node)])
        return low, np.array([np.searchsorted(s, x) for s, x in zip(self.sorted, beyond)])

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int, share: float) -> list[tuple]:
        """``query_id, vec_id, score`` of the k best candidates of each query, its own id left out."""
        norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        out = []
        for i, found in enumerate(self.search(query_ids, queries, k, share)):
            if len(found) > k:
                rough = (self.vectors[found] @ queries[i]) / self.norms[found]
                of_id = rough
                if len(self.known) < len(self.ids):
                    of_id = np.full(len(self.known), -np.inf)
                    np.maximum.at(of_id, self.code[found], rough)
                least = np.partition(of_id, len(of_id) - k)[len(of_id) - k] if len(of_id) > k else -np.inf
                found = found[rough >= least - 1e-9 * norms[i]]
            # Row by row, so that equal vectors get equal scores.
            score = np.einsum("ij,j->i", self.vectors[found], queries[i]) / (self.norms[found] * norms[i])
            top = np.lexsort((self.ids[found], -score))
            top = top[np.sort(np.unique(self.ids[found][top], return_index=True)[1])][:k]
            out += [(int(query_ids[i]), int(self.ids[found[t]]), float(score[t])) for t in top]
        return out


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of one block and side: ``block, side, ids, vectors``, apart by vector length."""
    block, side, ids = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("block", "side", "vec_id"))
    column = batch.column("v")
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    change = np.flatnonzero((np.diff(block) != 0) | (np.diff(side) != 0) | (np.diff(sizes) != 0)) + 1
    edges = [0, *change.tolist(), len(ids)]
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            yield int(block[a]), int(side[a]), ids[a:b], values[offsets[a]:offsets[b]].reshape(b - a, -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, trees: int = 64, share: float = 0.8,
            seed: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k candidates of largest cosine for every query.

    Both tables have ``vec_id, embedding``. Ties go to the smaller vec_id. Candidates are every
    vector but those with the query's id; with fewer than k, all are returned. Vectors that are
    NULL, zero or hold NULL or non-finite components take no part, and vectors of another length
    than the query are no candidates. Rows that repeat a vec_id with the same vector count once.
    ``share`` says how long to ascend: until the nodes of all trees hold this share of the distinct
    ids of a block other than the query's own, and k of them at least (all, where there are fewer);
    more trees and a larger share find more.
    """
    base = usable(vectors).distinct()
    asked = usable(queries).distinct()
    count = base.count()
    blocks = max(1, -(-count // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    dealt = (base.select(block.alias("block"), F.lit(0).alias("side"), "vec_id", "v")
             .unionByName(asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
                                       .alias("block"), F.lit(1).alias("side"), "vec_id", "v"))
             .repartition(min(blocks, 4096), "block").sortWithinPartitions("block", "side", F.size("v"), "vec_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways: dict[int, np.ndarray] = {}
        forests: dict[int, Forest] = {}
        gathered: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        here = None
        for batch in batches:
            out: list[tuple] = []
            for block_, side, ids, rows in matrices(batch):
                if block_ != here:
                    here = block_
                    forests.clear()
                    gathered.clear()
                if side == 0:
                    gathered.setdefault(rows.shape[1], []).append((ids, rows))
                    continue
                for size, parts in gathered.items():
                    if size not in ways:
                        ways[size] = directions(size, trees, seed)
                    forests[size] = Forest(np.concatenate([i for i, _ in parts]),
                                           np.concatenate([r for _, r in parts]), ways[size])
                gathered.clear()
                if (forest := forests.get(rows.shape[1])) is not None:
                    out += forest.best(ids, rows, k, share)
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)],
                                             names=["query_id", "vec_id", "score"])

    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()),
                           T.StructField("score", T.DoubleType())])
    found = dealt.mapInArrow(run, schema).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
