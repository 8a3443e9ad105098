"""N-gram Jaccard self-join with several global token orders.

Two sets can only be similar if their prefixes share a token, whatever global order the tokens are
sorted in. Here ``ORDERS`` orders are used: all put frequent tokens last, and differ among tokens of
like frequency. The first one generates candidates through an inverted index of prefixes; a
candidate stays if a parity sketch of the two sets (whose difference never exceeds the true one)
allows the similarity, and if the prefixes under every other order meet as well. What is left is
verified on the full sets.

No pairs within a group are listed. Equal sets are one node from the start. Of every index token
the node with the fewest tokens of its own is the hub; each node is first held against its best hub, one pair per
node, and the links found give components. After that only nodes of different components that
share a hub can matter: a link inside a component changes nothing. They are compared inside the
join, and only pairs that pass all filters leave it.

Frequencies are counted over all sets in a table of 2**SKETCH_BITS buckets; a bucket far above the
mean makes its tokens frequent. That decides the order only, never a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import small_batches, strings
from .common import cut_lineage
from .components import connected
from .shingles import mixed, shingle_sets

ORDERS = 3
SKETCH_BITS = 18
PARITY_BITS = 1024
PARITY_WORDS = PARITY_BITS // 64
# A sketch of PARITY_BITS tells nothing of sets that are much larger than it; sets beyond this many tokens
# have a second one of at least half a bit for each token.
LARGE_SET = 2 * PARITY_BITS
# Ids up to this number (16 bytes each) are broadcast to pick texts; more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequency_classes(docs: DataFrame, n: int) -> np.ndarray:
    """Class 0 to 15 of every bucket by how many distinct tokens of documents fall into it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for s in shingle_sets(strings(batch, "text"), n):
                np.add.at(counts, bucket(s), 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])],
                                         names=["bucket", "n"])

    counts = cut_lineage(small_batches(docs.select("text")).mapInArrow(run, "bucket int, n long")
                         .groupBy("bucket").agg(F.sum("n").alias("n")))
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / (1 << SKETCH_BITS)
    usual = mean + 6 * mean ** 0.5 + 8
    # At most total / usual rows, so fewer than there are buckets.
    busy = counts.filter(F.col("n") > usual).collect()
    classes = np.zeros(1 << SKETCH_BITS, dtype=np.uint64)
    for r in busy:
        classes[r["bucket"]] = min(15, 1 + int(np.log2(r["n"] / usual)))
    return classes


def signatures(docs: DataFrame, n: int, num: int, den: int, classes: Broadcast) -> DataFrame:
    """``doc_id, h, g, n, w, p0, p1, p2, parity, wide`` per row.

    Text hash, set hash, set size, the part of the first prefix that is of frequent tokens (in 255ths),
    prefixes, parity sketch, that of large sets.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(strings(batch, "text"), n)
            cols: list[list] = [[] for _ in range(ORDERS)]
            parity = np.zeros((len(sets), PARITY_WORDS), dtype=np.int64)
            wide = [np.zeros(0, np.int64)] * len(sets)
            usual = np.zeros(len(sets), dtype=np.int32)
            for i, s in enumerate(sets):
                if not len(s):
                    for c in cols:
                        c.append(np.zeros(0, np.int64))
                    continue
                keep = len(s) - -(-num * len(s) // den) + 1
                rank = classes.value[bucket(s)] << np.uint64(60)
                for k in range(ORDERS):
                    order = mixed(s + np.uint64(k)) if k else s
                    first = np.argsort(rank | (order >> np.uint64(4)), kind="stable")[:keep]
                    cols[k].append(s[first].view(np.int64))
                    if k == 0:
                        usual[i] = np.count_nonzero(rank[first]) * 255 // len(first)
                places = mixed(s ^ np.uint64(0x5851F42D4C957F2D))
                parity[i] = sketch(places, PARITY_BITS)
                if len(s) > LARGE_SET:
                    wide[i] = sketch(places, wide_bits(len(s)))
            arrays = [batch.column("doc_id"), batch.column("h"), pa.array([set_hash(s) for s in sets], pa.int64()),
                      pa.array([len(s) for s in sets], pa.int64()), pa.array(usual), lists(cols[0], np.int64)]
            arrays += [lists([c.astype(np.int32) for c in col], np.int32) for col in cols[1:]]
            arrays += [lists(list(parity), np.int64), lists(wide, np.int64)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "h", "g", "n", "w", "p0", "p1", "p2", "parity", "wide"])

    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"),
                                     "text")).mapInArrow(
        run, "doc_id long, h long, g long, n long, w int, p0 array<long>, p1 array<int>, p2 array<int>, parity array<long>, wide array<long>")


def wide_bits(n: int) -> int:
    """Half as many bits as tokens, rounded up to a power of two."""
    return 1 << (-(-n // 2) - 1).bit_length()


def sketch(places: np.ndarray, size: int) -> np.ndarray:
    """Whether an odd number of tokens falls on each of ``size`` places, as 64-bit words.

    One of twice the size has this one's words as the exclusive or of its halves.
    """
    bits = np.bincount((places & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def set_hash(s: np.ndarray) -> int:
    """One number per set; equal sets only have it in common (but for 64-bit collisions)."""
    total = mixed(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return int((mixed(np.array([total ^ np.uint64(len(s))], dtype=np.uint64)) + s.sum(dtype=np.uint64)).view(np.int64)[0])


def lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts).astype(kind, copy=False) if parts else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def sized(ids: DataFrame) -> DataFrame:
    """``ids`` marked for broadcast if they are few enough."""
    ids = cut_lineage(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def full_sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """``g, tokens`` of the documents with the ids in ``ids (doc_id)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(strings(batch, "text"), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_hash(s) for s in sets], pa.int64()), lists([s.view(np.int64) for s in sets], np.int64)],
                names=["g", "tokens"])

    ids = sized(ids.select(F.col("doc_id").alias("_id")).distinct())
    picked = docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_semi").select("text")
    return small_batches(picked).mapInArrow(run, "g long, tokens array<long>")


def verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame, nodes: DataFrame, n: int, num: int,
             den: int) -> DataFrame:
    """The pairs ``(a, b)`` of set hashes whose Jaccard similarity is at least num / den.

    Pairs whose prefixes do not meet under every further order are left out before the full sets
    are read.
    """
    pairs = cut_lineage(pairs.select("a", "b").distinct())
    prefixes = further_prefixes(rows, ends(pairs))
    pairs = cut_lineage(
        pairs.join(prefixes.select(F.col("g").alias("a"), F.col("p1").alias("a1"), F.col("p2").alias("a2")), "a")
        .join(prefixes.select(F.col("g").alias("b"), F.col("p1").alias("b1"), F.col("p2").alias("b2")), "b")
        .filter(F.arrays_overlap("a1", "b1") & F.arrays_overlap("a2", "b2")).select("a", "b").distinct())
    ids = ends(pairs).join(nodes.select("g", "doc_id"), "g").select("doc_id")
    sets = cut_lineage(full_sets(docs, ids, n))
    both = (pairs.join(sets.select(F.col("g").alias("a"), F.col("tokens").alias("ta")), "a")
            .join(sets.select(F.col("g").alias("b"), F.col("tokens").alias("tb")), "b"))
    shared = F.size(F.array_intersect("ta", "tb")).cast("long")
    size = F.size("ta") + F.size("tb")
    # An id that comes more than once gives its set more than once.
    return cut_lineage(both.filter(shared * den >= (size - shared) * num).select("a", "b").distinct())


def further_prefixes(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``g, p1, p2`` once per set in ``ids (g)``, however many documents have it."""
    return rows.select("g", "p1", "p2").join(sized(ids), "g", "left_semi").dropDuplicates(["g"])


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("g")).unionByName(pairs.select(F.col("b").alias("g"))).distinct()


def may_link(a: str, b: str, num: int, den: int) -> Column:
    """Length filter and parity sketches."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    parity = [F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(PARITY_WORDS)]
    apart = parity[0]
    for p in parity[1:]:
        apart = apart + p
    return ((F.least(na, nb) * den >= F.greatest(na, nb) * num)
            & (apart * (den + num) <= (na + nb) * (den - num))
            & F.when((F.size(f"{a}.wide") > 0) & (F.size(f"{b}.wide") > 0),
                     wide_apart(F.col(f"{a}.wide"), F.col(f"{b}.wide")) * (den + num) <= (na + nb) * (den - num))
            .otherwise(True))


def wide_apart(a: Column, b: Column) -> Column:
    """Differing bits of two sketches, the longer one folded once if need be; 0 if it is longer still."""
    long, short = F.when(F.size(a) > F.size(b), a).otherwise(b), F.when(F.size(a) > F.size(b), b).otherwise(a)
    half = F.size(short)
    folded = F.zip_with(F.slice(long, 1, half), F.slice(long, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    fitted = F.when(F.size(long) == half, long).otherwise(folded)
    count = F.aggregate(F.zip_with(fitted, short, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return F.when(F.size(long) <= 2 * half, count).otherwise(0)


def similarity_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs (doc_id, text)``.

    Rows link if the Jaccard similarity of their sets of distinct n-word shingles is at least
    num / den; the component is the smallest doc_id reachable (NULL ids: none is). NULL or empty
    text has no shingles and links with nothing. Equal texts always link; repeated rows give
    repeated results. Set equality is judged by 64-bit hashes. Runs jobs while it is called.
    """
    return row_components(docs, n, num, den).select("doc_id", "n_shingles", "component_id")


def row_components(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``similarity_components`` with ``text_hash`` and ``lead``.

    ``lead (no_id, doc_id, text_hash)`` is the row of the component that comes first, rows without an
    id last; NULL for rows without shingles.
    """
    docs = docs.select("doc_id", "text")
    classes = docs.sparkSession.sparkContext.broadcast(frequency_classes(docs, n))  # 2 MB at any size
    rows = cut_lineage(signatures(docs, n, num, den, classes))
    some = rows.filter("n > 0")
    nodes = some.groupBy("g").agg(F.min("doc_id").alias("doc_id"), F.min(row_key("doc_id", "h")).alias("lead"))
    # Index: prefix tokens, dealt once. A token that at least two nodes hold has the one with most
    # frequent tokens (the fewest of its own) as hub.
    held = Window.partitionBy("token")
    members = cut_lineage(
        some.select(F.explode("p0").alias("token"), "g", "w").repartition("token").distinct()
        .select("g", F.count("*").over(held).alias("holders"), F.max(F.struct("w", "g")).over(held)["g"].alias("hub"))
        .filter("holders > 1").groupBy("hub", "g").agg(F.count("*").alias("k")))
    parts = [F.col("parity")[i].alias(f"s{i}") for i in range(PARITY_WORDS)]
    known = cut_lineage(some.select("g", "n", "wide", *parts).join(sized(members.select("g").distinct()), "g", "left_semi")
                        .distinct())
    links = verified(docs, some, star_pairs(members, known, num, den), nodes, n, num, den)
    roots = connected(links)
    crossing = crossing_pairs(members, known, roots, num, den)
    links = links.unionByName(verified(docs, some, crossing, nodes, n, num, den))
    roots = connected(links).select(F.col("node").alias("g"), "root")
    named = (nodes.join(roots, "g", "left").withColumn("root", F.coalesce("root", "g")))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min("lead").alias("lead"))
    named = named.drop("lead").join(smallest, "root").select("g", "component_id", "lead")
    return (rows.select("doc_id", "h", "n", "g").join(named, "g", "left")
            .select("doc_id", F.col("h").alias("text_hash"), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    F.when(F.col("n") > 0, F.col("lead")).alias("lead")))


def row_key(doc_id: str, text_hash: str) -> Column:
    """Tells rows with different ids or texts apart; rows without an id sort last."""
    return F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("doc_id"),
                    F.col(text_hash).alias("text_hash"))


def star_pairs(members: DataFrame, known: DataFrame, num: int, den: int) -> DataFrame:
    """Each node with the hub that shares most tokens with it, if they may link."""
    best = (members.filter("g <> hub").groupBy("g").agg(F.max(F.struct("k", "hub")).alias("m"))
            .select("g", F.col("m.hub").alias("hub")))
    return (best.alias("p").join(known.alias("x"), F.col("p.g") == F.col("x.g"))
            .join(known.alias("y"), F.col("p.hub") == F.col("y.g"))
            .filter(may_link("x", "y", num, den)).select(F.col("x.g").alias("a"), F.col("y.g").alias("b")))


def crossing_pairs(members: DataFrame, known: DataFrame, roots: DataFrame, num: int, den: int) -> DataFrame:
    """Nodes under one hub that are still in different components and may link."""
    root = roots.select(F.col("node").alias("g"), "root")
    of = members.select("hub", "g").join(root, "g", "left").withColumn("root", F.coalesce("root", "g"))
    of_hub = of.filter("hub = g").select("hub", F.col("root").alias("hub_root"))
    split = of.groupBy("hub").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1")
    under = cut_lineage(of.join(split.select("hub"), "hub").join(of_hub, "hub")
                        .withColumn("stray", F.col("root") != F.col("hub_root")).drop("hub_root"))
    under = under.join(known, "g")
    x, y = under.filter("stray").alias("x"), under.alias("y")
    once = ~F.col("y.stray") | (F.col("x.g") < F.col("y.g"))
    return (x.join(y, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.root") != F.col("y.root")) & once
                   & may_link("x", "y", num, den))
            .select(F.col("x.g").alias("a"), F.col("y.g").alias("b")))
