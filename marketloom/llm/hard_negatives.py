"""Hard negatives by inner product, with coordinate pruning of length buckets.

Vectors of one label are put in buckets of similar length. In a bucket every coordinate has its
sorted list of (normalised) values. What an anchor wants from a bucket is a score of at least some
threshold; divided by the anchor's length and the bucket's greatest length that is a least
cosine. A bucket that cannot reach it is never visited. In the others the least cosine bounds the
angle to the anchor, hence the value range of each coordinate: the slices of the sorted lists of
the anchor's focus coordinates (its largest) are intersected, and only rows in all of them are
scored, exactly, in integers.

Anchors are a stated query set; each is sent to the buckets it may find something in, in blocks,
and a bucket sends back no more than the rows asked for per anchor and positive.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import batches_of
from .common import cut_lineage

SCALE = 256.0
# Numbers in a bucket (rows times dimensions): with their sorted lists they take about 24 MB.
BUCKET_VALUES = 1 << 20
# Anchors that meet a bucket in one task.
ANCHOR_ROWS = 2048
FOCUS = 4
# Tables of buckets up to this number of rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
# Rounding of cosines must never exclude a row: bounds are widened by this.
MARGIN = 1e-9
# Stands for a missing id, so that ids stay integers in tasks and missing ones come last.
NO_ID = (1 << 63) - 1
# Scores have to fit a long: vectors of greater squared length take no part.
LONGEST = float(1 << 62)


def quantized(rows: DataFrame, flip: int | None = 7, classes: int = 10) -> DataFrame:
    """Distinct rows with their components as 64-bit integers, floor(256 x).

    Rows with a NULL label, a NULL or empty vector or a NULL or non-finite component, or whose
    squared length does not fit 62 bits, take no part. Where ``flip`` divides vec_id the label moves
    on by one (modulo ``classes``). Rows that repeat id, label and vector are one row.
    """
    label = F.col("label").cast("long")
    if flip:
        label = F.when(F.col("vec_id") % flip == 0, (label + 1) % classes).otherwise(label)
    # NaN is greater than infinity here.
    good = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    source = (rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"),
                          F.col("embedding").cast("array<double>").alias("v"))
              .filter(F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & good)
              .withColumn("q", F.transform("v", lambda x: F.floor(x * F.lit(SCALE)).cast("double")))
              .withColumn("norm", F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x))
              .filter(F.col("norm") < LONGEST)
              .select(F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "label", F.size("q").alias("dims"), "norm",
                      F.transform("q", lambda x: x.cast("long")).alias("q")).distinct())
    return source.withColumn("key", F.xxhash64("vec_id", "label", "q"))


# ---------------------------------------------------------------- buckets

def bucketed(rows: DataFrame, bucket_values: int = BUCKET_VALUES) -> DataFrame:
    """Adds ``bucket``: rows of one label, dimension and length class, bounded in number.

    Length classes rise by 2 %; those with many rows (copies, or vectors of unit length) are split
    by a hash into as many buckets as they need, and neighbouring small ones are put together.
    """
    kind = rows.withColumn("cell", F.floor(16 * F.log2(F.col("norm") + 1.0)))
    cells = kind.groupBy("label", "dims", "cell").agg(F.count("*").alias("n"))
    # Hashed buckets vary in size: four fifths leave room.
    depth = F.greatest(F.lit(1), F.floor(F.lit(bucket_values) * 0.8 / F.col("dims")))
    by_kind = Window.partitionBy("label", "dims").orderBy(F.desc("cell"))
    cells = (cells.withColumn("split", F.ceil(F.col("n") / depth))
             .withColumn("before", F.sum(F.when(F.col("n") < depth, F.col("n")).otherwise(depth)).over(by_kind) - 1)
             .select(F.col("label").alias("_label"), F.col("dims").alias("_dims"), F.col("cell").alias("_cell"), "split",
                     F.when(F.col("split") > 1, -1 - F.col("cell")).otherwise(F.floor(F.col("before") / depth)).alias("group")))
    cells = cut_lineage(cells)
    if cells.count() <= BROADCAST_ROWS:
        cells = F.broadcast(cells)
    same = (F.col("label") == F.col("_label")) & (F.col("dims") == F.col("_dims")) & (F.col("cell") == F.col("_cell"))
    return (kind.join(cells, same)
            .withColumn("bucket", F.xxhash64("label", "dims", "group", F.pmod("key", "split")))
            .drop("_label", "_dims", "_cell", "cell", "split", "group"))


class Bucket:
    """Rows of a bucket with a sorted list per coordinate, made when it is first asked for."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        # Scores are sums of integers: exact in doubles as long as they stay below 2^53.
        self.small = float(np.abs(vectors).max(initial=0)) ** 2 * vectors.shape[1] < 2.0**52
        self.floats = vectors.astype(np.float64)
        norm = np.sqrt((self.floats**2).sum(axis=1))
        self.longest = float(norm.max(initial=0.0))
        self.unit = self.floats / np.where(norm == 0, 1.0, norm)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    def candidates(self, anchor: np.ndarray, least: float, focus: int) -> np.ndarray:
        """Rows that may score ``least`` or more: the intersection of the feasible ranges."""
        norm = float(np.sqrt((anchor.astype(np.float64)**2).sum()))
        everything = np.arange(len(self.ids))
        if norm == 0 or self.longest == 0:
            return everything if least <= 0 else everything[:0]
        cosine = least / (norm * self.longest) - MARGIN
        if cosine > 1:
            return everything[:0]
        if cosine <= 0:
            # Shorter rows may have any angle then.
            return everything
        unit = anchor / norm
        angle = np.arccos(min(1.0, cosine))
        ranges = []
        for f in np.argsort(-np.abs(unit), kind="stable")[:focus]:
            own = np.arccos(np.clip(unit[f], -1, 1))
            low = np.cos(min(np.pi, own + angle)) - MARGIN
            high = np.cos(max(0.0, own - angle)) + MARGIN
            order, values = self.sorted_list(int(f))
            a, b = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            ranges.append((b - a, int(f), a, b, low, high))
        # The shortest slice first; a row of it is in another slice if its value is in that range.
        ranges.sort()
        _, f, a, b, _, _ = ranges[0]
        found = self.lists[f][0][a:b]
        for _, f, _, _, low, high in ranges[1:]:
            values = self.unit[found, f]
            found = found[(values >= low) & (values <= high)]
        return np.sort(found)

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.small and float(np.abs(anchor).max(initial=0)) ** 2 * len(anchor) < 2.0**52:
            picked = self.floats if len(rows) == len(self.ids) else self.floats[rows]
            return (picked @ anchor.astype(np.float64)).astype(np.int64)
        return self.vectors[rows] @ anchor


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k best: higher score first, then smaller id (a missing id last)."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def meet(rows: DataFrame, wanted: DataFrame, look, schema: str) -> DataFrame:
    """Runs ``look(bucket, anchors)`` where a bucket meets a block of the anchors sent to it.

    ``wanted``: bucket, block and the anchor's columns. A bucket is sent to each block that wants it.
    """
    wanted = cut_lineage(wanted)
    blocks = wanted.select(F.col("bucket").alias("_bucket"), F.col("block").alias("_block")).distinct()
    sent = rows.join(blocks, F.col("bucket") == F.col("_bucket")).select("bucket", F.col("_block").alias("block"), "vec_id", "q")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame()
        return look(Bucket(left["vec_id"].to_numpy(dtype=np.int64), np.stack(left["q"].to_list()).astype(np.int64)), right)

    return (sent.groupBy("bucket", "block").cogroup(wanted.groupBy("bucket", "block"))
            .applyInPandas(run, schema))


# ---------------------------------------------------------------- mining

def mine(rows: DataFrame, anchors: Column | None = None, n_positives: int = 5, n_negatives: int = 5,
         num: int = 80, den: int = 100, flip: int | None = 7, classes: int = 10, focus: int = FOCUS,
         bucket_values: int = BUCKET_VALUES, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows``: vec_id, label, embedding (see :func:`quantized` for who takes part). Anchors are the rows
    that ``anchors`` (a condition on vec_id, by default divisible by 100) picks. The positives of an
    anchor are the best rows of its label under another id; the negatives of a pair the best rows
    of other labels (and ids) with num/den * positive_score <= negative_score <= positive_score. Equal
    scores go by smaller id, missing ids last. Only vectors of one dimension are compared. Rows of one id
    with unlike vectors are rows of their own; as anchors each finds its own positives. Fewer than
    asked for are returned as they are; without rows the result is empty.
    """
    spark = rows.sparkSession
    table = cut_lineage(bucketed(quantized(rows, flip, classes), bucket_values))
    pick = F.col("vec_id") % 100 == 0 if anchors is None else anchors
    pick = pick & (F.col("vec_id") < NO_ID)
    # A bucket's greatest length decides who visits it.
    buckets = cut_lineage(table.groupBy("bucket").agg(
        F.first("label").alias("b_label"), F.first("dims").alias("b_dims"), F.sqrt(F.max("norm")).alias("longest")))
    few = buckets.count() <= BROADCAST_ROWS
    buckets = F.broadcast(buckets) if few else buckets
    chosen = table.filter(pick)
    n_blocks = max(1, -(-chosen.count() // anchor_rows))
    chosen = cut_lineage(chosen.select("vec_id", "key", "label", "dims", F.sqrt("norm").alias("length"), F.col("bucket").alias("home"),
                                       F.col("q").alias("anchor"), F.pmod("key", F.lit(n_blocks)).alias("block")))
    with batches_of(spark, 10_000):
        best = cut_lineage(_positives(table, buckets, chosen, n_positives, focus))
        return cut_lineage(_negatives(table, buckets, chosen, best, n_negatives, num, den, focus))


def _nearest(bucket: Bucket, anchors: pd.DataFrame, k: int, focus: int) -> pd.DataFrame:
    out = []
    for a in anchors.itertuples(index=False):
        anchor = np.asarray(a.anchor, dtype=np.int64)
        least = -np.inf if pd.isna(a.least) else float(a.least)
        found = bucket.candidates(anchor, least, focus) if np.isfinite(least) else np.arange(len(bucket.ids))
        found = found[bucket.ids[found] != a.vec_id]
        scores = bucket.scores(anchor, found)
        top = first(scores, bucket.ids[found], k)
        out.append(pd.DataFrame({"anchor_id": a.vec_id, "anchor_key": a.key, "row_id": bucket.ids[found[top]], "score": scores[top]}))
    return pd.concat(out)


FOUND = "anchor_id long, anchor_key long, row_id long, score long"


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _positives(table: DataFrame, buckets: DataFrame, chosen: DataFrame, k: int, focus: int) -> DataFrame:
    """The k best rows of each anchor's label: first its home bucket, then those that can beat what was found there."""
    look = lambda bucket, anchors: _nearest(bucket, anchors, k, focus)
    own = chosen.select(F.col("home").alias("bucket"), "block", "vec_id", "key", "anchor", F.lit(None).cast("long").alias("least"))
    home = cut_lineage(meet(table, own, look, FOUND))
    bound = home.groupBy("anchor_key").agg(F.count("*").alias("n"), F.min("score").alias("low")).select(
        "anchor_key", F.when(F.col("n") >= k, F.col("low")).alias("least"))
    known = chosen.join(bound, F.col("key") == F.col("anchor_key"), "left").drop("anchor_key")
    there = ((F.col("label") == F.col("b_label")) & (F.col("dims") == F.col("b_dims")) & (F.col("home") != F.col("bucket"))
             & (F.col("least").isNull() | (F.col("length") * F.col("longest") * (1 + MARGIN) >= F.col("least"))))
    others = known.join(buckets, there).select("bucket", "block", "vec_id", "key", "anchor", "least")
    return _top(home.unionByName(meet(table, others, look, FOUND)), ["anchor_key"], k)


def _negatives(table: DataFrame, buckets: DataFrame, chosen: DataFrame, positives: DataFrame, k: int,
               num: int, den: int, focus: int) -> DataFrame:
    # A negative positive score leaves nothing between num/den of it and itself.
    pairs = positives.filter("score >= 0").select(
        "anchor_key", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"))
    per_anchor = pairs.groupBy("anchor_key").agg(
        F.array_sort(F.collect_list("positive_score")).alias("limits"), F.min("positive_score").alias("low"))
    known = chosen.join(per_anchor, F.col("key") == F.col("anchor_key")).drop("anchor_key")
    there = ((F.col("label") != F.col("b_label")) & (F.col("dims") == F.col("b_dims"))
             & (F.col("length") * F.col("longest") * (1 + MARGIN) * den >= F.col("low") * num))
    wanted = known.join(buckets, there).select("bucket", "block", "vec_id", "key", "anchor", "limits")

    def look(bucket: Bucket, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a in anchors.itertuples(index=False):
            anchor = np.asarray(a.anchor, dtype=np.int64)
            limits = sorted({int(x) for x in a.limits})
            found = bucket.candidates(anchor, limits[0] * num / den - 1, focus)
            found = found[bucket.ids[found] != a.vec_id]
            scores = bucket.scores(anchor, found)
            for limit in limits:
                # Integers of any size on the right, so that nothing overflows.
                lowest = -(-limit * num // den)
                ok = np.flatnonzero((scores <= limit) & (scores >= lowest))
                top = ok[first(scores[ok], bucket.ids[found[ok]], k)]
                if len(top):
                    out.append(pd.DataFrame({"anchor_id": a.vec_id, "anchor_key": a.key, "positive_score": limit,
                                             "row_id": bucket.ids[found[top]], "score": scores[top]}))
        return pd.concat(out) if out else pd.DataFrame()

    found = _top(meet(table, wanted, look, FOUND + ", positive_score long"), ["anchor_key", "positive_score"], k)
    missing = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return found.join(pairs, ["anchor_key", "positive_score"]).select(
        "anchor_id", missing("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        missing("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
