"""Document fingerprints from closed syncmers.

A k-mer of a text is a closed syncmer if the smallest of its inner s-mers (by hash, leftmost on
ties) is the first or the last one. That depends on the k-mer alone, so an edit changes anchors
around it only, and every window of k - s + 1 k-mers holds one. Each anchor is an id (the k-mer's
hash) with a place. A fingerprint keeps every distinct anchor of the text, each with its first place.

Two fingerprints are likened on all their anchors: the part of them that both hold, at places that
agree with the common shift, is counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import small_batches

K, S = 24, 12
# Characters that a place may be off the common shift.
TOLERANCE = 256
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0x100000001B3)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n code points."""
    size = len(codes) - n + 1
    out = np.zeros(size, dtype=np.uint64)
    for i in range(n):
        out = out * BASE + codes[i:i + size]
    return mixed(out)


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and places of the closed syncmers; a text shorter than K is one anchor, an empty one none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    if len(codes) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(codes) < K:
        return rolling(codes, len(codes)), np.zeros(1, np.int64)
    inner = rolling(codes, S)
    width = K - S + 1
    # Minima over windows by doubling: windows of 8 twice cover 13.
    low, span = inner, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    n = len(codes) - K + 1
    low = np.minimum(low[:n], low[width - span:width - span + n])
    edge = (inner[:n] == low) | (inner[width - 1:width - 1 + n] == low)
    at = np.flatnonzero(edge)
    ids = np.zeros(len(at), dtype=np.uint64)
    for i in range(K):
        ids = ids * BASE + codes[at + i]
    return mixed(ids), at


Print = tuple[np.ndarray, np.ndarray]


def fingerprint(text: str) -> Print:
    """All distinct anchors: ids ascending, and the first place of each."""
    ids, at = anchors(text)
    ids, first = np.unique(ids, return_index=True)
    return ids, at[first]


def likeness(a: Print, b: Print) -> float:
    """Share of distinct anchors in common, at consistent places; 1 for equal fingerprints.

    Two empty texts are alike (1), an empty and another one are not (0). An anchor counts if its
    shift is within ``TOLERANCE`` characters of the median shift.
    """
    if len(a[0]) == 0 or len(b[0]) == 0:
        return float(len(a[0]) == len(b[0]))
    both, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    shift = a[1][ia] - b[1][ib]
    near = np.abs(shift - np.median(shift)) <= TOLERANCE
    return float(near.sum() / (len(a[0]) + len(b[0]) - len(both)))


def printed(f: Print) -> str:
    """As hexadecimal text: 16 digits for the id up to which none is missing (the largest there can be),
    16 for every id, then 8 for every place."""
    return "f" * 16 + f[0].astype(">u8").tobytes().hex() + f[1].astype(">u4").tobytes().hex()


def with_successors(docs: DataFrame, buckets: int) -> DataFrame:
    """``doc_id, text, bucket, halo``: consecutive documents share a bucket, with their successor.

    The first document of every bucket also comes, as halo, in the bucket before; the very first one
    closes the last bucket. Order is doc_id (NULL first), then text. One number per bucket passes
    the driver.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chances = [i / buckets for i in range(1, buckets)]
    cuts = sorted({int(c) for c in docs.select("doc_id").approxQuantile("doc_id", chances, 0.5 / buckets)})
    # The bucket is the number of cuts at or below the id; NULL ids are in the first.
    bucket = F.lit(0)
    if cuts:
        bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(
            F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("doc_id"))))
    rows = docs.withColumn("bucket", bucket.cast("int"))
    firsts = rows.groupBy("bucket").agg(F.min("doc_id").alias("doc_id"),
                                        F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    found = sorted((r["bucket"], None if r["nulls"] else r["doc_id"]) for r in firsts.collect())
    if not found:
        return rows.withColumn("halo", F.lit(False))
    before = {b: found[i - 1][0] for i, (b, _) in enumerate(found)}
    # A handful of rows: those of the first id of a bucket; the smallest text, if the id is repeated.
    halo = F.col("doc_id").isin([doc_id for _, doc_id in found if doc_id is not None])
    if any(doc_id is None for _, doc_id in found):
        halo = halo | F.col("doc_id").isNull()
    heads = rows.filter(halo).groupBy("bucket", "doc_id").agg(F.min("text").alias("text"))
    order = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first()))
    pairs = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    heads = (heads.withColumn("_n", order).filter("_n = 1")
             .select("doc_id", "text", pairs[F.col("bucket")].alias("bucket"), F.lit(True).alias("halo")))
    return rows.withColumn("halo", F.lit(False)).unionByName(heads)


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs (doc_id, text)`` and of its edited text.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of
    the next document. Result: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. NULL texts count as empty; a single document is its own successor;
    repeated ids follow each other in order of their texts; an empty table gives no rows. Runs two
    small jobs while it is called.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, last = None, None
        for batch in batches:
            out = []
            columns = (batch.column(n).to_pylist() for n in ("doc_id", "text", "bucket"))
            for (doc_id, text, here), halo in zip(zip(*columns), batch.column("halo").to_pylist()):
                now = (doc_id, text, fingerprint(text))
                if last is not None and here == bucket:
                    out.append(compared(last, now))
                bucket, last = here, None if halo else now
            yield pa.RecordBatch.from_pylist(out, schema=RESULT)

    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (with_successors(docs, buckets).repartition("bucket")
            .sortWithinPartitions("bucket", "halo", "doc_id", "text"))
    return small_batches(rows).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")


RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                    ("near_edited", pa.float64()), ("near_next", pa.float64())])


def compared(row: tuple, after: tuple) -> dict:
    doc_id, text, own = row
    half = len(text) // 2
    edited = text[:len(text) - half] + after[1][:half]
    other = own if edited == text else fingerprint(edited)
    return {"doc_id": doc_id, "n_chars": len(text),
            "edited_sha256": hashlib.sha256(edited.encode("utf-8")).hexdigest(),
            "fingerprint": printed(own), "edited_fingerprint": printed(other),
            "near_edited": likeness(own, other), "near_next": likeness(own, after[2])}
