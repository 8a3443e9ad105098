"""Language identification with language-bitmask n-gram filters.

Every language has a profile, its most frequent n-grams of ``GRAM`` bytes in lower-cased text where
anything but letters is a space. One Bloom filter per language holds a profile; the filters have
the same size and hash functions and are kept bit-sliced: slot s has a bit per language. Reading
the slots of an n-gram and combining them with AND gives all languages that contain it. The bits
are counted per language over a text, corrected for the false positives that the fill of the
filter predicts, and the largest share of n-grams decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .batches import appended, small_batches
from .common import cut_lineage

GRAM = 4
HASHES = 3
# Distinct n-grams of one language that a task counts before it hands them over.
MAX_GRAMS = 1 << 18
SLOTS = 1 << 18
UNKNOWN = "und"
# ASCII letters stay, other bytes of several-byte characters too; the rest becomes a space.
SPACED = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
# Multipliers of the hash functions, odd 64-bit numbers.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of all texts as 32-bit numbers, and the row of each.

    A text is put between two spaces. N-grams with two spaces side by side are left out.
    """
    blocks = [b" " + t.lower().encode("utf-8", "replace").translate(SPACED) + b" " for t in texts]
    data = np.frombuffer(b"".join(blocks), dtype=np.uint8)
    rows = np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
    if len(data) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    n = len(data) - GRAM + 1
    code = np.zeros(n, dtype=np.uint32)
    for k in range(GRAM):
        code = (code << np.uint32(8)) | data[k:k + n]
    space = data == 32
    double = space[:-1] & space[1:]
    good = rows[:n] == rows[GRAM - 1:]
    for k in range(GRAM - 1):
        good &= ~double[k:k + n]
    return code[good], rows[:n][good]


def gram_counts(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all rows of ``docs (text, lang)``; each task counts what it reads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by_lang.setdefault(lang, []).append(text or "")
            for lang in sorted(by_lang):
                for texts in chunks(by_lang[lang]):
                    part = np.unique(grams(texts)[0], return_counts=True)
                    totals[lang] = merged(totals[lang], part) if lang in totals else part
                    if len(totals[lang][0]) > MAX_GRAMS:  # bounded memory: hand over and start anew
                        yield counted(lang, *totals.pop(lang))
        for lang, total in totals.items():
            yield counted(lang, *total)

    schema = "lang string, gram long, n long"
    return (small_batches(docs.select("text", "lang")).mapInArrow(run, schema)
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def merged(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([a[0], b[0]])
    keys, where = np.unique(codes, return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([a[1], b[1]]), minlength=len(keys)).astype(np.int64)


def counted(lang: str, codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))],
        names=["lang", "gram", "n"])


@dataclass(frozen=True)
class Filters:
    """Bit-sliced filters: ``slots[s, w]`` holds the bits of languages 64 w to 64 w + 63."""

    langs: tuple[str, ...]
    slots: np.ndarray
    false_rate: np.ndarray

    def masks(self, code: np.ndarray) -> np.ndarray:
        out = None
        for m in MULTIPLIERS[:HASHES]:
            found = self.slots[slot(code, m)]
            out = found if out is None else out & found
        return out


def slot(code: np.ndarray, multiplier: np.uint64) -> np.ndarray:
    return ((code.astype(np.uint64) + np.uint64(1)) * multiplier) >> np.uint64(64 - SLOTS.bit_length() + 1)


def train(docs: DataFrame, profile: int = 4096) -> Filters:
    """Filters from ``docs (text, lang)``; rows with NULL text or language teach nothing.

    Counts cover all rows. The profile of a language is its ``profile`` most frequent n-grams, ties
    to the smaller code, so the driver gets at most ``profile`` numbers per language. Runs jobs.
    """
    counts = cut_lineage(gram_counts(docs.filter("text is not null and lang is not null")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = (counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= profile)
           .groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect())
    langs = tuple(sorted(r["lang"] for r in top))
    slots = np.zeros((SLOTS, max(1, -(-len(langs) // 64))), dtype=np.uint64)
    for row in top:
        i = langs.index(row["lang"])
        code = np.array(row["grams"], dtype=np.uint32)
        for m in MULTIPLIERS[:HASHES]:
            slots[slot(code, m), i // 64] |= np.uint64(1) << np.uint64(i % 64)
    fill = [float(np.mean((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1))) for i in range(len(langs))]
    return Filters(langs, slots, np.array(fill) ** HASHES)


def decide(filters: Filters, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, its part of all languages' n-grams, and the part of the n-grams that it covers."""
    n, langs = len(texts), filters.langs
    code, rows = grams([t or "" for t in texts])
    total = np.bincount(rows, minlength=n).astype(float)
    hits = np.zeros((len(langs), n))
    if len(code) and langs:
        masks = filters.masks(code)
        for i in range(len(langs)):
            bit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits[i] = np.bincount(rows, weights=bit, minlength=n)
        fp = filters.false_rate[:, None]
        hits = np.maximum(0.0, (hits - total * fp) / (1.0 - fp))
    known = np.array([t is not None and has_letter(t) for t in texts], dtype=bool) & bool(langs)
    if not langs:
        return [UNKNOWN] * n, np.zeros(n), np.zeros(n)
    best = hits.argmax(axis=0)
    top = hits[best, np.arange(n)]
    score = np.where(known & (top > 0), top / np.maximum(hits.sum(axis=0), 1e-300), 0.0)
    cover = np.where(known, np.minimum(1.0, top / np.maximum(total, 1.0)), 0.0)
    return [langs[b] if k else UNKNOWN for b, k in zip(best, known)], np.clip(score, 0.0, 1.0), cover


# Characters of texts that are looked at together; each takes dozens of bytes meanwhile.
CHARS = 1 << 18


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """``docs`` with ``lang_pred, score, coverage``, from ``text`` alone.

    ``und`` with score 0 where the text is NULL or has no letter, or where nothing was learned. A
    text with letters but none of the known n-grams gets the first language with score 0. Columns
    that have those names are replaced; rows are independent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # fixed size: SLOTS words per 64 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, scores, covers = [], [], []
            for part in chunks(texts):
                a, b, c = decide(shared.value, part)
                langs += a
                scores.append(b)
                covers.append(c)
            join = lambda x: np.concatenate(x) if x else np.zeros(0)
            yield appended(batch, {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(join(scores)),
                                   "coverage": pa.array(join(covers))})

    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
           T.StructField("coverage", T.DoubleType())]
    kept = [f for f in docs.schema.fields if f.name not in {x.name for x in new}]
    return small_batches(docs).mapInArrow(run, T.StructType(kept + new))


def chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def held_out(doc_id: Column) -> Column:
    """The fold of the contract: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
