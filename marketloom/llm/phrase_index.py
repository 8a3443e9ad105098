"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of shards: each holds some documents laid one after the other on a line of
word places (with an empty place between them), and for each of their terms the sorted list of
its places. Shards are built where the documents are read, so no term, however frequent, is
gathered from all documents. A window of benchmark words is looked up from its rarest term in the
shard: that list, moved back by the term's place in the window, gives candidate starts, which are
intersected with the moved lists of the next rarest terms until all words agree. All windows are
taken together in array operations.

Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters, and stand as
64-bit hashes; a wrong match needs equal hashes of unlike words at every place of a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import batches_of
from .common import cut_lineage, scratch_path

WINDOW = 10
# A proximity match may hold so many more words than its window.
SLACK = 5
# Words of a shard: its lists and one sort fit into a task's memory. A longer document is a shard alone.
SHARD_WORDS = 1 << 21
# Benchmark text sent to all tasks at once; a larger benchmark goes through the index block by block.
BLOCK_BYTES = 2 << 20
# Row groups of the index: a reader holds one as a whole, with two levels a value, so a full shard is one alone.
GROUP_BYTES = 4 << 20
# Candidates held at once.
STEP = 1 << 20
# Windows ranked at once, and documents in a batch of results.
ROWS = 1 << 16
PIECE = 1 << 20

_TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
               for b in range(256))
_LOW = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, dtype=np.uint64))
_MIX = np.uint64(0xFF51AFD7ED558CCD)

INDEX_SCHEMA = ("shard string, doc_ids array<bigint>, n_words array<int>, terms array<bigint>, counts array<int>, "
                "steps array<int>")


# ------------------------------------------------------------------ words

def _pieces(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Cuts at spaces, so that no word is cut."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            cut = raw.rfind(b" ", at, end)
            cut = raw.find(b" ", end) if cut <= at else cut
            end = len(raw) if cut < 0 else cut
        yield at, raw[at:end]
        at = max(end, at + 1)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, number of words of each text)."""
    raw = b" ".join(texts).translate(_TABLE)
    hashes, places = [], []
    for base, piece in _pieces(raw):
        inside = np.frombuffer(piece, dtype=np.uint8) != 0x20
        edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
        first, length = edges[::2], edges[1::2] - edges[::2]
        if not len(first):
            continue
        body = np.frombuffer(piece, dtype=np.uint8)[inside].astype(np.uint64) + np.uint64(1)
        heads = np.concatenate(([0], np.cumsum(length)[:-1]))
        rank = np.arange(len(body)) - np.repeat(heads, length)
        power = _LOW[rank & 0xFFFF]
        if rank.max() >> 16:
            # Factor 1 for the first 65,536 bytes, so that a word's hash does not depend on its neighbours.
            high = np.full((int(rank.max()) >> 16) + 1, _LOW[-1])
            high[0] = 1
            power = power * np.cumprod(high)[rank >> 16]
        h = np.add.reduceat(body * power, heads) + length.astype(np.uint64)
        h = (h ^ (h >> np.uint64(33))) * _MIX
        hashes.append(h ^ (h >> np.uint64(29)))
        places.append(first + base)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    if not hashes:
        return np.empty(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    return np.concatenate(hashes).view(np.int64), np.diff(np.searchsorted(np.concatenate(places), starts))


# ------------------------------------------------------------------ index

def _one(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _shard(name: str, ids: list, counts: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
    n_words = np.concatenate(counts)
    line = np.concatenate(hashes)
    place = np.arange(len(line), dtype=np.int64) + np.repeat(np.arange(len(n_words)), n_words)
    order = np.argsort(line, kind="stable")
    line = line[order]
    heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(line)), dtype=bool), line[1:] != line[:-1])))
    steps = np.diff(place[order], prepend=0)
    return pa.RecordBatch.from_arrays([
        pa.array([name]), _one(ids, pa.int64()), _one(n_words.astype(np.int32), pa.int32()),
        _one(line[heads], pa.int64()), _one(np.diff(np.append(heads, len(line))).astype(np.int32), pa.int32()),
        _one(steps.astype(np.int32), pa.int32())], ["shard", "doc_ids", "n_words", "terms", "counts", "steps"])


def build_index(docs: DataFrame, path: str, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Writes the index of ``docs`` (doc_id, text) to ``path`` and returns it.

    Every row is a document of its own, also one that repeats an id or has none; NULL text has no
    words. Each list of places is stored as steps from the place before it. A shard has at most
    ``shard_words`` words and documents together, or one document.
    """
    def run(batches):
        ids, counts, hashes, held, made = [], [], [], 0, 0
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            line, sizes = words(texts)
            at = 0
            doc_ids = batch.column(0).to_pylist()
            ends = np.cumsum(sizes)
            # A document without words takes room too.
            room = ends + np.arange(1, len(ends) + 1)
            while at < len(texts):
                # As many documents as fit, at least one.
                before, taken = (int(ends[at - 1]), int(room[at - 1])) if at else (0, 0)
                upto = max(at + 1, int(np.searchsorted(room, taken + shard_words - held, side="right")))
                ids += doc_ids[at:upto]
                counts.append(sizes[at:upto])
                hashes.append(line[before:int(ends[upto - 1])])
                held += int(room[upto - 1]) - taken
                at = upto
                if at < len(texts) or held >= shard_words:
                    yield _shard(f"{TaskContext.get().partitionId()}-{made}", ids, counts, hashes)
                    ids, counts, hashes, held, made = [], [], [], 0, made + 1
        if ids:
            yield _shard(f"{TaskContext.get().partitionId()}-{made}", ids, counts, hashes)

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with batches_of(spark, 2000, "8m"):
        _write(rows.mapInArrow(run, INDEX_SCHEMA), path)
    return read_index(docs.sparkSession, path)


def _write(shards: DataFrame, path: str) -> None:
    """Writes rows that hold a shard each. The writer looks at its size after every row, not after 100.

    Terms are distinct and steps seldom repeat enough: a dictionary would be filled first and then given up.
    """
    (shards.write.option("compression", "zstd").option("parquet.block.size", str(GROUP_BYTES))
     .option("parquet.enable.dictionary#terms.list.element", "false").option("parquet.enable.dictionary#steps.list.element", "false")
     .option("parquet.page.size.row.check.min", "1").option("parquet.page.size.row.check.max", "1").parquet(path))


def read_index(spark, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(path)


# ---------------------------------------------------------------- windows

@dataclass(frozen=True)
class Windows:
    """Distinct windows by length, as rows of term numbers, and the items that hold each."""

    terms: np.ndarray
    rows: dict[int, np.ndarray]
    items: dict[int, list[np.ndarray]]

    @staticmethod
    def of(texts: list[str], ids: list[int], window: int) -> Windows:
        line, sizes = words([t.encode() for t in texts])
        terms, line = np.unique(line, return_inverse=True)
        held: dict[int, dict[bytes, set[int]]] = {}
        at = 0
        for item, size in zip(ids, sizes.tolist()):
            n = min(size, window)
            for k in range(at, at + size - n + 1 if n else at):
                held.setdefault(n, {}).setdefault(line[k:k + n].astype(np.int64).tobytes(), set()).add(item)
            at += size
        rows = {n: np.frombuffer(b"".join(ws), dtype=np.int64).reshape(-1, n) for n, ws in held.items()}
        items = {n: [np.array(sorted(s), dtype=np.int64) for s in ws.values()] for n, ws in held.items()}
        return Windows(terms, rows, items)


class Shard:
    """Lists of one shard, restricted to what windows ask for."""

    def __init__(self, row: dict, terms: np.ndarray):
        self.n_words = row["n_words"].astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.n_words + 1)))
        self.size = int(self.first[-1])
        ends = np.cumsum(row["counts"].astype(np.int64))
        self.places = np.cumsum(row["steps"].astype(np.int64))
        if len(row["terms"]):
            found = np.searchsorted(row["terms"], terms)
            there = row["terms"][np.minimum(found, len(row["terms"]) - 1)] == terms
            found = np.where(there, np.minimum(found, len(ends) - 1), 0)
            self.low = np.where(there, ends[found] - row["counts"][found], 0)
            self.high = np.where(there, ends[found], 0)
        else:
            self.low = self.high = np.zeros(len(terms), dtype=np.int64)
        self.rank = np.where(self.high > self.low, self.low, -1)
        # One sorted array of (list, place): a list is named by where it begins.
        lengths = np.diff(np.concatenate(([0], ends)))
        self.keys = (np.repeat(ends - lengths, lengths) << 32) | self.places

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        wanted = (self.rank[term] << 32) | place
        at = np.searchsorted(self.keys, wanted)
        return self.keys[np.minimum(at, len(self.keys) - 1)] == wanted

    def next_place(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first place of the term at or after ``place``; beyond the line if there is none."""
        at = np.searchsorted(self.keys, (self.rank[term] << 32) | np.maximum(place, 0))
        key = self.keys[np.minimum(at, len(self.keys) - 1)]
        return np.where((at < len(self.keys)) & (key >> 32 == self.rank[term]), key & 0xFFFFFFFF, self.size + (1 << 30))

    def candidates(self, rows: np.ndarray):
        """Windows whose terms all occur, in steps: (windows, numbers in what follows, terms from the rarest, their offsets, places of the rarest)."""
        for base in range(0, len(rows), ROWS):
            for window, *step in self._candidates(rows[base:base + ROWS]):
                yield window + base, *step

    def _candidates(self, rows: np.ndarray):
        size = (self.high - self.low)[rows]
        alive = np.flatnonzero(size.min(axis=1) > 0) if len(self.places) else np.empty(0, dtype=np.int64)
        order = np.argsort(size[alive], axis=1, kind="stable")
        ranked = np.take_along_axis(rows[alive], order, axis=1)
        many = np.take_along_axis(size[alive], order[:, :1], axis=1)[:, 0]
        total = np.cumsum(many)
        begin = 0
        while begin < len(alive):
            done = int(total[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + STEP, side="right")))
            n = many[begin:end]
            which = np.repeat(np.arange(begin, end), n)
            nth = np.arange(int(n.sum())) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
            # One window with a list above the step is cut inside its list.
            for cut in range(0, len(which), STEP):
                w = which[cut:cut + STEP]
                yield alive[w], w, ranked, order, self.places[self.low[ranked[w, 0]] + nth[cut:cut + STEP]]
            begin = end

    def phrases(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of all exact matches."""
        out = [(np.empty(0, dtype=np.int64),) * 2]
        for window, own, term, offset, place in self.candidates(rows):
            start = place - offset[own, 0]
            keep = np.flatnonzero(start >= 0)
            for k in range(1, rows.shape[1]):
                keep = keep[self.has(term[own[keep], k], start[keep] + offset[own[keep], k])]
            out.append((window[keep], start[keep]))
        return tuple(np.concatenate(c) for c in zip(*out))

    def proximities(self, rows: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, start): the ``span`` places from a window word on hold all words of the window."""
        out = [(np.empty(0, dtype=np.int64),) * 2]
        for window, own, term, _, place in self.candidates(rows):
            keep = np.arange(len(window))
            for k in range(1, rows.shape[1]):
                # A place of the next rarest term must lie near that of the rarest.
                keep = keep[self.next_place(term[own[keep], k], place[keep] - span + 1) < place[keep] + span]
            for part in np.array_split(keep, max(1, -(-len(keep) * span // STEP))):
                start = (place[part][:, None] - np.arange(span)[None, :]).ravel()
                owner = np.repeat(part, span)
                owner, start = owner[start >= 0], start[start >= 0]
                nearest, furthest = np.full(len(start), self.size + (1 << 30)), np.zeros(len(start), dtype=np.int64)
                for k in range(rows.shape[1]):
                    at = self.next_place(term[own[owner], k], start)
                    nearest, furthest = np.minimum(nearest, at), np.maximum(furthest, at)
                ok = (nearest == start) & (furthest < start + span)
                ok &= self.document(start) == self.document(np.where(ok, furthest, start))
                out.append(tuple(np.unique(np.stack((window[owner[ok]], start[ok])), axis=1)))
        return tuple(np.concatenate(c) for c in zip(*out))

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, side="right") - 1


def _pairs(windows: Windows, n: int, shard: Shard, window: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Distinct (document, item) of matches."""
    if not len(window):
        return np.empty((0, 2), dtype=np.int64)
    doc_window = np.unique(np.stack((shard.document(start), window), axis=1), axis=0)
    lists = [windows.items[n][w] for w in doc_window[:, 1]]
    docs = np.repeat(doc_window[:, 0], [len(x) for x in lists])
    return np.stack((docs, np.concatenate(lists)), axis=1)


# ---------------------------------------------------------------- queries

MARK_SCHEMA = INDEX_SCHEMA + ", hit_from array<int>, hit_to array<int>, item_docs array<int>, items array<string>, " \
                             "near_docs array<int>, near_items array<string>"
NEW = ("hit_from", "hit_to", "item_docs", "items", "near_docs", "near_items")
FOUND_SCHEMA = "doc_id long, n_words long, spans array<struct<`start`:int,`end`:int>>, items array<string>, near_items array<string>"


def _values(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False)


def _mark(state: DataFrame, windows: Windows, names: list[str], near_words: int | None, last: bool) -> DataFrame:
    """Adds the matches of one block of windows to those of the blocks before it.

    The last block gives one row per document: the shards stay where they were read.
    """
    again = "hit_from" in state.columns

    def known(batch, i, docs, values):
        return set(zip(batch.column(docs)[i].as_py(), batch.column(values)[i].as_py())) if again else set()

    def named(pairs):
        return {(d, names[k]) for d, k in pairs.tolist()}

    def found(batch, i):
        """(merged spans on the line, sorted (document, item), the same in proximity) of a shard."""
        row = {c: _values(batch, c, i) for c in ("n_words", "terms", "counts", "steps")}
        shard = Shard(row, windows.terms)
        hits = [np.stack((_values(batch, "hit_from", i), _values(batch, "hit_to", i)), axis=1)] if again else []
        items, near = known(batch, i, "item_docs", "items"), known(batch, i, "near_docs", "near_items")
        for n, rows in windows.rows.items():
            window, start = shard.phrases(rows)
            hits.append(np.unique(np.stack((start, start + n), axis=1), axis=0))
            items |= named(_pairs(windows, n, shard, window, start))
            if near_words is not None:
                window, start = shard.proximities(rows, n + near_words)
                near |= named(_pairs(windows, n, shard, window, start))
        return _merged(np.concatenate([np.empty((0, 2), dtype=np.int64), *hits])), sorted(items), sorted(near)

    def marked(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                spans, *found_items = found(batch, i)
                new = [_one(spans[:, 0].astype(np.int32), pa.int32()), _one(spans[:, 1].astype(np.int32), pa.int32())]
                for pairs in found_items:
                    new += [pa.array([[d for d, _ in pairs]], pa.list_(pa.int32())), pa.array([[v for _, v in pairs]], pa.list_(pa.string()))]
                old = [batch.column(c).slice(i, 1) for c in INDEX_COLUMNS]
                yield pa.RecordBatch.from_arrays(old + new, [*INDEX_COLUMNS, *NEW])

    def per_document(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _documents(batch.column("doc_ids")[i].values, _values(batch, "n_words", i).astype(np.int64), *found(batch, i))

    return state.mapInArrow(per_document, FOUND_SCHEMA) if last else state.mapInArrow(marked, MARK_SCHEMA)


INDEX_COLUMNS = [c.strip().split(" ")[0] for c in INDEX_SCHEMA.split(", ")]


def _merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching spans as one; in order."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    last = np.append(np.flatnonzero(head)[1:] - 1, len(spans) - 1)
    return np.stack((spans[head, 0], reach[last]), axis=1)


def _documents(ids: pa.Array, n_words: np.ndarray, spans: np.ndarray, items: list, near: list) -> Iterator[pa.RecordBatch]:
    """The rows of a shard's documents, in batches."""
    first = np.concatenate(([0], np.cumsum(n_words + 1)))
    owner = np.searchsorted(first, spans[:, 0], side="right") - 1
    inside = (spans - first[owner][:, None]).astype(np.int32)
    lists = [(owner, pa.StructArray.from_arrays([pa.array(inside[:, 0]), pa.array(inside[:, 1])], ["start", "end"]))]
    for pairs in (items, near):
        lists.append((np.array([d for d, _ in pairs], dtype=np.int64), pa.array([v for _, v in pairs], pa.string())))
    for low in range(0, len(n_words), ROWS):
        high = min(low + ROWS, len(n_words))
        columns = [ids[low:high], pa.array(n_words[low:high])]
        for of, values in lists:
            cut = np.searchsorted(of, np.arange(low, high + 1))
            columns.append(pa.ListArray.from_arrays(pa.array((cut - cut[0]).astype(np.int32)), values[int(cut[0]):int(cut[-1])]))
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "spans", "items", "near_items"])


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, near_words: int | None = SLACK,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents of ``index`` with the benchmark ``items`` (item_id, text) found in them; one row per document.

    ``doc_id, n_words``; ``spans``: places of words inside occurrences of a window, [start, end) in
    words, merged; ``items``: ids (as strings, sorted) of items with an occurring window;
    ``near_items``: of items with a window all of whose words lie within its length and
    ``near_words`` more, in any order (None: not searched). A window is ``window`` consecutive
    words, or all words of a shorter item. Items without id, text or words take no part; rows that
    repeat an id are one item with the windows of all. Runs the search and writes its result.
    """
    spark = index.sparkSession
    slim = cut_lineage(items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
                       .filter("item_id IS NOT NULL AND text IS NOT NULL").distinct())
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    state = index
    with batches_of(spark, 1):
        for block in range(blocks):
            rows = slim.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
            names = sorted({r["item_id"] for r in rows})
            number = {name: k for k, name in enumerate(names)}
            windows = Windows.of([r["text"] for r in rows], [number[r["item_id"]] for r in rows], window)
            last = block == blocks - 1
            state = _mark(state, windows, names, near_words, last)
            if block % 8 == 7 and not last:
                path = scratch_path(spark, "phrases")
                _write(state, path)
                state = spark.read.schema(MARK_SCHEMA).parquet(path)
        return cut_lineage(state)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, near_words: int | None = SLACK) -> DataFrame:
    """Index of ``docs`` in the shared scratch folder, then :func:`search`."""
    index = build_index(docs, scratch_path(docs.sparkSession, "phrases"))
    return search(index, items, window, near_words)
