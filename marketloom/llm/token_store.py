"""Token ids in Parquet: documents in ascending order, ids as a list column.

A store is a folder with ``data`` (one row per document: ``doc_id, shard, at, n_tokens, ids``; one
file per shard of consecutive documents) and ``shards`` (``shard, base``: tokens in all shards
before). A document's place in the whole stream is base + at. Ids are dictionary-encoded, the
other columns delta-encoded, row groups and pages are small and pages are indexed by doc_id, so
that a range of documents reads few pages and metadata reads no ids.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import appended, int_lists, list_bytes, small_batches, strings

END = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 1000
# A Python worker that remembers twice as many pieces of words, or twice as many bytes of them, keeps so many of those
# met last.
REMEMBERED, REMEMBERED_BYTES = 300_000, 32 << 20

# Where a space is beside other white space, a cut would separate what the pre-tokenizer looks at
# together; kinds of white space that prose rarely holds are not looked at closer.
BESIDE = ("  ", " \n", "\n ")
RARE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]

# The pre-tokenizer cuts wherever letters and other characters of these meet. Apostrophes begin contractions, and two line
# ends before a letter depend on what follows: words with them or with any other character stay whole.
LETTERS, OTHERS = "[A-Za-zÀ-ÖØ-öø-ÿ]", "[\\n!-&(-@[-`{-~]"
PLAIN = re.compile(f" {LETTERS}+")
SPACE, LINE_END, LATIN = 0x20, 0x0A, 0xC3
LETTER, OTHER, WHOLE = 1, 2, 3


def kinds(first: int, characters: list[str]) -> np.ndarray:
    """Kind of each byte from ``first`` on, which stands for one of ``characters``."""
    found = [LETTER if re.match(LETTERS, c) else OTHER if re.match(OTHERS, c) else WHOLE for c in characters]
    return np.array([WHOLE] * first + found + [WHOLE] * (256 - first - len(found)), dtype=np.uint8)


# Of a byte by itself, and of one that follows the first byte of a letter of LETTERS beyond ASCII.
KIND, LATIN_KIND = kinds(0, [*map(chr, range(128))]), kinds(0x80, [*map(chr, range(0xC0, 0x100))])
KIND[SPACE], KIND[LATIN] = 0, LETTER


class WordwiseTokenizer:
    """A byte-level BPE tokenizer of the tokenizers library, asked once per piece of a word.

    Its pre-tokenizer cuts before every single space between two other characters that are not
    white space, and merges stay within what it cuts, so words can be encoded apart. So can the
    letters and the marks of a word. Such pieces, the first of a word with the space before it, are remembered.
    A word of letters is one piece to the pre-tokenizer, so the tokenizer's model is asked for it without it.
    Texts with other white space beside spaces, or with an added token, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        before = self.tokenizer.pre_tokenizer
        self.in_parts = (self.tokenizer.normalizer is None and isinstance(before, pre_tokenizers.ByteLevel)
                         and before.use_regex and not before.add_prefix_space)
        # How the pre-tokenizer spells the bytes of a space and of letters beyond ASCII.
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {c: spelled(chr(c))[0][0] for c in (SPACE, *range(0xC0, 0x100))}
        # Remembered pieces, the stretch of ``ids`` of each, and the batch that met it last.
        self.batch = 0
        self.pieces = pa.array([], pa.large_string())
        self.ids = np.empty(0, dtype="<i4")
        self.sizes, self.met = np.empty((2, 0), dtype=np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of the texts as little-endian 32-bit numbers."""
        self.forget()
        heads, rests = [], []
        for text in texts:
            head, space, rest = (text, "", "") if self.odd(text) else text.partition(" ")
            heads.append(head)
            rests.append((space + rest).encode())
        data = b"".join(rests)
        starts = self.cuts(data)
        coded = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)).dictionary_encode()
        places = self.places(coded.dictionary)
        # One stretch of ids per remembered piece and per head; then the stretches in the order of the texts.
        parts = self.ask(heads)
        ids = np.concatenate([self.ids, np.frombuffer(b"".join(parts), dtype="<i4")])
        sizes = np.concatenate([self.sizes, np.array([len(p) // 4 for p in parts], dtype=np.int64)])
        begins = np.cumsum(sizes) - sizes
        bounds = np.cumsum([0, *map(len, rests)])
        counts = 1 + np.diff(np.searchsorted(starts, bounds))
        first = np.cumsum(counts) - counts
        order = np.empty(counts.sum(), dtype=np.int64)
        later = np.ones(len(order), dtype=bool)
        later[first] = False
        order[later] = places[coded.indices.to_numpy()]
        order[first] = len(self.sizes) + np.arange(len(texts))
        long = sizes[order]
        ends = np.cumsum(long)
        moved = np.repeat(begins[order] - ends + long, long)
        moved += np.arange(len(moved))
        stream = ids[moved]
        bounds = [0, *ends[first + counts - 1].tolist()]
        return [stream[x:y].tobytes() for x, y in zip(bounds, bounds[1:])]

    def odd(self, text: str) -> bool:
        return any(x in text for x in BESIDE) or any(x in text for x in RARE) or any(x in text for x in self.added)

    def cuts(self, data: bytes) -> np.ndarray:
        """Where the pieces begin in words that each have a space before them."""
        raw = np.frombuffer(data, dtype=np.uint8)
        begins = raw == SPACE
        if self.in_parts:
            words = np.flatnonzero(begins)
            kind = KIND[raw]
            after = np.flatnonzero(raw[:-1] == LATIN) + 1
            kind[after] = LATIN_KIND[raw[after]]
            whole = kind == WHOLE
            whole[2:] |= (kind[2:] == LETTER) & (raw[1:-1] == LINE_END) & (raw[:-2] == LINE_END)
            kept = np.zeros(len(words), dtype=bool)
            kept[np.searchsorted(words, np.flatnonzero(whole)) - 1] = True
            meet = np.flatnonzero(kind[1:] * kind[:-1] == LETTER * OTHER) + 1
            begins[meet[~kept[np.searchsorted(words, meet) - 1]]] = True
        return np.flatnonzero(begins)

    def places(self, pieces: pa.LargeStringArray) -> np.ndarray:
        """Where distinct pieces are remembered; new ones are asked for."""
        found = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(found < 0)
        found[new] = len(self.pieces) + np.arange(len(new))
        added = pieces.take(pa.array(new))
        parts = self.learn(added.to_numpy(zero_copy_only=False).tolist())
        self.pieces = pa.concat_arrays([self.pieces, added])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(parts), dtype="<i4")])
        self.sizes = np.concatenate([self.sizes, np.array([len(p) // 4 for p in parts], dtype=np.int64)])
        self.met = np.concatenate([self.met, np.empty(len(new), dtype=np.int64)])
        self.met[found] = self.batch
        return found

    def forget(self) -> None:
        self.batch += 1
        if len(self.pieces) < 2 * REMEMBERED and self.pieces.nbytes < 2 * REMEMBERED_BYTES:
            return
        last = np.argsort(-self.met, kind="stable")[:REMEMBERED]
        length = pc.binary_length(self.pieces).to_numpy()[last]
        kept = np.zeros(len(self.met), dtype=bool)
        kept[last[np.cumsum(length) <= REMEMBERED_BYTES]] = True
        self.ids = self.ids[np.repeat(kept, self.sizes)]
        self.pieces, self.sizes, self.met = self.pieces.filter(pa.array(kept)), self.sizes[kept], self.met[kept]

    def learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of new pieces, of the tokenizer's model where letters follow a space."""
        tokens, spelling = self.tokenizer.model.tokenize, self.spelling
        space, found, rest = spelling[SPACE], [], []
        for i, piece in enumerate(pieces):
            if self.in_parts and PLAIN.fullmatch(piece):
                spelled = space + piece[1:] if piece.isascii() else piece.translate(spelling)
                found.append(array("i", [t.id for t in tokens(spelled)]).tobytes())
            else:
                found.append(b"")
                rest.append(i)
        for i, ids in zip(rest, self.ask([pieces[i] for i in rest])):
            found[i] = ids
        return found

    def ask(self, texts: list[str]) -> list[bytes]:
        # The same ids as encode_batch, without places in the text.
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("i", e.ids).tobytes() for e in found]


_tokenizers: dict[str, WordwiseTokenizer] = {}


def tokenizer(path: str) -> WordwiseTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordwiseTokenizer(path)
    return _tokenizers[path]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end: int = END) -> None:
    """Write ``docs (doc_id, text)`` as a store at ``path``.

    Documents are dealt by ranges of doc_id (NULL first; repeated ids in order of their text's hash,
    by which they are split as well), so a file holds consecutive documents. NULL text counts as empty: the end id alone. An empty table
    makes a store without rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = TaskContext.get().partitionId(), 0
        last = np.array([end], dtype="<i4").tobytes()
        for batch in batches:
            parts = [p + last for p in tokenizer(tokenizer_path).encode(strings(batch, "text"))]
            n = np.array([len(p) // 4 for p in parts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(n), shard, dtype=np.int32)),
                 pa.array(at + np.cumsum(n) - n), pa.array(n), int_lists(parts)],
                names=["doc_id", "shard", "at", "n_tokens", "ids"])
            at += int(n.sum())

    spark = docs.sparkSession
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
               .repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text"))
    rows = small_batches(ordered).mapInArrow(
        run, "doc_id long, shard int, at long, n_tokens long, ids array<int>")
    (rows.write.mode("overwrite").option("compression", "zstd")
     .option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.enable.dictionary", "false")
     .option("parquet.enable.dictionary#ids.list.element", "true")
     .option("parquet.block.size", str(ROW_GROUP_BYTES))
     .option("parquet.page.size", str(PAGE_BYTES))
     .option("parquet.page.row.count.limit", str(PAGE_ROWS))
     .parquet(f"{path}/data"))
    # One row per shard: its tokens, and those of all shards before it.
    totals = read_data(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard")) - F.col("n")
    totals.select("shard", before.alias("base")).write.mode("overwrite").parquet(f"{path}/shards")


def read_data(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, shard int, at long, n_tokens long, ids array<int>").parquet(f"{path}/data")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of a store; columns and filters on doc_id reach the files."""
    shards = spark.read.schema("shard int, base long").parquet(f"{path}/shards")
    return (read_data(spark, path).join(shards, "shard")
            .select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids"))


def checksums(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``ids`` replaced by ``ids_crc32`` of the ids as little-endian 32-bit numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.array([zlib.crc32(b) for b in list_bytes(batch.column("ids"))], pa.int64())
            yield appended(batch, {"ids_crc32": sums}).drop_columns(["ids"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return small_batches(tokens.select("doc_id", "start", "n_tokens", "ids")).mapInArrow(run, schema)
