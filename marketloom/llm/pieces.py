"""SentencePiece encoding and decoding by streaming Viterbi.

A text is read from left to right. Scores are needed for the positions within one piece length
only. Whenever the backpointer paths of all those positions meet in one boundary, what lies before
it is committed and forgotten. A boundary that no piece reaches across is such a meeting at once.
No piece of the usual models has a space after another character, so every word begins at one, and
its ids do not depend on its neighbours: frequent words are remembered.

Unigram models bring log probabilities as scores. A BPE model's scores are ranks; they become log
probabilities by Zipf's law, -log(rank + 1), and the best path is the one of a unigram model with
those. A character without a piece falls back to its UTF-8 bytes at a price below every piece's.
The mark U+2581 stands for a space; a literal one in a text goes through bytes, so that decoding
gives back exactly the text. While searching, the two characters are swapped: no piece holds a
plain space.
"""

from __future__ import annotations

import math
import re
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import appended, int_lists, list_bytes, small_batches, strings

SPACE = "▁"
NORMAL, BYTE, UNIGRAM = 1, 6, 1
UNKNOWN_PENALTY = 10.0
# Stretches that one Python worker remembers before it starts anew.
REMEMBERED = 500_000
REMEMBERED_CHARS = 64
# Positions after which a commit is tried; scores are kept for one piece length beyond it.
COMMIT = 128
SWAP = str.maketrans({" ": SPACE, SPACE: " "})


class PieceModel:
    """Pieces, their log probabilities and the tables that the search needs."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        ranks = proto.trainer_spec.model_type != UNIGRAM
        self.dummy_prefix = proto.normalizer_spec.add_dummy_prefix
        pieces: dict[str, tuple[int, float]] = {}
        self.byte_id: dict[int, int] = {}
        self.text: list[bytes] = []
        pairs: set[tuple[str, str]] = set()
        # Every beginning of a piece: its id and log probability if it is one, else -1.
        self.trie: dict[str, tuple[int, float]] = {}
        for i, p in enumerate(proto.pieces):
            self.text.append(b"")
            if p.type == BYTE:
                self.byte_id[int(p.piece[1:-1], 16)] = i
                self.text[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type == NORMAL:
                pieces[p.piece] = (i, -math.log(1.0 - p.score) if ranks else p.score)
                self.text[i] = p.piece.replace(SPACE, " ").encode()
                pairs.update(zip(p.piece, p.piece[1:]))
                self.trie.update((p.piece[:n], (-1, 0.0)) for n in range(1, len(p.piece)))
        self.trie.update(pieces)
        if len(self.byte_id) != 256:
            raise ValueError("the model needs byte pieces, or unknown characters could not be decoded")
        # If no piece has a mark after another character, marks begin stretches; a line end that is
        # in no piece is one of its own.
        if any(b == SPACE and a != SPACE for a, b in pairs):
            self.stretches = lambda chars: [chars]
        elif any("\n" in p for p in pieces):
            self.stretches = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        else:
            self.stretches = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n+|[^{SPACE}\n]+").findall
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min((s for _, s in pieces.values()), default=0.0) - UNKNOWN_PENALTY
        self.memory: dict[str, bytes] = {}

    def unknown_ids(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.translate(SWAP).encode()]

    def stream(self, chars: str) -> Iterator[list[int]]:
        """Ids of ``chars`` (spaces and marks swapped), in groups as they are committed."""
        trie, longest, unknown = self.trie, self.longest, self.unknown
        begin, end, reach = 0, len(chars), 0
        # best[k]: score of the best path to begin + k; start[k], last[k]: where its last piece
        # starts, and the id (a character without a piece: its byte ids).
        size = min(end, COMMIT) + longest + 1
        best, start, last = [-math.inf] * size, [0] * size, [None] * size
        best[0] = 0.0
        for at in range(end):
            k = at - begin
            here = best[k]
            single = False
            for n in range(1, min(longest, end - at) + 1):
                hit = trie.get(chars[at:at + n])
                if hit is None:
                    break
                if hit[0] >= 0:
                    if n == 1:
                        single = True
                    value = here + hit[1]
                    if value > best[k + n]:
                        best[k + n], start[k + n], last[k + n] = value, k, hit[0]
                    if at + n > reach:
                        reach = at + n
            if not single:
                value = here + unknown
                if value > best[k + 1]:
                    best[k + 1], start[k + 1], last[k + 1] = value, k, self.unknown_ids(chars[at])
                if at + 1 > reach:
                    reach = at + 1
            k += 1
            if k >= COMMIT:
                meet = k if reach == at + 1 else self.common(start, last, k)
                if meet:
                    yield self.path(start, last, meet)
                    begin += meet
                    best, start, last = best[meet:], [x - meet for x in start[meet:]], last[meet:]
                grow = max(COMMIT, k - meet + 1) + longest + 1 - len(best)
                best += [-math.inf] * grow
                start += [0] * grow
                last += [None] * grow
        yield self.path(start, last, end - begin)

    @staticmethod
    def common(start: list[int], last: list, at: int) -> int:
        """The last boundary on the best paths of all positions from which the search goes on."""
        live = {at, *(k for k in range(at + 1, len(start)) if last[k] is not None)}
        while len(live) > 1:
            far = max(live)
            live.discard(far)
            live.add(start[far])
        return live.pop()

    @staticmethod
    def path(start: list[int], last: list, at: int) -> list[int]:
        ids = []
        while at > 0:
            if isinstance(last[at], list):
                ids.extend(reversed(last[at]))
            else:
                ids.append(last[at])
            at = start[at]
        ids.reverse()
        return ids

    def short(self, chars: str) -> list[int]:
        """``stream`` for stretches within which nothing would be committed."""
        get, longest, end = self.trie.get, self.longest, len(chars)
        best, start, last = [-math.inf] * (end + 1), [0] * (end + 1), [None] * (end + 1)
        best[0] = 0.0
        for at in range(end):
            here = best[at]
            hit = get(chars[at])
            if hit is None or hit[0] < 0:
                if here + self.unknown > best[at + 1]:
                    best[at + 1], start[at + 1], last[at + 1] = here + self.unknown, at, self.unknown_ids(chars[at])
                if hit is None:
                    continue
            elif here + hit[1] > best[at + 1]:
                best[at + 1], start[at + 1], last[at + 1] = here + hit[1], at, hit[0]
            for to in range(at + 2, (at + longest if at + longest < end else end) + 1):
                hit = get(chars[at:to])
                if hit is None:
                    break
                piece, score = hit
                if piece >= 0 and here + score > best[to]:
                    best[to], start[to], last[to] = here + score, at, piece
        return self.path(start, last, end)

    def stretch(self, chars: str) -> bytes:
        if len(chars) < COMMIT:
            return array("i", self.short(chars)).tobytes()
        return b"".join([struct.pack(f"<{len(g)}i", *g) for g in self.stream(chars)])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        if not text:
            return b""
        chars = text.translate(SWAP) if SPACE in text else text.replace(" ", SPACE)
        words = self.stretches((SPACE if self.dummy_prefix else "") + chars)
        memory = self.memory
        for word in set(words).difference(memory):
            if len(memory) >= REMEMBERED:
                break
            if len(word) <= REMEMBERED_CHARS:
                memory[word] = self.stretch(word)
        try:
            return b"".join([memory[w] for w in words])
        except KeyError:
            return b"".join([memory[w] if w in memory else self.stretch(w) for w in words])

    def decode(self, ids: bytes) -> str:
        table, size = self.text, len(self.text)
        out = b"".join([table[i] if 0 <= i < size else REPLACEMENT for i in struct.unpack(f"<{len(ids) // 4}i", ids)]).decode("utf-8", "replace")
        return out[1:] if self.dummy_prefix and out[:1] == " " else out


REPLACEMENT = "\ufffd".encode()


def known_elements(lists: pa.ListArray) -> pa.ListArray:
    """Lists without their NULL elements."""
    if not lists.flatten().null_count:
        return lists
    return pa.array([None if x is None else [i for i in x if i is not None] for x in lists.to_pylist()], lists.type)


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model at ``path``, read once per Python worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    if len(_models[path].memory) >= REMEMBERED:
        _models[path].memory.clear()
    return _models[path]


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` as ``array<int>``.

    NULL and empty texts have no ids. A column that has the name of ``ids`` is replaced. Rows are
    independent, so ties, repeated rows and empty tables need no care.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = model(model_path)
            yield appended(batch, {ids: int_lists([m.encode(t) for t in strings(batch, text)])})

    kept = [f for f in docs.schema.fields if f.name != ids]
    schema = T.StructType(kept + [T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return small_batches(docs).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text of ``ids``; NULL and empty lists give the empty text.

    NULL elements are skipped, ids outside the vocabulary give the replacement character.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = model(model_path)
            parts = [m.decode(b) for b in list_bytes(known_elements(batch.column(ids)))]
            yield appended(batch, {text: pa.array(parts, pa.string())})

    kept = [f for f in encoded.schema.fields if f.name != text]
    schema = T.StructType(kept + [T.StructField(text, T.StringType())])
    return small_batches(encoded).mapInArrow(run, schema)
