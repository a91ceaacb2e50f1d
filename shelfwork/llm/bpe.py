"""Byte-level BPE by tree reduction.

A piece of text is encoded by halves. The tokens of two neighbouring halves join
by encoding a window around their border anew, which grows until its outermost
tokens are stable beside the tokens that stay: two neighbouring tokens are stable
if their joint bytes encode to just these two, and a row of tokens is the encoding
of its bytes exactly if all its neighbours are. Decoding concatenates neighbours up
a tree as well.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_text_batches, query, table

#: Entries of a worker's table of remembered pieces, and of those of halves and joins.
REMEMBERED, REMEMBERED_PARTS = 1 << 18, 1 << 16
#: Bytes that are merged directly.
LEAF = 6
#: Neighbours that a node of the decoding tree joins.
FAN = 16
#: Windows above so many bytes are merged with a heap.
HEAP = 48


class Remembered(dict):
    """A bounded table of results: the newest ones and the generation before them."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Encodes bytes by the ranks of a file of base64 tokens, without special tokens."""

    def __init__(self, path: str, pattern: str, most: int = REMEMBERED, most_parts: int = REMEMBERED_PARTS):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.find = regex.compile(pattern).findall
        self.halves = Remembered(self._tree, most_parts)
        self.windows = Remembered(lambda pair: self.merge(self.tokens[pair[0]] + self.tokens[pair[1]]), most_parts)
        self.pieces = Remembered(self._packed, most)

    def merge(self, data: bytes) -> list[int]:
        """The encoding of a few bytes: the pair of lowest rank merges first, the leftmost of equals."""
        if len(data) > HEAP:
            return self._merge_long(data)
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(data[i : i + 2]) for i in range(len(data) - 1)]
        while True:
            best = min((r for r in pairs if r is not None), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i])
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1])

    def _merge_long(self, data: bytes) -> list[int]:
        n, ranks = len(data), self.ranks
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := ranks.get(data[i : end[j]])) is not None:
                heapq.heappush(heap, (rank, i, end[i], end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, middle, right = heapq.heappop(heap)
            if end[i] != middle or middle >= n or end[middle] != right:
                continue  # one of the two has merged with another since
            end[i], after[i], end[middle] = right, after[middle], -1
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def stable(self, left: int, right: int) -> bool:
        return len(own := self.windows[left, right]) == 2 and own[0] == left

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the joint bytes of two encodings."""
        i = j = 1
        own = self.windows[left[-1], right[0]]
        while True:
            wider = False
            if i < len(left) and not self.stable(left[-i - 1], own[0]):
                i, wider = min(2 * i, len(left)), True
            if j < len(right) and not self.stable(own[-1], right[j]):
                j, wider = min(2 * j, len(right)), True
            if not wider:
                return left[:-i] + own + right[j:]
            own = self.merge(b"".join([self.tokens[t] for t in left[-i:] + right[:j]]))

    def _tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merge(data)
        middle = len(data) // 2
        halves = data[:middle], data[middle:]
        return self.join(*[self.halves[x] if len(x) <= 4 * LEAF else self._tree(x) for x in halves])

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode()
        whole = self.ranks.get(data)
        return self._tree(data) if whole is None else [whole]

    def _packed(self, piece: str) -> bytes:
        ids = array("I", self.encode_piece(piece))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers; long pieces aren't remembered."""
        pieces = self.pieces
        return b"".join([pieces[p] if len(p) <= 64 else self._packed(p) for p in self.find(text)])

    def decode(self, ids: bytes) -> bytes:
        """The tokens' bytes, joined with their neighbours up a tree of FAN branches a node."""
        parts = [self.tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + FAN]) for i in range(0, len(parts), FAN)]
        return parts[0] if parts else b""


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder; its remembered pieces serve later tasks too."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def encode(
    docs: DataFrame, vocabulary: str, pattern: str = public_tokenizers.PATTERN, key: str = "doc_id", text: str = "text",
    keep: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: key, n_tokens, ids_sha256, decoded_sha256, and ids and decoded if ``keep``.

    ids is an array of int; decoded are the bytes that the ids stand for. Null
    and empty texts have no tokens. Each row is encoded by itself, so ties and
    repeated rows don't matter; other columns are not looked at. The file of
    ranks is read on the executors, from a path that all of them have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, pattern)
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                out = []
                for value in part.column(1):
                    ids = own.encode(value.as_py() or "")
                    decoded = own.decode(ids)
                    digests = hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()
                    out.append((len(ids) // 4, *digests, *((np.frombuffer(ids, "<i4"), decoded) if keep else ())))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], names
                )

    kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()][: 5 if keep else 3]
    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if keep else 4]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return in_text_batches(rows).mapInArrow(run, schema + (", ids array<int>, decoded binary" if keep else "")).withColumnRenamed("key", key)


def multilingual() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query("op3_bpe")
def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of each document's tokens and of the bytes decoded from them."""
    return encode(table(spark, folder, "documents"), multilingual(), keep=False)
