"""Problem 6: the ids of a public byte-level BPE vocabulary for every text.

Pre-tokens are merged with a rank queue: one bucket of linked-list positions for each merge rank, and a bitmap
of three levels of 64-bit words over the ranks.  Find-first-set on the three levels gives the next rank; its
bucket is worked off from left to right; positions whose neighbours have changed are stale and skipped.  A
pre-token of n bytes costs a bounded number of steps per byte whatever its length, so texts without spaces of
any length are encoded whole.  A merge can only make pairs of a later rank, so no bucket grows while worked off.

The vocabulary (a file of fixed size under 1 MB, its path is a parameter) is broadcast as bytes; executors need
no copy of the file.  Short pre-tokens are remembered per task, in a table that is emptied when it is full,
which changes no result.

Defined cases: a null and an empty text both give an empty list; the text of a special token is ordinary text;
repeated rows give repeated results; further columns are not read.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession

from .common import spread, table

# Fixed value: how the vocabulary's authors cut texts into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 200_000
REMEMBERED_LENGTH = 40


class RankQueue:
    """Positions by rank with constant-time access to the lowest rank that has any."""

    def __init__(self, ranks: int):
        low = (ranks + 63) >> 6
        mid = (low + 63) >> 6
        self.low, self.mid, self.top = [0] * low, [0] * mid, 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.mid[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions from left to right; None when there is nothing left."""
        if not self.top:
            return None
        high = (self.top & -self.top).bit_length() - 1
        bits = self.mid[high]
        word = (high << 6) | ((bits & -bits).bit_length() - 1)
        bits = self.low[word]
        rank = (word << 6) | ((bits & -bits).bit_length() - 1)
        bits &= bits - 1
        self.low[word] = bits
        if not bits:
            self.mid[high] &= ~(1 << (word & 63))
            if not self.mid[high]:
                self.top &= ~(1 << high)
        return rank, sorted(self.buckets.pop(rank))


class Encoder:
    """Encoder for one vocabulary, given as lines of base64 token and rank."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import regex

        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in vocabulary.splitlines() if line)}
        self.token = {r: t for t, r in self.ranks.items()}
        self.byte = [self.ranks[bytes([b])] for b in range(256)]
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.pairs: dict[tuple[int, int], int] = {}
        self.known: dict[str, list[int]] = {}
        self.cut = regex.compile(pattern).findall

    def _merged(self, left: int, right: int) -> int:
        """Rank of the token made of two tokens, -1 if there is none."""
        found = self.pairs.get((left, right))
        if found is None:
            found = self.pairs[(left, right)] = self.ranks.get(self.token[left] + self.token[right], -1)
        return found

    def merge(self, data: bytes) -> list[int]:
        ids = [self.byte[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue, merged = self.queue, self._merged
        push = queue.push
        for i in range(n - 1):
            rank = merged(ids[i], ids[i + 1])
            if rank >= 0:
                push(rank, i)
        while (step := queue.pop()) is not None:
            rank, places = step
            for i in places:
                left = ids[i]
                if left < 0 or (j := after[i]) >= n or merged(left, ids[j]) != rank:
                    continue  # stale: this place was merged into another, or its neighbour has changed
                ids[i], ids[j] = rank, -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if (r := merged(rank, ids[k])) >= 0:
                        push(r, i)
                h = before[i]
                if h >= 0 and (r := merged(ids[h], rank)) >= 0:
                    push(r, h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for piece in self.cut(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.merge(piece.encode())
                if len(piece) <= REMEMBERED_LENGTH:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


def default_vocabulary() -> str:
    """Path of byte_bpe_50k.tiktoken among the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def token_ids(documents: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row of ``documents``."""
    with open(vocabulary or default_vocabulary(), "rb") as file:
        shared = documents.sparkSession.sparkContext.broadcast(file.read())
    rows = spread(documents.select(key, text))

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        encoder = Encoder(shared.value)
        for batch in batches:
            ends, flat = [0], []
            for value in batch.column(1).to_pylist():
                flat.extend(encoder.encode(value))
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, "int32")), pa.array(np.array(flat, "int32")))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return rows.mapInArrow(encode, f"{key} {dict(documents.dtypes)[key]}, ids array<int>")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


QUERIES = {"p6_ids": p6_ids}
