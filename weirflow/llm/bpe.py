"""Byte-level BPE: whole pre-tokens through a minimal perfect hash, the rest by merging linked bytes from a heap.

A rank file gives token bytes and ids; the lower id merges first. Ids are those of the public reference encoder for such files:
every match of the pattern is encoded apart, and special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Encoded pre-tokens a worker remembers before it starts afresh; bounds its memory, not the result.
MEMO = 1 << 18
_KEYS_PER_BUCKET = 3
_TRIES = 256
_M = 0xFFFFFFFFFFFFFFFF
_MIX, _STEP = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


class PerfectHash:
    """Maps n keys to n slots without a free one (hash and displace); any other key may map anywhere.

    Keys fall into buckets; from the largest bucket on, a displacement is sought that sends its keys to
    free slots. Buckets of one key take the slots left, stored as -1 - slot.
    """

    def __init__(self, keys: Sequence[bytes]):
        self.size = len(keys)
        self.buckets = max(1, self.size // _KEYS_PER_BUCKET)
        h = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        order = np.argsort(h % np.uint64(self.buckets), kind="stable")
        numbers, starts, counts = np.unique(
            (h % np.uint64(self.buckets))[order], return_index=True, return_counts=True
        )
        free = np.ones(self.size, dtype=bool)
        shift, slots = np.zeros(self.buckets, dtype=np.int64), np.zeros(self.size, dtype=np.int64)
        by_size = np.argsort(-counts, kind="stable")
        for b in by_size[counts[by_size] > 1].tolist():
            own = order[starts[b] : starts[b] + counts[b]]
            first = 0
            while True:
                tries = np.arange(first, first + _TRIES, dtype=np.uint64)[:, None]
                at = self._slots(h[own][None, :], tries)
                at.sort(axis=1)
                good = free[at].all(axis=1) & (at[:, 1:] != at[:, :-1]).all(axis=1)
                if good.any():
                    break
                first += _TRIES
            shift[numbers[b]] = first + int(good.argmax())
            slots[own] = self._slots(h[own], shift[numbers[b : b + 1]].astype(np.uint64))
            free[slots[own]] = False
        single = by_size[counts[by_size] == 1]
        left = np.flatnonzero(free)[: len(single)]
        shift[numbers[single]], slots[order[starts[single]]] = -1 - left, left
        self.shift, self.slots = shift.tolist(), slots.tolist()

    def _slots(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        mixed = ((h ^ (shift * np.uint64(_STEP))) * np.uint64(_MIX)) >> np.uint64(20)
        return (mixed % np.uint64(self.size)).astype(np.int64)

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh64_intdigest(key)
        shift = self.shift[h % self.buckets]
        return -1 - shift if shift < 0 else (((h ^ (shift * _STEP & _M)) * _MIX & _M) >> 20) % self.size


class Vocabulary:
    """Tokens of a rank file, ready to encode and decode."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern = pattern
        self._index(ranks)

    def _index(self, ranks: dict[bytes, int]) -> None:
        tokens = list(ranks)
        self.hash = PerfectHash(tokens)
        self.keys, self.ids = [b""] * len(tokens), [0] * len(tokens)
        for token, slot in zip(tokens, self.hash.slots, strict=True):
            self.keys[slot], self.ids[slot] = token, ranks[token]

    def state(self) -> dict:
        """Plain values to broadcast, as workers need not have this package to read them."""
        return {"pattern": self.pattern, "hash": self.hash.__dict__, "keys": self.keys, "ids": self.ids}

    @classmethod
    def of(cls, state: dict) -> Vocabulary:
        """A vocabulary over a broadcast state; what it remembers stays in it for a worker's later tasks."""
        if isinstance(state["hash"], dict):
            plain, state["hash"] = state["hash"], PerfectHash.__new__(PerfectHash)
            state["hash"].__dict__ = plain
        vocabulary = cls.__new__(cls)
        vocabulary.__dict__ = state
        return vocabulary

    def _ready(self) -> None:
        if "memo" not in self.__dict__:
            self.ranks = dict(zip(self.keys, self.ids, strict=True))
            self.token = {i: t for t, i in self.ranks.items()}
            self.split, self.memo = regex.compile(self.pattern).findall, {}

    def whole(self, word: bytes) -> int | None:
        """First tier: the id of a pre-token that is itself a token."""
        slot = self.hash.slot(word)
        return self.ids[slot] if self.keys[slot] == word else None

    def merged(self, word: bytes) -> list[int]:
        """Second tier: parts start as bytes, linked to their neighbours; the heap gives the lowest-ranked pair.

        A pair in the heap is dead when one of its parts has been merged since; of equal ranks the
        leftmost goes first. A word of n bytes takes O(n log n).
        """
        ranks, n = self.ranks, len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part is word[i:end[i]]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (left := before[i]) >= 0 and (r := ranks.get(word[left:stop])) is not None:
                heapq.heappush(heap, (r, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; none for a null or empty text."""
        self._ready()
        memo, out = self.memo, []
        for piece in self.split(text or ""):
            ids = memo.get(piece)
            if ids is None:
                word = piece.encode()
                one = self.whole(word)
                ids = np.array(self.merged(word) if one is None else [one], dtype="<u4").tobytes()
                if len(memo) >= MEMO:
                    memo.clear()
                if len(piece) < 64:
                    memo[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes that ids stand for; an id that is not in the vocabulary is an error."""
        self._ready()
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def _mapped(docs: DataFrame, column: str, kind: str, vocabulary: Vocabulary, outputs: dict[str, str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.state())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.of(shared.value)
        for batch in batches:
            columns, values = [batch.column(0)], batch.column(1).to_pylist()
            for name in outputs:
                values = [v.encode(x) if name == "ids" else v.decode(x) for x in values]
                columns.append(pa.array(values, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *outputs])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col(column).cast(kind))
    return narrow.mapInArrow(run, ", ".join(["doc_id long", *(f"{n} {t}" for n, t in outputs.items())]))


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids): the ids of each whole text, packed as by ``Vocabulary.encode``.

    One row per row of documents, ids or not; a null text has none. The vocabulary is broadcast: it is
    bounded by its file, not by the data.
    """
    return _mapped(docs, "text", "string", vocabulary, {"ids": "binary"})


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, decoded): the bytes of each row of packed ids."""
    return _mapped(encoded, "ids", "binary", vocabulary, {"decoded": "binary"})


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids, decoded): both of the above in one pass over the texts."""
    return _mapped(docs, "text", "string", vocabulary, {"ids": "binary", "decoded": "binary"})
