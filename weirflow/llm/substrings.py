"""Removal of byte strings that occur more than once, by a column-wise suffix order of the collection.

The transform of a whole corpus takes as many rounds as its longest document has bytes. Here documents are cut first, so that
rounds are few and tasks small, without losing a repeat. Every stretch of ``LENGTH`` bytes has an anchor, its
leftmost 32-byte gram of least hash: equal stretches have equal anchors at equal places. So stretches are compared only below
equal anchors, lined up at them, as pieces of a few hundred bytes (see ``pieces``).

Within a task the pieces form a collection whose suffix order is built column by column, from
the last to the first: each round puts one symbol of every piece before its suffix, sorts by it with one stable pass, and
updates the common prefixes of neighbours (see ``repeated_starts``). As equal stretches stand in the same column, a
round needs the column before it only: the transform is read and written once in sequence, not inserted into.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.session import materialize

LENGTH = 400
_GRAM = 32
# Starts of stretches that one piece holds at most; a piece is LENGTH - 1 bytes longer.
_STARTS = 128
_CHUNK = 1 << 20  # bytes of a document that are hashed at a time
_PIECES_AT_ONCE = 1 << 14
# Different pieces with one core that one task takes together; more are cut into shorter pieces.
MOST_PIECES = 1 << 10
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE = (1 << 24) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Anchors:
    """Finds the anchors of documents; holds the tables of powers for that."""

    def __init__(self, length: int = LENGTH):
        self.length, self.gram = length, min(_GRAM, length)
        n = _CHUNK + length + 1
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def runs(self, data: bytes) -> Iterator[tuple[int, int, int, int]]:
        """(first start, last start, place of the anchor, hash of the anchor) for stretches in a row with one anchor."""
        n, width = self.length, self.length - self.gram + 1
        for at in range(0, len(data) - n + 1, _CHUNK):
            part = np.frombuffer(data, np.uint8, min(_CHUNK + n - 1, len(data) - at), at)
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(part * self.up[: len(part)], out=sums[1:])
            h = (sums[self.gram :] - sums[: -self.gram]) * self.down[: len(part) - self.gram + 1]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            # The least hash and then the least place of each window, by windows of doubled width.
            least = (h & ~np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
            size = 1
            while 2 * size <= width:
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            if width > size:
                least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
            place = (least & np.uint64(_PLACE)).astype(np.int64)
            new = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place))
            own = place[new[:-1]]
            for first, last, a, k in zip(new[:-1].tolist(), (new[1:] - 1).tolist(), own.tolist(), h[own].view(np.int64).tolist(), strict=True):
                yield at + first, at + last, at + a, k

    def fragments(self, data: bytes) -> Iterator[tuple[int, int, int, int, int]]:
        """Runs with a hash of all their bytes: (first, last, anchor, anchor's hash, hash)."""
        for first, last, a, k in self.runs(data):
            yield first, last, a, k, xxhash.xxh3_64_intdigest(data[first : last + self.length]) - (1 << 63)


def pieces(data: bytes, first: int, last: int, anchor: int, length: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Cuts a run into pieces by the distance from start to anchor: (bin, hash, left, right, bytes).

    Starts of one bin have the bytes between in common, whose hash with the bin's number says where pieces can meet. left and right are the
    piece's first and last start, as columns of the bin.
    """
    for b in range((anchor - last) // _STARTS, (anchor - first) // _STARTS + 1):
        zero = anchor - b * _STARTS - (_STARTS - 1)  # the start that column 0 would be
        left, right = max(first, zero), min(last, zero + _STARTS - 1)
        core = data[zero + _STARTS - 1 : zero + length]
        yield b, xxhash.xxh3_64_intdigest(core, b) - (1 << 63), left - zero, right - zero, data[left : right + length]


def repeated_starts(
    texts: list[bytes], left: np.ndarray, right: np.ndarray, length: int, starts: int
) -> np.ndarray:
    """Which starts of which pieces begin a stretch that occurs more than once: booleans (piece, column).

    Column by column from the right, ``order`` is the order of all pieces by their suffix from there, and ``common`` what
    each shares with the one before it. A piece that stands at several places is given twice, so that it has itself as a
    neighbour. Only the order and the common prefixes of the last column are held.
    """
    m, width = len(texts), starts + length - 1
    grid = np.full((width, m), 256, dtype=np.uint16)  # 256: no byte here
    for i, text in enumerate(texts):
        grid[left[i] : left[i] + len(text), i] = np.frombuffer(text, np.uint8)
    found = np.zeros((m, starts), dtype=bool)
    order, common = np.arange(m), np.zeros(m, dtype=np.int32)
    at = np.arange(m)
    for column in range(width - 1, -1, -1):
        symbol = grid[column][order]
        sort = np.argsort(symbol, kind="stable")
        # least[k][i]: the least of common[i : i + 2**k]
        least = [common]
        while 2 << (len(least) - 1) <= m:
            half = 1 << (len(least) - 1)
            least.append(np.minimum(least[-1][:-half], least[-1][half:]))
        symbol = symbol[sort]
        same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] < 256)) + 1
        low, high = sort[same - 1] + 1, sort[same]  # what stood between the two in the last order
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        shared = np.empty(len(same), dtype=np.int32)
        for k in np.unique(level).tolist():
            here = level == k
            shared[here] = np.minimum(least[k][low[here]], least[k][high[here] + 1 - (1 << k)])
        order, common = order[sort], np.zeros(m, dtype=np.int32)
        common[same] = shared + 1
        if column < starts:
            own = (left[order] <= column) & (column <= right[order])
            near = common >= length
            twice = near | np.append(near[1:], False)
            found[order, column] = own & twice
    return found


def _spans(flags: np.ndarray) -> list[int]:
    """First and last place of each run of true values, in a row."""
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    edges[1::2] -= 1
    return edges.tolist()


def resolved(parts: DataFrame, starts: int, length: int) -> DataFrame:
    """(core, whole, columns): the repeated starts of each different piece, as first and last columns in a row.

    ``parts`` has (core, whole, left, right, n, piece), one row for each place where a piece stands. Equal pieces meet once, with their
    summed weight, and all pieces of a core in one task, unless they are more than ``MOST_PIECES``: those
    are cut into pieces of fewer starts, which have more bytes in common. A piece of one start is equal to its core, so this ends.
    """
    kinds = parts.select("core", "whole").distinct().groupBy("core").count()
    hot = materialize(kinds.where(F.col("count") > MOST_PIECES).select("core"), "hot-cores")
    if starts == 1 or hot.isEmpty():
        return _built(parts, starts, length)
    fewer = max(1, starts // 16)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for core, whole, left, right, n, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for b in range(left // fewer, right // fewer + 1):
                    zero = b * fewer
                    first, last = max(left, zero), min(right, zero + fewer - 1)
                    inner = xxhash.xxh3_64_intdigest(piece[zero + fewer - 1 - left : zero + length - left], b) - (1 << 63)
                    part = piece[first - left : last - left + length]
                    own = xxhash.xxh3_64_intdigest(part, first) - (1 << 63)
                    out.append((core, whole, zero, inner, own, first - zero, last - zero, n, part))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
            names = ["of_core", "of_whole", "zero", "core", "whole", "left", "right", "n", "piece"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "of_core long, of_whole long, zero int, core long, whole long, left int, right int, n long, piece binary"
    columns = ["core", "whole", "left", "right", "n", "piece"]
    crowded = _once(parts.join(hot, "core", "left_semi")).select(*columns)
    shorter = materialize(crowded.mapInArrow(cut, schema), "shorter")
    below = materialize(resolved(shorter.select(*columns), fewer, length), "shorter-repeats")
    back = (
        shorter.select("of_core", "of_whole", "zero", "core", "whole")
        .join(below, ["core", "whole"])
        .groupBy("of_core", "of_whole")
        .agg(F.flatten(F.collect_list(F.transform("columns", lambda c: c + F.col("zero")))).alias("columns"))
    )
    ordinary = _built(parts.join(hot, "core", "left_anti"), starts, length)
    return ordinary.unionByName(back.select(F.col("of_core").alias("core"), F.col("of_whole").alias("whole"), "columns"))


def _once(parts: DataFrame) -> DataFrame:
    return parts.groupBy("core", "whole", "left", "right").agg(F.sum("n").alias("n"), F.max("piece").alias("piece"))


def _built(parts: DataFrame, starts: int, length: int) -> DataFrame:
    """The suffix orders of whole cores, many of them in one collection."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held.extend(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            if len(held) >= _PIECES_AT_ONCE:
                last = next((i for i in range(len(held) - 1, 0, -1) if held[i - 1][0] != held[-1][0]), 0)
                if last:
                    yield order(held[:last])
                    held = held[last:]
        if held:
            yield order(held)

    def order(rows: list[tuple]) -> pa.RecordBatch:
        # A copy joins every piece that stands at two places or more; what holds of one holds of all.
        every = [*rows, *(r for r in rows if r[4] > 1)]
        left, right = (np.array([r[i] for r in every]) for i in (2, 3))
        found = repeated_starts([r[5] for r in every], left, right, length, starts)
        spans = [_spans(f) for f in found[: len(rows)]]
        some = [i for i, s in enumerate(spans) if s]
        columns = [pa.array([rows[i][c] for i in some], pa.int64()) for c in (0, 1)]
        columns.append(pa.array([spans[i] for i in some], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names=["core", "whole", "columns"])

    pieces = _once(parts).select("core", "whole", "left", "right", "n", "piece")
    return pieces.repartition("core").sortWithinPartitions("core").mapInArrow(build, "core long, whole long, columns array<int>")


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, found): by document, the repeated starts of its fragments, as (anchor's hash, hash, first, last) by distance to the anchor.

    ``docs`` has (key, text). Fragments that are equal byte by byte stand for each other from the start, with their number as weight, and so do equal
    pieces, so copies are neither read nor compared again. Fragments whose anchor occurs once are left out: they
    hold no repeat. The texts are read twice.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen: dict[tuple[int, int], int] = {}
                for *_, k, h in anchors.fragments(text.encode()):
                    seen[k, h] = seen.get((k, h), 0) + 1
                out.extend((key, k, h, n) for (k, h), n in seen.items())
            columns = [pa.array([r[i] for r in out], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "anchor", "hash", "n"])

    marked = docs.mapInArrow(mark, "key long, anchor long, hash long, n long")
    marked = materialize(marked, "anchors")
    kinds = marked.groupBy("anchor", "hash").agg(F.sum("n").alias("n"), F.min("key").alias("of"))
    shared = marked.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    shared = materialize(shared, "shared-anchors")
    wanted = kinds.join(shared, "anchor").groupBy("of").agg(F.collect_list(F.struct("anchor", "hash", "n")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for batch in batches:
            out: list[tuple] = []
            for text, some in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left_over, data = {(w["anchor"], w["hash"]): w["n"] for w in some}, text.encode()
                for first, last, a, k, h in anchors.fragments(data):
                    if (n := left_over.pop((k, h), None)) is not None:
                        for b, core, left, right, piece in pieces(data, first, last, a, length):
                            whole = xxhash.xxh3_64_intdigest(piece, left) - (1 << 63)
                            out.append((core, whole, left, right, piece, n, k, h, b))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["core", "whole", "left", "right", "piece", "n", "anchor", "hash", "bin"])

    # Two rows may share a key, and a null id has none of its own, so a document may lack some of what is wanted of its key.
    texts = docs.join(wanted, docs.key == F.col("of")).select("text", "wanted")
    schema = "core long, whole long, left int, right int, piece binary, n long, anchor long, hash long, bin int"
    parts = materialize(texts.mapInArrow(cut, schema), "pieces")
    found = materialize(resolved(parts, _STARTS, length), "repeats")
    # Column c of bin b is b * _STARTS + _STARTS - 1 - c bytes before the anchor.
    distance = F.transform("columns", lambda c: F.col("bin") * _STARTS + (_STARTS - 1) - c)
    by_fragment = (
        parts.select("anchor", "hash", "bin", "core", "whole")
        .distinct()
        .join(found, ["core", "whole"])
        .groupBy("anchor", "hash")
        .agg(F.flatten(F.collect_list(distance)).alias("far"))
    )
    by_fragment = materialize(by_fragment, "fragments")
    return marked.join(by_fragment, ["anchor", "hash"]).groupBy("key").agg(
        F.collect_list(F.struct("anchor", "hash", "far")).alias("found")
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per row of documents (doc_id, text).

    A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else, in the same document
    too; overlaps count, and all strings are judged on the input. kept has the other bytes, which may cut a character. Null texts
    are empty; shorter texts lose nothing; repeated rows are repeats of each other, whatever their ids.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
    found = repeated(keyed.select("key", "text"), length).withColumnRenamed("key", "of")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for batch in batches:
            out: list[tuple] = []
            for text, some in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                marks = np.zeros(len(data) + 1, dtype=np.int32)
                known = {(f["anchor"], f["hash"]): f["far"] for f in some or ()}
                for first, last, a, k, h in anchors.fragments(data) if known else ():
                    far = known.get((k, h), ())
                    for most, least in zip(far[::2], far[1::2], strict=True):
                        marks[a - most] += 1
                        marks[a - least + length] -= 1
                gone = np.cumsum(marks[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if gone.any() else data
                out.append((len(data), int(gone.sum()), len(_spans(gone)) // 2, kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    held = keyed.join(found, F.col("key") == F.col("of"), "left").select("doc_id", "text", "found")
    return held.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
