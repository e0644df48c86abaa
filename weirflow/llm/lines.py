"""Line deduplication behind two Bloom filters.

One filter holds the hashes of lines seen once, the other those seen twice. Filters
are built where the texts are read and merged page by page; only lines that the second one
suspects are shuffled, to be confirmed by their text. A filter can only suspect too much,
never too little, so its size decides the work and not the result. A corpus with more lines than a filter has
room for is looked at in several rounds, each for a share of the hashes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
# Bits a filter has per line it may meet, and the most it has in all: 2**28 bits are 32 MiB,
# the bound of what is broadcast. More lines take more rounds, so the share of false suspects stays.
BITS_PER_LINE = 16
MAX_BITS = 1 << 28
_PAGE = 1 << 16  # bits of a page, the unit in which filters are merged
_PROBES = 2


def line_key(line: str, shortest: int) -> str | None:
    """What lines are compared by, or None for a line too short to be compared."""
    key = line.strip(BLANKS)
    return key.encode().lower().decode() if len(key) >= shortest else None


def _keys(text: str | None, shortest: int) -> set[str]:
    return {k for line in (text or "").split("\n") if (k := line_key(line, shortest)) is not None}


def _probes(keys: Sequence[str], bits: int, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Which keys belong to one of the parts of all hashes, and their bit numbers, one column per probe."""
    h = np.array([xxhash.xxh64_intdigest(k.encode()) for k in keys], dtype=np.uint64)
    own = np.flatnonzero((h >> np.uint64(16)) % np.uint64(parts) == part)
    shifts = np.arange(_PROBES, dtype=np.uint64) * np.uint64(32)
    return own, ((h[own].reshape(-1, 1) >> shifts) % np.uint64(bits)).astype(np.int64)


def _get(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _put(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _packed(page: np.ndarray) -> bytes:
    """A page of bits as its set positions, or as it is where that is shorter."""
    at = np.flatnonzero(np.unpackbits(page, bitorder="little")).astype("<u2").tobytes()
    return at if len(at) < len(page) else page.tobytes()


def _page(data: bytes) -> np.ndarray:
    if len(data) == _PAGE // 8:
        return np.frombuffer(data, np.uint8).copy()
    page = np.zeros(_PAGE // 8, dtype=np.uint8)
    _put(page, np.frombuffer(data, "<u2").astype(np.int64))
    return page


def repeat_filter(docs: DataFrame, bits: int, shortest: int, part: int = 0, parts: int = 1) -> np.ndarray:
    """Packed bits that are set at every probe of a line key of one part that two documents or more hold.

    A task marks a key's bits in its own ``once`` filter, and in ``twice`` when they were
    marked before; merging two tasks' filters adds what both have marked once. At most
    ``bits`` bits reach the driver.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, dtype=np.uint8), np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                _, probes = _probes(list(_keys(text, shortest)), bits, part, parts)
                _put(twice, probes[_get(once, probes).all(axis=1)].ravel())
                _put(once, probes.ravel())
        for page in np.flatnonzero(once.reshape(-1, _PAGE // 8).any(axis=1)).tolist():
            of_page = slice(page * _PAGE // 8, (page + 1) * _PAGE // 8)
            columns = [pa.array([page]), pa.array([_packed(once[of_page])]), pa.array([_packed(twice[of_page])])]
            yield pa.RecordBatch.from_arrays(columns, names=["page", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None
        for batch in batches:
            for page, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, two = _page(one), _page(two)
                if page != now:
                    if now is not None:
                        yield row(now, twice)
                    now, once, twice = page, one, two
                else:
                    twice |= two | (once & one)
                    once |= one
        if now is not None:
            yield row(now, twice)

    def row(page: int, twice: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([page]), pa.array([_packed(twice)])], names=["page", "twice"])

    parts = docs.where("doc_id is not null").select("text").mapInArrow(build, "page long, once binary, twice binary")
    merged = parts.repartition("page").sortWithinPartitions("page").mapInArrow(merge, "page long, twice binary")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for page, twice in merged.where("length(twice) > 0").toLocalIterator():
        out[page * _PAGE // 8 : (page + 1) * _PAGE // 8] = _page(bytes(twice))
    return out


def suspects(docs: DataFrame, shortest: int) -> DataFrame:
    """(doc_id, key) for every line key of a document that a filter suspects in another document."""
    lines = docs.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0]
    wanted = BITS_PER_LINE * (lines or 1)
    parts = -(-wanted // MAX_BITS)
    bits = max(_PAGE, 1 << (-(-wanted // parts) - 1).bit_length())
    ided = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = [_suspected(ided, repeat_filter(docs, bits, shortest, k, parts), bits, shortest, k, parts) for k in range(parts)]
    return reduce(DataFrame.unionByName, found)


def _suspected(ided: DataFrame, filled: np.ndarray, bits: int, shortest: int, part: int, parts: int) -> DataFrame:
    seen = ided.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = list(_keys(text, shortest))
                own, probes = _probes(keys, bits, part, parts)
                at = own[_get(seen.value, probes).all(axis=1)].tolist()
                ids.extend([doc_id] * len(at))
                found.extend(keys[i] for i in at)
            columns = [pa.array(ids, pa.int64()), pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key"])

    return ided.mapInArrow(run, "doc_id long, key string")


def deduplicate_lines(docs: DataFrame, shortest: int = 10, keep: Sequence[str] = ()) -> DataFrame:
    r"""(doc_id, text, *keep, n_lines, n_dropped): documents without lines that an earlier document has.

    Lines end at \n. They are compared without ASCII blanks at their ends and with A-Z in
    lower case; keys under ``shortest`` code points are left alone. A key of two documents or
    more stays in the smallest doc_id only, with all its lines there. Null and empty texts are one empty
    line; a null text stays null. A row without doc_id keeps its lines and takes none from others. Rows
    that share a doc_id are one document. Other columns are dropped unless named in ``keep``.
    """
    found = materialize(suspects(docs, shortest), "suspects")
    first = found.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    repeated = materialize(first.where("first < last").select("key", "first"), "repeated")
    dropped = (
        found.join(repeated, "key").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("key").alias("gone"))
    )
    gone = dropped.select(F.col("doc_id").alias("of"), "gone")
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep]
    rows = docs.select(*columns)
    held = rows.select(F.struct("*").alias("row")).join(gone, F.col("row.doc_id") == F.col("of"), "left")
    schema = T.StructType([*rows.schema, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, texts, n_lines, n_dropped = batch.column(0), [], [], []
            for text, out in zip(row.field(1).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                kept = [x for x in lines if line_key(x, shortest) not in set_out] if (set_out := set(out or ())) else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                texts.append("\n".join(kept) if len(kept) < len(lines) else text)
            rest = [row.field(i) for i in range(2, row.type.num_fields)]
            columns = [row.field(0), pa.array(texts, pa.string()), *rest, pa.array(n_lines), pa.array(n_dropped)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return held.select("row", "gone").mapInArrow(cut, schema)
