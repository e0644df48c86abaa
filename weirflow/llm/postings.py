"""Comparing all rows under one key, with long lists cut into pairs of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.session import materialize

# Rows under one key that are compared in one unit of work; longer lists become pairs of blocks of this size.
BLOCK = 512
_ROWS_AT_ONCE = 1 << 16
UNIT = ["key", "i", "j"]


def units(postings: DataFrame, deal: str, block: int = BLOCK) -> DataFrame:
    """Postings (key, ...) sorted into units (key, i, j), with the row's own block in ``own``.

    Keys with one row are left out. A list of more than ``block`` rows is dealt to blocks by a hash of the column
    ``deal``, and every pair of blocks is a unit, so no task reads a whole list and no list is shortened.
    """
    sizes = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialize(sizes.select("key", F.ceil(F.col("n") / block).alias("blocks")), "lists")
    rest = [c for c in postings.columns if c != "key"]
    dealt = (
        postings.join(sizes, "key")
        .withColumn("own", F.pmod(F.xxhash64(deal), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *rest)
    )
    return dealt.repartition(*UNIT).sortWithinPartitions(*UNIT)


def _array(column: pa.Array) -> np.ndarray:
    if not pa.types.is_binary(column.type):
        return column.to_numpy()
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


def whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of many whole units at a time; binary columns of one width become matrices of bytes."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            held.append({c: _array(batch.column(k)) for k, c in enumerate(batch.schema.names)})
        if sum(len(t["key"]) for t in held) >= _ROWS_AT_ONCE:
            t = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            last = np.all([t[c] == t[c][-1] for c in UNIT], axis=0)
            held = [{c: v[last] for c, v in t.items()}]
            if not last.all():
                yield {c: v[~last] for c, v in t.items()}
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}


def pairs(t: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of all pairs of rows to compare, some at a time; a pair of rows meets once per key."""
    if not len(t["key"]):
        return
    new = np.ones(len(t["key"]), dtype=bool)
    new[1:] = np.any([t[c][1:] != t[c][:-1] for c in UNIT], axis=0)
    unit = np.cumsum(new) - 1
    end = np.append(np.flatnonzero(new)[1:], len(unit))[unit]
    a, step = np.arange(len(unit)), 1
    while len(a := a[a + step < end[a]]):
        b = a + step
        meet = (t["i"][a] == t["j"][a]) | (t["own"][a] != t["own"][b])
        yield a[meet], b[meet]
        step += 1
