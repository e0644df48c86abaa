"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands on the ring at several places. A text belongs to the next shard clockwise of its own place; what
finds that shard full goes on to the next one. The ring has a fixed number of places, so a count of
rows by place is all that is needed to say which places fill which shards (``fill``), and rows are
never gathered by shard: a row's rank within its place gives its shard and its slot there.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirflow.session import materialize

PLACES = 1 << 16  # places of the ring: the first four hex digits of a hash
VIRTUAL = 64  # places a shard stands at
# Rows of one place that are ranked by one window group; places with more are cut by hash, see ``ranked``.
CELL_ROWS = 512
_ORDER_BITS = 60
_COPIES_AT_ONCE = 1 << 16


def _nodes(shards: int, virtual: int) -> list[tuple[int, int]]:
    digest = lambda s, v: hashlib.md5(f"{s}/{v}".encode()).hexdigest()
    return sorted((int(digest(s, v)[:4], 16), s) for s in range(shards) for v in range(virtual))


def _clockwise(nodes: list[tuple[int, int]], place: int) -> Iterator[int]:
    """The shards in the order in which one meets them from a place."""
    seen: set[int] = set()
    first = bisect_left(nodes, (place, -1))
    for step in range(len(nodes)):
        shard = nodes[(first + step) % len(nodes)][1]
        if shard not in seen:
            seen.add(shard)
            yield shard


def fill(
    counts: Mapping[int, int], shards: int, virtual: int = VIRTUAL, slack: float = 0.0
) -> list[tuple[int, int, int, int, int]]:
    """Which rows of which places go where: (place, shard, first rank, rows, first slot).

    Places offer their rows to the first shard they meet, in the order of places, then what is left to the
    second, and so on; no shard takes more than its room. Without slack the rooms are equal but for one row.
    """
    total = sum(counts.values())
    if slack > 0:
        room = [ceil(total * (1 + slack) / shards)] * shards
    else:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    nodes, taken = _nodes(shards, virtual), [0] * shards
    left = dict(sorted(counts.items()))
    walks = {place: _clockwise(nodes, place) for place in left}
    out = []
    while left:
        for place, rows in list(left.items()):
            shard = next(walks[place])
            take = min(rows, room[shard] - taken[shard])
            if take:
                out.append((place, shard, counts[place] - rows, take, taken[shard]))
                taken[shard] += take
            if take == rows:
                del left[place]
            else:
                left[place] = rows - take
    return out


def on_ring(docs: DataFrame) -> DataFrame:
    """Different rows with their place: (place, order, doc_id, size, text_crc32, copies).

    The place comes from the text, so equal texts share it; ``order`` from text and doc_id.
    """
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    number = lambda digest, digits: F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")
    rows = docs.select(
        doc_id.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("0" * 32)).alias("digest"),
    )
    own = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("digest")).cast("binary"))
    placed = rows.select(
        number(F.col("digest"), 4).cast("int").alias("place"), number(own, _ORDER_BITS // 4).alias("order"),
        "doc_id", "size", "text_crc32",
    )
    return placed.groupBy(*placed.columns).agg(F.count("*").alias("copies"))


def ranked(rows: DataFrame, largest: int) -> DataFrame:
    """Adds ``rank``, a row's first rank within its place by ``order``.

    Places are cut into cells by the leading bits of ``order``, as many as the ``largest`` place needs: a
    window ranks within a cell, and one over the cells' counts says where each begins. So a place that
    holds a third of all rows is ranked by many tasks.
    """
    bits = min(_ORDER_BITS, ceil(log2(max(1, largest / CELL_ROWS))))
    celled = rows.withColumn("cell", F.shiftright("order", _ORDER_BITS - bits))
    sizes = celled.groupBy("place", "cell").agg(F.sum("copies").alias("rows"))
    before = W.partitionBy("place").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    begins = sizes.select("place", "cell", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("begin"))
    inside = W.partitionBy("place", "cell").orderBy("order", "doc_id", "size", "text_crc32")
    inside = inside.rowsBetween(W.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("copies").over(inside), F.lit(0))
    # The begins grow with the rows, so they are never broadcast.
    joined = celled.join(begins.hint("merge"), ["place", "cell"])
    return joined.withColumn("rank", F.col("begin") + earlier).drop("begin", "cell")


def shard(docs: DataFrame, shards: int = 16, virtual: int = VIRTUAL, slack: float = 0.0) -> DataFrame:
    """(doc_id, size, text_crc32, shard int, slot long) for every row of documents (doc_id, text).

    Equal texts start at one place of the ring, so they share a shard unless it is full; those beyond its
    room go on clockwise. Without ``slack`` the shards' numbers of rows differ by one at most; with it no shard
    has more than (1 + slack) times its share, and fewer rows leave their first shard. One
    more shard takes its places out of others' and lets the rest stay but for what overflows. Slots
    are gapless from 0 within a shard. size is the text's bytes in UTF-8 plus 1, text_crc32 their
    checksum; a null text has no bytes (size 1, checksum 0) and all null texts are equal. Equal rows are copies that each get a slot
    of their own. Null and repeated ids are ids like others. An empty table has no rows. Other columns are
    ignored. At most ``PLACES`` counts reach the driver, and as many rows and a few for every shard are broadcast.
    """
    rows = materialize(on_ring(docs), "on-ring")
    counts = {place: n for place, n in rows.groupBy("place").agg(F.sum("copies")).collect()}
    schema = "place int, shard int, first long, rows long, first_slot long"
    dealt = docs.sparkSession.createDataFrame(fill(counts, shards, virtual, slack), schema)
    end, stop = F.col("rank") + F.col("copies"), F.col("first") + F.col("rows")
    placed = ranked(rows, max(counts.values(), default=0)).join(F.broadcast(dealt), "place")
    start = F.greatest("rank", "first")
    part = placed.where((F.col("rank") < stop) & (end > F.col("first"))).select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("first_slot") + start - F.col("first")).alias("slot"), (F.least(end, stop) - start).alias("n"),
    )
    # Copies of a row are written out some at a time, so that no array grows with them.
    some = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_COPIES_AT_ONCE).cast("long"))
    blocks = part.withColumn("block", F.explode(some))
    within = F.sequence("block", F.least(F.col("n"), F.col("block") + _COPIES_AT_ONCE) - 1)
    copies = blocks.withColumn("copy", F.explode(within))
    return copies.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("copy")).alias("slot"))
