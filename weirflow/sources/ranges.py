"""Decoding of polls of any size by ranges of messages.

``decode_messages`` looks back and ahead with windows over a poll. Here messages are cut into ranges of their order, whatever
poll they belong to. One pass sums every range up: its first and last Begin or Commit, and its last
announcement of each relation. A scan over these summaries tells each range what is open where it
begins and which Commit follows where it ends. These stand as rows of their own before and behind the range's share of
a poll, so the same windows then run inside the shares.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.session import materialize
from weirflow.sources.messages import BEGIN, BODY_SCHEMA, COMMIT, RELATION, as_changes, parse_messages

# Most messages a range should have.
RANGE_ROWS = 100_000

_REL = T.StructType([f for f in BODY_SCHEMA if f.name in ("schema_name", "table_name", "columns", "key_columns")])
_SHARE = ["batch_id", "part"]


def _relation() -> Column:
    return F.struct(*[F.col(f"body.{f.name}").alias(f.name) for f in _REL])


def last_relations(messages: DataFrame) -> DataFrame:
    """``rel_id, rel``: every relation as it was announced last, to be kept and given to later polls."""
    said = parse_messages(messages).filter(F.col("kind") == RELATION)
    return said.groupBy(F.col("body.rel_id").alias("rel_id")).agg(F.max_by(_relation(), F.struct("batch_id", "msg_no")).alias("rel"))


def _carried(marked: DataFrame, known: DataFrame | None) -> DataFrame:
    """What each range's share of a poll takes over from its neighbours, as rows before (``side`` -1) and behind it (1).

    A window sees one row per range and poll, another one row per range and relation of its poll.
    """
    place = F.when(F.col("kind").isin(BEGIN, COMMIT), F.col("msg_no"))
    ends = marked.groupBy(*_SHARE).agg(F.max_by("begin", place).alias("last"), F.min_by("commit", place).alias("first"))
    order = W.partitionBy("batch_id").orderBy("part")
    before = F.last("last", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    after = F.expr("lead(first) ignore nulls over (partition by batch_id order by part)")
    ends = ends.select(*_SHARE, before.alias("begin"), after.alias("commit"))
    frames = ends.select(*_SHARE, F.lit(-1).alias("side"), "begin").unionByName(
        ends.select(*_SHARE, F.lit(1).alias("side"), "commit"), allowMissingColumns=True
    )
    said = marked.filter(F.col("kind") == RELATION).groupBy(*_SHARE, "rel_id").agg(F.max_by("rel", "msg_no").alias("rel"))
    shares, rels = ends.select(*_SHARE), said.select("batch_id", "rel_id").distinct()
    if known is not None:
        rels = rels.union(shares.select("batch_id").distinct().crossJoin(known.select("rel_id"))).distinct()
    grid = shares.join(rels, "batch_id").join(said, [*_SHARE, "rel_id"], "left")
    earlier = W.partitionBy("batch_id", "rel_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    grid = grid.withColumn("rel", F.last("rel", ignorenulls=True).over(earlier))
    if known is not None:
        # A poll's own announcements replace what was known before.
        old = known.select("rel_id", F.col("rel").alias("_old"))
        grid = grid.join(old, "rel_id", "left").withColumn("rel", F.coalesce("rel", "_old")).drop("_old")
    heads = grid.filter(F.col("rel").isNotNull()).withColumn("side", F.lit(-1))
    return frames.unionByName(heads, allowMissingColumns=True)


def decode_ranges(
    messages: DataFrame, known: DataFrame | None = None, commits: bool = False, ranges: int | None = None
) -> DataFrame:
    """What ``decode_messages`` gives, for polls of any size; with the same failures.

    ``known`` (rel_id, rel) are relations announced in earlier polls (``last_relations``): a sender
    announces a relation once, so the polls of one connection need them. There are at least ``ranges`` ranges, and
    more if they would have more than some ``RANGE_ROWS`` messages.
    """
    ranges = max(ranges or 1, math.ceil(messages.count() / RANGE_ROWS))
    # Parsed once dealt: the sample that finds the borders then reads messages only.
    dealt = messages.repartitionByRange(ranges, "batch_id", "msg_no").withColumn("part", F.spark_partition_id())
    ranged = materialize(parse_messages(dealt, keep=["part"]), "ranged")
    frame = F.col("kind").isin(BEGIN, COMMIT)
    marked = ranged.withColumns(
        {
            "side": F.lit(0),
            "rel_id": F.col("body.rel_id"),
            "begin": F.when(frame, F.struct("kind", "xid")),
            "commit": F.when(frame, F.struct("kind", "lsn", "commit_lsn", "commit_us")),
            "rel": F.when(F.col("kind") == RELATION, _relation()),
        }
    )
    shares = marked.unionByName(materialize(_carried(marked, known), "carried"), allowMissingColumns=True)

    def look(function: str, value: str, by: str) -> Column:
        return F.expr(f"{function}({value}) ignore nulls over (partition by {by} order by side, msg_no)")

    # The shuffle by share serves both partitionings.
    looked = shares.withColumns({"_begin": look("lag", "begin", "batch_id, part"), "_commit": look("lead", "commit", "batch_id, part")})
    looked = looked.withColumn("_rel", look("lag", "rel", "batch_id, part, rel_id"))
    # What was taken over is no message, so its kind is none that is checked or selected.
    return as_changes(looked.withColumn("kind", F.when(F.col("side") == 0, F.col("kind"))), commits)
