"""Mixing sources to target weights with whole blocks of tokens, apportioned by Sainte-Lague."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.session import materialize

WEIGHTS = (5, 2, 1)
REPEATS = 3  # a source gives at most so many times its size
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 18
SHARD_DOCS = 1 << 14
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def with_sizes(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, *carry, size, digest): size counts the words of the text, none in a null text; digest tells texts apart."""
    named = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *carry]
    schema = T.StructType([*docs.select(*named).schema, T.StructField("size", T.LongType()), T.StructField("digest", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
            sizes = pa.array([len(t.split()) for t in texts], pa.int64())
            digests = pa.array([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], sizes, digests], names=schema.names)

    words = F.col("text").cast("string")
    return docs.select(words.alias("_words"), *named).mapInArrow(run, schema)


def numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """Adds each row's place, from 0, in a global order; only counts of partitions meet in one task."""
    placed = materialize(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.join(offsets, part == F.col("_part")).select(*df.columns, place.alias(name))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, sid, source_size, n_docs, target) per source, from (source, size).

    Sources in code point order, null last, take the weights in turn and share all words by
    them. No target exceeds ``repeats`` times its source; the excess is shared again by weight
    among the others until none is above. All sources empty: all targets are 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = F.element_at(F.lit(list(weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    per = materialize(numbered(per, F.col("source").asc_nulls_last(), "sid").withColumn("weight", turn), "sources")
    most, level, before = F.col("source_size") * repeats, 0.0, -1
    while True:  # the level rises, so each round stops more sources; it ends when none is added
        full = F.col("weight") * F.lit(level) > most
        row = per.agg(
            F.sum("source_size"), F.sum(F.when(full, most).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight"))), F.sum(full.cast("long"))
        ).first()
        if row[3] == before or not row[0]:
            break
        before, level = (row[3] if level else -1), (row[0] - row[1]) / row[2]
    target = F.least(F.col("weight") * F.lit(level), most.cast("double"))
    return per.select("source", "sid", "source_size", "n_docs", target.alias("target"))


def sainte_lague(parties: DataFrame, group: Sequence[str], party: str, votes: str, seats: str) -> DataFrame:
    """(*group, party, quota): whole seats by the highest quotients votes / 1, votes / 3, votes / 5, ...

    ``seats`` is the same in all rows of a group. Of n parties with V votes, the seats above the
    quotient V / (2 * seats - n) are sure, those below V / (2 * seats + n) are lost, so only about 4 * n
    quotients are ranked whatever the number of seats. Ties go to the smaller party. Without votes no seats are given.
    """
    w = Window.partitionBy(*group)
    share = F.try_divide(F.col(votes), F.sum(votes).over(w))
    n, k = F.count("*").over(w), F.col(seats)
    sure = F.greatest(F.lit(0), F.floor(share * (k - n / 2) + 0.5) - 1)
    most = F.when(F.col(votes) > 0, F.floor(share * (k + n / 2) + 0.5) + 1).otherwise(0)
    bounds = parties.select(*group, party, votes, seats, F.coalesce(sure, F.lit(0)).cast("long").alias("sure"), most.cast("long").alias("most"))
    open_seats = F.col(seats) - F.sum("sure").over(w)
    candidates = bounds.select("*", open_seats.alias("open")).withColumn(
        "seat", F.explode_outer(F.when(F.col("most") > F.col("sure"), F.sequence(F.col("sure") + 1, F.col("most"))))
    )
    quotient = F.col(votes) / (2 * F.col("seat") - 1)
    rank = F.row_number().over(w.orderBy(quotient.desc_nulls_last(), F.col(party)))
    won = F.sum((F.col("seat").isNotNull() & (F.col("rank") <= F.col("open"))).cast("long"))
    return (
        candidates.withColumn("rank", rank)
        .groupBy(*group, party)
        .agg((F.first("sure") + won).alias("quota"))
    )


def sainte_lague_of_all(parties: DataFrame, party: str, votes: str, seats: int) -> DataFrame:
    """(party, quota) as ``sainte_lague`` gives it for one group of any number of parties: quotients are ranked over all tasks."""
    total, n = parties.agg(F.sum(votes), F.count("*")).first()
    share = F.try_divide(F.col(votes), F.lit(total))
    sure = F.greatest(F.lit(0), F.floor(share * (seats - n / 2) + 0.5) - 1)
    most = F.when(F.col(votes) > 0, F.floor(share * (seats + n / 2) + 0.5) + 1).otherwise(0)
    bounds = parties.select(party, votes, F.coalesce(sure, F.lit(0)).cast("long").alias("sure"), most.cast("long").alias("most"))
    bounds = materialize(bounds, "bounds")
    left = seats - (bounds.agg(F.sum("sure")).first()[0] or 0)
    candidates = bounds.where(F.col("most") > F.col("sure")).select(
        party, votes, F.explode(F.sequence(F.col("sure") + 1, F.col("most"))).alias("seat")
    )
    places = candidates.select(party, (-F.col(votes) / (2 * F.col("seat") - 1)).alias("place"))
    ranked = numbered(places, F.struct("place", party), "rank").where(F.col("rank") < left)
    won = ranked.groupBy(F.col(party).alias("_party")).agg(F.count("*").alias("won"))
    joined = bounds.join(won, F.col(party) == F.col("_party"), "left")
    return joined.select(party, (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota"))


def sainte_lague_of_groups(parties: DataFrame, group: str, party: str, votes: str, seats: str) -> DataFrame:
    """(group, party, quota) as ``sainte_lague`` gives it, for groups of any number of parties.

    The quotients of all groups are ranked in one order over all tasks; a group's own ranks begin where it begins.
    """
    sums = parties.groupBy(F.col(group).alias("_g")).agg(F.sum(votes).alias("_votes"), F.count("*").alias("_n"))
    joined = parties.join(sums, F.col(group) == F.col("_g"))
    share, k, n = F.try_divide(F.col(votes), F.col("_votes")), F.col(seats), F.col("_n")
    sure = F.greatest(F.lit(0), F.floor(share * (k - n / 2) + 0.5) - 1)
    most = F.when(F.col(votes) > 0, F.floor(share * (k + n / 2) + 0.5) + 1).otherwise(0)
    bounds = joined.select(group, party, votes, seats, F.coalesce(sure, F.lit(0)).cast("long").alias("sure"), most.cast("long").alias("most"))
    bounds = materialize(bounds, "bounds")
    candidates = bounds.where(F.col("most") > F.col("sure")).select(
        group, party, votes, F.explode(F.sequence(F.col("sure") + 1, F.col("most"))).alias("seat")
    )
    places = candidates.select(group, party, (-F.col(votes) / (2 * F.col("seat") - 1)).alias("place"))
    ranked = materialize(numbered(places, F.struct(group, "place", party), "rank"), "ranked")
    left = bounds.groupBy(F.col(group).alias("_g")).agg((F.first(seats) - F.sum("sure")).alias("left"))
    start = ranked.groupBy(F.col(group).alias("_s")).agg(F.min("rank").alias("start"))
    limits = left.join(start, F.col("_g") == F.col("_s")).select("_g", (F.col("start") + F.col("left")).alias("limit"))
    won = ranked.join(limits, F.col(group) == F.col("_g")).where("rank < limit").groupBy(group, party).agg(F.count("*").alias("won"))
    quota = (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota")
    return bounds.join(won, [group, party], "left").select(group, party, quota)


def _seeded(text: Column, seed: int) -> Column:
    """A whole number below 2**60 from a seed and a text, the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text)), 1, 15), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    repeats: int = REPEATS,
    block_words: int = BLOCK_WORDS,
    seed: int = 17,
    carry: Sequence[str] = (),
) -> DataFrame:
    """What a mix takes of every document: (doc_id, source, *carry, size, source_size, target, taken, ...).

    A source's documents are dealt to shards and put in a seeded order there; the words of a shard, in that
    order, form blocks of ``block_words`` words, the last one shorter. Blocks are apportioned to
    sources by their targets and to the shards of a source by their words. A shard with b blocks and a quota of q takes all its blocks
    q / b times and the rest spread evenly from a seeded start. ``taken`` counts the words so taken, repeats included; it is at
    most ``repeats`` times the size. The columns ``whole, first_word, extra, blocks, turn`` say which words:
    see ``taken_text``. The same rows give the same mix. Null texts have size 0, null sources are one source,
    rows without doc_id are placed by their text, so they are dealt to all shards. Rows that share an id are told apart by their text.
    """
    narrow = materialize(with_sizes(docs), "sizes")
    sources = materialize(source_targets(narrow, weights, repeats), "targets")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    quotas = sainte_lague_of_all(sources, "sid", "target", int(total / block_words + 0.5)).withColumnRenamed("quota", "source_quota")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("n_docs") / SHARD_DOCS))
    sources = materialize(sources.join(quotas, "sid").withColumn("shards", shards.cast("long")), "quotas")

    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("digest").cast("string")))
    place = _seeded(named, seed)

    def dealt(rows: DataFrame) -> DataFrame:
        s = sources.select(F.col("source").alias("s"), "sid", "source_size", "target", "source_quota", "shards")
        joined = rows.join(s, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("place", place)
        return joined.withColumn("shard", F.pmod("place", "shards"))

    words = dealt(narrow).groupBy("sid", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("seats"))
    words = materialize(words, "shards")
    shares = sainte_lague_of_groups(words, "sid", "shard", "words", "seats").join(words, ["sid", "shard"])
    blocks = F.greatest(F.lit(1), F.ceil(F.col("words") / block_words)).cast("long")
    quota = F.least("quota", repeats * F.col("blocks"))
    shares = shares.withColumn("blocks", blocks).select(
        "sid", "shard", "blocks",
        F.floor(quota / F.col("blocks")).alias("whole"),
        (quota % F.col("blocks")).alias("extra"),
        F.pmod(_seeded(F.concat_ws("/", "sid", "shard"), seed), "blocks").alias("turn"),
    )
    shares = materialize(shares, "shares")
    order = Window.partitionBy("sid", "shard").orderBy("place", "doc_id", "size", "digest")
    first = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = dealt(with_sizes(docs, carry) if carry else narrow).join(shares, ["sid", "shard"]).withColumn("first_word", first)

    def chosen(block: Column) -> Column:  # blocks chosen before this one
        return F.floor((block * F.col("extra") + F.col("turn")) / F.col("blocks"))

    def before(word: Column) -> Column:  # words of chosen blocks before this word
        b = F.floor(word / block_words)
        return block_words * chosen(b) + word % block_words * (chosen(b + 1) - chosen(b))

    last = F.col("first_word") + F.col("size")
    taken = F.col("whole") * F.col("size") + before(last) - before(F.col("first_word"))
    return rows.select(
        "doc_id", "source", *carry, "size", "source_size", "target", taken.cast("long").alias("taken"),
        "whole", "first_word", "extra", "blocks", "turn", F.lit(block_words).alias("block_words"),
    )


def taken_text(text: str | None, whole: int, first: int, extra: int, blocks: int, turn: int, block: int) -> str:
    r"""The words a mix takes of a text: the text ``whole`` times, then the stretches in chosen blocks, joined by \n."""
    data = (text or "").encode()
    chosen = lambda b: ((b + 1) * extra + turn) // blocks > (b * extra + turn) // blocks
    out, start, end = [data] * whole, None, 0
    for n, word in enumerate(_WORD.finditer(data), first):
        if chosen(n // block):
            start, end = (word.start() if start is None else start), word.end()
        elif start is not None:
            out.append(data[start:end])
            start = None
    if start is not None:
        out.append(data[start:end])
    return b"\n".join(out).decode()
