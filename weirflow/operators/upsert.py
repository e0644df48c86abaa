"""Version-checked upserts and deletes as set operations.

Applying changes one after another under "replace when the stored version is
not newer" leaves, per key, the row with the greatest (version, position) among
the changes after the key's last delete. That is what is computed here: one
*net* row per key, which also composes with the stored row and with later nets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirflow.model import DELETE, POS
from weirflow.operators.ordered import has_hot_groups, order_struct
from weirflow.session import hot_group_rows, input_bytes, materialize

RESET = "reset"  # the batch deleted the key at some point: the stored row is void
LIVE = "live"  # the batch leaves a row
# Nets whose files have up to this many bytes are broadcast past the stored rows.
SMALL_NET_BYTES = 8 << 20


def _last_delete(order: Sequence[str]) -> Column:
    return F.max(F.when(F.col("op") == DELETE, order_struct(order)))


def net_changes(
    changes: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    version: str = "updated_at",
    order: Sequence[str] = POS,
    hot_rows: int | None = None,
    skewed: bool | None = None,
) -> DataFrame:
    """One row per key: ``keys, reset, live, columns.., version``.

    ``columns`` are the image columns without keys and version. Ordinary keys
    are settled by a window and an aggregate that share one shuffle. Keys above
    the row limit take another way: their last delete is found by a partial
    aggregate, broadcast (at most rows / limit keys), and the rows behind it are
    reduced on the map side.
    """
    keys = list(keys)
    changes = changes.select(*dict.fromkeys([*keys, "op", *order, *columns, version]))
    if not (has_hot_groups(changes, keys, hot_rows) if skewed is None else skewed):
        return _net_of_ordinary(changes, keys, columns, version, order)
    limit = hot_rows or hot_group_rows(changes.sparkSession)
    hot = (
        changes.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), _last_delete(order).alias("_bar"))
        .filter(F.col("_n") > limit)
        .drop("_n")
    )
    hot = materialize(hot, "hot")
    ordinary = changes.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    barred = changes.join(F.broadcast(hot), keys)
    return _net_of_ordinary(ordinary, keys, columns, version, order).unionByName(
        _survivors(barred, keys, columns, version, order)
    )


def _net_of_ordinary(
    changes: DataFrame,
    keys: list[str],
    columns: Sequence[str],
    version: str,
    order: Sequence[str],
) -> DataFrame:
    barred = changes.withColumn("_bar", _last_delete(order).over(W.partitionBy(*keys)))
    return _survivors(barred, keys, columns, version, order)


def _survivors(
    barred: DataFrame,
    keys: list[str],
    columns: Sequence[str],
    version: str,
    order: Sequence[str],
) -> DataFrame:
    place = order_struct(order)
    counts = (F.col("op") != DELETE) & (F.col("_bar").isNull() | (place > F.col("_bar")))
    best = F.max_by(
        F.struct(*columns, version),
        F.when(counts, F.struct(F.col(version), *[F.col(c) for c in order])),
    )
    return (
        barred.groupBy(*keys)
        .agg(best.alias("_row"), F.max(F.col("_bar").isNotNull()).alias(RESET))
        .select(
            *keys,
            RESET,
            F.col("_row").isNotNull().alias(LIVE),
            *[F.col(f"_row.{c}").alias(c) for c in [*columns, version]],
        )
    )


def merge_net(
    base: DataFrame,
    net: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    version: str = "updated_at",
    small_net: bool = False,
) -> DataFrame:
    """Stored rows with the net applied: ``keys, columns.., version``.

    Both sides hold a key once, so the join has no skew. ``small_net`` says that
    the net was measured and is small: the stored side is then streamed past a
    broadcast net and never shuffled.
    """
    keys = list(keys)
    image = [*columns, version]
    stored = base.select(*keys, F.struct(*image).alias("_old"))
    coming = net.select(*keys, RESET, LIVE, F.struct(*image).alias("_new"))
    if small_net:
        coming = F.broadcast(coming)
        matched = stored.select(*keys).join(coming.select(*keys), keys, "left_semi")
        fresh = net.filter(LIVE).join(F.broadcast(matched), keys, "left_anti")
        paired = stored.join(coming, keys, "left")
    else:
        fresh = None
        paired = stored.join(coming, keys, "full_outer")
    kept = F.when(F.col(RESET).isNull(), F.col("_old")).when(
        F.col("_old").isNull() | F.col(RESET), F.when(F.col(LIVE), F.col("_new"))
    )
    newer = F.col(f"_new.{version}") >= F.col(f"_old.{version}")
    result = paired.select(
        *keys,
        kept.otherwise(
            F.when(F.col(LIVE) & newer, F.col("_new")).otherwise(F.col("_old"))
        ).alias("_row"),
    )
    rows = result.filter(F.col("_row").isNotNull()).select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in image]
    )
    return rows if fresh is None else rows.unionByName(fresh.select(*keys, *image))


def net_rows(net: DataFrame, keys: Sequence[str], image: Sequence[str]) -> DataFrame:
    """The rows a net leaves in an empty table."""
    return net.filter(LIVE).select(*keys, *image)


def as_changes(net: DataFrame, order: Column) -> DataFrame:
    """A net back as changes at batch number ``order``, so that nets fold like changes.

    A reset becomes a delete at the first place of the batch, a live row an
    upsert at the second. Both come from one row without a shuffle.
    """
    steps = F.array(
        F.when(F.col(RESET), F.struct(F.lit(DELETE).alias("op"), F.lit(0).alias("n"))),
        F.when(F.col(LIVE), F.struct(F.lit("U").alias("op"), F.lit(1).alias("n"))),
    )
    return (
        net.withColumn("_step", F.explode(F.array_compact(steps)))
        .withColumn("op", F.col("_step.op"))
        .withColumn(POS[0], order.cast("bigint"))
        .withColumn(POS[1], F.col("_step.n").cast("bigint"))
        .drop("_step", RESET, LIVE)
    )


def fold_nets(
    numbered: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    version: str = "updated_at",
    batch: str = "batch_no",
) -> DataFrame:
    """Nets of several batches (``batch_no``) as one net."""
    return net_changes(as_changes(numbered, F.col(batch)), keys, columns, version)


def apply_changes(
    base: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    version: str = "updated_at",
    hot_rows: int | None = None,
) -> DataFrame:
    """The table after a batch: upserts checked by version, deletes unconditional.

    The net is written first. If its files are small it is broadcast, and the stored rows are not
    shuffled, however many they are.
    """
    net = materialize(net_changes(changes, keys, columns, version, hot_rows=hot_rows), "net")
    size = input_bytes(net)
    return merge_net(base, net, keys, columns, version, size is not None and size <= SMALL_NET_BYTES)


def delete_keys(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``base`` without the keys deleted in ``changes``; no version check."""
    gone = changes.filter(F.col("op") == DELETE).select(*keys).distinct()
    return base.join(gone, list(keys), "left_anti")
