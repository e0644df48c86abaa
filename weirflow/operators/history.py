"""Status periods (type-2 history) from changes in reading order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.model import DELETE, POS, POS_HI, POS_LO
from weirflow.operators.ordered import OrderedGroups

SEEDED = "seeded"


def status_periods(
    changes: DataFrame,
    keys: Sequence[str],
    status: str = "status",
    ts: str = "ts",
    open_periods: DataFrame | None = None,
    hot_rows: int | None = None,
    skewed: bool | None = None,
) -> DataFrame:
    """Periods each key spent in a status: ``keys, status, valid_from, valid_to, seeded``.

    Events count in reading order, never by timestamp. An unchanged status is no
    event, a change closes one period and opens the next, a delete only closes.
    ``open_periods`` (keys, status, valid_from) are the periods open before the
    batch; a row with ``seeded`` true is such a period, closed or still open.
    ``skewed`` says whether a key may exceed the row limit; None finds out.
    """
    state = F.when(F.col("op") == DELETE, F.lit(None)).otherwise(F.col(status))
    events = changes.select(
        *keys, *POS, state.alias("_s"), F.col(ts).alias("_ts"), F.lit(False).alias(SEEDED)
    )
    if open_periods is not None:
        first = F.lit(-1).cast("bigint")
        events = events.unionByName(
            open_periods.select(
                *keys,
                first.alias(POS_HI),
                first.alias(POS_LO),
                F.col(status).alias("_s"),
                F.col("valid_from").alias("_ts"),
                F.lit(True).alias(SEEDED),
            )
        )
    groups = OrderedGroups(events, keys, POS, hot_rows, skewed)
    # The status itself may be NULL (nothing open), so look back at it boxed.
    looked = groups.with_previous(groups.frame, F.struct(F.col("_s").alias("s")), "_prev")
    moves = looked.filter(~F.col("_s").eqNullSafe(F.col("_prev.s"))).drop("_prev")
    ended = groups.with_next(moves, F.struct(F.col("_ts").alias("t")), "_next")
    return groups.close(ended).filter(F.col("_s").isNotNull()).select(
        *keys,
        F.col("_s").alias(status),
        F.col("_ts").alias("valid_from"),
        F.col("_next.t").alias("valid_to"),
        SEEDED,
    )


def bootstrap_periods(
    replica: DataFrame,
    key: str,
    status: str = "status",
    version: str = "updated_at",
    keep: Sequence[str] = (),
) -> DataFrame:
    """The first open period of every row of a fresh copy."""
    start = F.col(version)
    return replica.select(
        *keep, key, status, start.alias("valid_from"), F.lit(None).cast(
            replica.schema[version].dataType
        ).alias("valid_to"),
    )


def still_open(periods: DataFrame) -> DataFrame:
    return periods.filter(F.col("valid_to").isNull())


def touched_keys(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return changes.select(*keys).distinct()


def touched_open_periods(
    periods: DataFrame, changes: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Open periods of the keys a batch touches; the only history a batch must read."""
    return still_open(periods).join(touched_keys(changes, keys), list(keys), "left_semi")
