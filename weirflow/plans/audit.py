"""What a reading method loses and why, how far a reader lags, and the truth to score by."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.model import DELETE, POS, POS_HI, POS_LO
from weirflow.operators.history import SEEDED
from weirflow.operators.ordered import OrderedGroups
from weirflow.operators.ranks import values_at_ranks
from weirflow.plans.replay import KEYS, METHOD_NAMES, classify


def capture_audit(log: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Per change and method, captured or why not: ``tbl, pk, seq, poll_no`` and the verdicts."""
    return classify(log, hot_rows)[0].select(*KEYS, "seq", "poll_no", *METHOD_NAMES)


def audit_counts(audit: DataFrame, methods: Sequence[str] = METHOD_NAMES) -> DataFrame:
    """``method, verdict, n_changes``."""
    return (
        audit.unpivot([], list(methods), "method", "verdict")
        .groupBy("method", "verdict")
        .agg(F.count(F.lit(1)).alias("n_changes"))
    )


def truth_counts(
    log: DataFrame,
    status: str = "status",
    initial: DataFrame | None = None,
    late: Column | None = None,
) -> DataFrame:
    """Ground truth of a complete log: ``status_periods, transitions, inserted, deleted, late_keys``.

    Keys in ``initial`` (tbl, pk, status) are there before the log. One shuffle and sort of the log. A
    transition is a change of status of an existing row, an insertion a row that
    appears, a deletion a row that goes.
    """
    removed = F.col("op") == DELETE
    events = log.select(
        *KEYS,
        F.col("commit_lsn").alias(POS_HI),
        F.col("seq").alias(POS_LO),
        F.when(~removed, F.col(status)).alias("s"),
        F.when(~removed, True).alias("there"),
        (F.lit(None).cast("bigint") if late is None else F.when(late, F.col("txid"))).alias("late_txid"),
        F.lit(False).alias(SEEDED),
    )
    if initial is not None:
        first = F.lit(-1).cast("bigint")
        events = events.unionByName(
            initial.select(
                *KEYS, first.alias(POS_HI), first.alias(POS_LO), F.col(status).alias("s"), F.lit(True).alias("there"),
                F.lit(None).cast("bigint").alias("late_txid"), F.lit(True).alias(SEEDED),
            )
        )
    # One look back tells all: a period begins where the status changes, a row where it was not there, and a key's changes
    # of one transaction follow each other in commit order.
    groups = OrderedGroups(events, KEYS, POS)
    state = F.struct("s", "there", "late_txid")
    looked = groups.close(groups.with_previous(groups.frame, state, "_prev"))
    fresh = ~F.col(SEEDED)
    begins = F.col("s").isNotNull() & ~F.col("s").eqNullSafe(F.col("_prev.s"))
    there, was_there = F.col("there").isNotNull(), F.col("_prev.there").isNotNull()
    counts = looked.agg(
        F.count_if(begins).alias("status_periods"),
        F.count_if(begins & fresh).alias("new_periods"),
        F.count_if(there & ~was_there & fresh).alias("inserted"),
        F.count_if(~there & was_there).alias("deleted"),
        F.count_if(F.col("late_txid").isNotNull() & ~F.col("late_txid").eqNullSafe(F.col("_prev.late_txid"))).alias("late_keys"),
    )
    return counts.select(
        "status_periods",
        (F.col("new_periods") - F.col("inserted")).alias("transitions"),
        "inserted",
        "deleted",
        *(["late_keys"] if late is not None else []),
    )


def history_completeness(recorded: DataFrame, true_periods: DataFrame) -> DataFrame:
    """``method, recorded, true_periods, pct, lost`` from one row per method and one true count."""
    rec, tru = F.col("recorded"), F.col("true_periods")
    whole = recorded.withColumn("true_periods", true_periods.select("true_periods").scalar())
    return whole.select(
        "method",
        "recorded",
        "true_periods",
        F.round(F.lit(100.0) * rec / tru, 2).alias("pct"),
        (tru - rec).alias("lost"),
    )


def consumer_lag(log: DataFrame, positions: Mapping[str, int]) -> DataFrame:
    """``consumer, position, end_lsn, lag_bytes, unread`` per commit-order consumer.

    One pass over the log, whatever the number of consumers.
    """
    names = list(positions)
    end = F.max("commit_lsn").alias("end_lsn")
    unread = [
        F.count_if(F.col("commit_lsn") > positions[n]).alias(f"unread_{i}")
        for i, n in enumerate(names)
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("consumer"),
                F.lit(positions[n]).cast("bigint").alias("position"),
                F.col("end_lsn"),
                (F.col("end_lsn") - F.lit(positions[n])).alias("lag_bytes"),
                F.col(f"unread_{i}").alias("unread"),
            )
            for i, n in enumerate(names)
        ]
    )
    return log.agg(end, *unread).select(F.inline(rows))


def poll_statistics(sizes: DataFrame, value: str = "n_changes", by: Sequence[str] = ()) -> DataFrame:
    """``by.., polls, median, p95, total`` over one row per poll.

    p95 is the sorted value at floor(0.95 * (n - 1)), no interpolation; the median of an even number is halfway
    between the two in the middle. Polls are counted, not sorted, whatever their number.
    """
    last = F.col("n") - 1
    ranks = {"p95": F.floor(last * F.lit(0.95)), "lower": F.floor(last / 2), "upper": F.ceil(last / 2)}
    found = values_at_ranks(sizes, value, ranks, by)
    middle = (F.col("lower").cast("double") + F.col("upper")) / 2
    return found.select(*by, F.col("n").alias("polls"), middle.alias("median"), "p95", "total")
