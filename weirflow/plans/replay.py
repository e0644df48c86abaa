"""Replay a complete log under every reading method, as one set query.

The log is typed and complete: ``seq, tbl, op, pk, <columns>, updated_at,
changed_at, commit_lsn, poll_no``. ``poll_no`` is the first poll that could see
the entry's transaction. What each method captures follows from running maxima
over earlier polls, so no poll loop is needed.

A replay may begin with a copy of the tables (``initial``: tbl, pk, columns, updated_at; all tables in one): its rows
are there before the first poll, every method starts behind it (``Starts``), and one mark serves all tables. Keys the log never
touches are the same in every copy, so they are counted and not replayed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.model import DELETE, POS_HI, POS_LO
from weirflow.operators.changes import canonical_changes, canonical_op, change_time
from weirflow.operators.compare import compare_rows, diff_counts
from weirflow.operators.history import status_periods
from weirflow.operators.ordered import OrderedGroups, running_max_before
from weirflow.operators.upsert import merge_net, net_changes, net_rows
from weirflow.session import fits_one_task, lookup_side, materialize

METHOD_NAMES = ("high_watermark", "sequence", "queue", "commit_order")
KEYS = ("tbl", "pk")


def positions_by_poll(log: DataFrame, column: str = "seq") -> DataFrame:
    """``poll_no, max_<column>, prev_max_<column>``: the position before each poll."""
    tops = log.groupBy("poll_no").agg(F.max(column).alias(f"max_{column}"))
    return running_max_before(tops, "poll_no", [f"max_{column}"])


def latest_images(
    log: DataFrame, keys: Sequence[str], columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """The last change per key in commit order, deletes dropped.

    This is what a reader of the table itself can see. Partial aggregation
    leaves one row per key and task before the shuffle.
    """
    last = F.max_by(F.struct("op", *columns), F.struct("commit_lsn", "seq"))
    grouped = log.groupBy(*keys, *by).agg(last.alias("_last"))
    return grouped.filter(F.col("_last.op") != DELETE).select(
        *keys, *by, *[F.col(f"_last.{c}").alias(c) for c in columns]
    )


@dataclass
class Starts:
    """Where each method begins to read: the mark of the tables, a number, a commit position. None reads everything."""

    mark: Column | None = None
    seq: Column | None = None
    commit_lsn: Column | None = None


def starts_after(initial: DataFrame, before: DataFrame | None = None) -> Starts:
    """The starts of all methods right after a copy: its greatest version, and the ends of the log ``before`` it."""
    mark = initial.agg(F.max("updated_at")).scalar()
    if before is None:
        return Starts(mark)
    return Starts(mark, before.agg(F.max("seq")).scalar(), before.agg(F.max("commit_lsn")).scalar())


def _behind(before: str, start: Column | None) -> Column:
    """The position before a poll: the running maximum, or the start if that is further (NULL: nothing was read)."""
    return F.col(before) if start is None else F.greatest(before, start)


def classify(log: DataFrame, hot_rows: int | None = None, starts: Starts | None = None) -> tuple[DataFrame, bool]:
    """Each change with one verdict column per method, and whether a key is hot.

    captured; late (its number, version or commit was already passed when it
    committed); superseded (a later change of the key surfaced in the same poll);
    delete (the method cannot see deletes); not_visible (no poll has seen it yet, ``poll_no`` is NULL). Rows are shuffled once, by key, and
    every later step per key (look-ahead, upserts, periods) works on that.
    """
    starts = starts or Starts()
    groups = OrderedGroups(log, KEYS, ["commit_lsn", "seq"], hot_rows)
    frame = groups.frame if groups.split else groups.frame.repartition(*KEYS)
    followed = groups.close(
        groups.with_next(frame, F.col("seq"), "_next_seq", within=["poll_no"])
    )
    if not fits_one_task(log):
        followed = materialize(followed, "followed")  # the maxima and the rows below both come from it
    removed = F.col("op") == DELETE
    surfaced = F.col("_next_seq").isNull() & ~removed
    by_poll = followed.groupBy("poll_no").agg(
        F.max("seq").alias("max_seq"), F.max(F.when(surfaced, F.col("updated_at"))).alias("mark")
    )
    prev = lookup_side(
        running_max_before(by_poll, "poll_no", ["max_seq", "mark"]).drop("max_seq", "mark")
    )
    passed = F.col("seq") <= _behind("prev_max_seq", starts.seq)
    # The mark never falls, so an image missed when it surfaces stays missed.
    old = F.col("updated_at") <= _behind("prev_mark", starts.mark)
    polled = (
        F.when(removed, "delete")
        .when(F.col("_next_seq").isNotNull(), "superseded")
        .when(old, "late")
        .otherwise("captured")
    )
    done = F.lit(False) if starts.commit_lsn is None else F.col("commit_lsn") <= starts.commit_lsn
    verdicts = {
        "high_watermark": polled,
        "sequence": F.when(passed, "late").otherwise("captured"),
        "queue": F.lit("captured"),
        "commit_order": F.when(done, "late").otherwise("captured"),
    }
    unseen = F.col("poll_no").isNull()
    verdicts = {m: F.when(unseen, "not_visible").otherwise(v) for m, v in verdicts.items()}
    judged = followed.join(prev, "poll_no", "left").withColumns(verdicts)
    return judged.drop("_next_seq", "prev_max_seq", "prev_mark"), groups.split


def _as_read(
    judged: DataFrame, columns: Sequence[str], methods: Sequence[str]
) -> DataFrame:
    """A row per change and method that captured it, placed in the method's reading order."""
    unknown = set(methods) - set(METHOD_NAMES)
    if unknown:
        raise ValueError(f"unknown reading methods: {sorted(unknown)}")
    readings = [
        F.when(
            F.col(m) == "captured",
            F.struct(
                F.lit(m).alias("method"),
                F.col("commit_lsn" if m == "commit_order" else "poll_no").alias(POS_HI),
            ),
        )
        for m in methods
    ]
    return judged.withColumn("_read", F.explode(F.array_compact(F.array(*readings)))).select(
        F.col("_read.method").alias("method"),
        *KEYS,
        canonical_op("op").alias("op"),
        change_time("op", "updated_at", "changed_at").alias("ts"),
        F.col(f"_read.{POS_HI}").cast("bigint").alias(POS_HI),
        F.col("seq").cast("bigint").alias(POS_LO),
        "poll_no",
        "seq",
        *columns,
        "updated_at",
    )


def capture_by_method(
    log: DataFrame,
    columns: Sequence[str],
    methods: Sequence[str] = METHOD_NAMES,
    starts: Starts | None = None,
) -> DataFrame:
    """All changes each method captures: ``method, tbl, pk, op, ts, pos.., poll_no, seq, ..``."""
    return _as_read(classify(log, starts=starts)[0], columns, methods)


def _seeds(initial: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Each row of a copy once per method: a fixed fan-out by the number of methods."""
    return initial.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))


def replicas(
    captured: DataFrame,
    columns: Sequence[str],
    skewed: bool | None = None,
    initial: DataFrame | None = None,
) -> DataFrame:
    """The copy each method ends with, starting empty or with the rows of ``initial`` (method, tbl, pk, ..)."""
    keys = ["method", *KEYS]
    net = net_changes(captured, keys, columns, skewed=skewed)
    if initial is None:
        return net_rows(net, keys, [*columns, "updated_at"])
    return merge_net(initial, net, keys, columns)


def histories(
    captured: DataFrame,
    status: str = "status",
    skewed: bool | None = None,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Periods each method records, starting with none or with the open ones of ``initial`` (method, tbl, pk, ..)."""
    before = None
    if initial is not None:
        before = initial.select("method", *KEYS, status, F.col("updated_at").alias("valid_from"))
    return status_periods(captured, ["method", *KEYS], status, open_periods=before, skewed=skewed).drop("seeded")


def _first_rows(initial: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A copy's rows as changes that committed before all others."""
    first = {"seq": F.lit(-1).cast("bigint"), "commit_lsn": F.lit(-1).cast("bigint"), "op": F.lit("I")}
    return initial.withColumns(first).select("seq", "commit_lsn", "op", *KEYS, *columns, "updated_at")


def truth(log: DataFrame, columns: Sequence[str], initial: DataFrame | None = None) -> DataFrame:
    """The source after the whole log, which began with ``initial`` or empty."""
    image = [*columns, "updated_at"]
    changes = log.select("seq", "commit_lsn", "op", *KEYS, *image)
    if initial is not None:
        changes = changes.unionByName(_first_rows(initial, columns))
    return latest_images(changes, KEYS, image)


def true_history(log: DataFrame, status: str = "status") -> DataFrame:
    everything = canonical_changes(log, ["commit_lsn", "seq"], keep=[status])
    return status_periods(everything, KEYS, status).drop("seeded")


def score_tables(
    log: DataFrame,
    columns: Sequence[str],
    methods: Sequence[str] = METHOD_NAMES,
    initial: DataFrame | None = None,
    starts: Starts | None = None,
) -> DataFrame:
    """``method, tbl, changes_applied, source_rows, missing, stale, ghost, rows_wrong, periods``.

    With ``initial`` every method starts from that copy, by default right behind its greatest version
    and before the whole log.
    """
    touched = None
    if initial is not None:
        initial = initial.select(*KEYS, *columns, "updated_at")
        starts = starts or starts_after(initial)
        # The log's keys may be too many to broadcast; both sides have a key's rows in one task.
        touched = initial.join(log.select(*KEYS).distinct(), list(KEYS), "left_semi")
        touched = materialize(touched, "touched")
    judged, skewed = classify(log, starts=starts)
    # Read by three steps below; each shuffles it by key before a change becomes a row per method, not after.
    judged = materialize(judged, "judged")
    captured = _as_read(judged if skewed else judged.repartition(*KEYS), columns, methods)
    seeds = None if touched is None else _seeds(touched, methods)
    image, keys = [*columns, "updated_at"], ["method", *KEYS]
    compared = compare_rows(
        _seeds(truth(log, columns, touched), methods), replicas(captured, columns, skewed, seeds), keys, image
    )
    by = ["method", "tbl"]
    wrong = diff_counts(compared, by)
    applied = captured.groupBy(*by).agg(F.count(F.lit(1)).alias("changes_applied"))
    recorded = histories(captured, skewed=skewed, initial=seeds).groupBy(*by).agg(F.count(F.lit(1)).alias("periods"))
    counts = ["changes_applied", "source_rows", "missing", "stale", "ghost", "periods"]
    parts = [wrong, applied, recorded]
    if initial is not None:
        # Rows of keys without a change: right in every copy, one open period each.
        one = F.count(F.lit(1))
        both = initial.groupBy("tbl").agg(one.alias("n")).unionByName(touched.groupBy("tbl").agg((-one).alias("n")))
        quiet = both.groupBy("tbl").agg(F.sum("n").alias("source_rows")).withColumn("periods", F.col("source_rows"))
        parts.append(_seeds(quiet, methods))
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part, allowMissingColumns=True)
    summed = total.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])
    all_wrong = (F.col("missing") + F.col("stale") + F.col("ghost")).alias("rows_wrong")
    return summed.select(*by, *counts[:-1], all_wrong, "periods")


def score_methods(
    log: DataFrame,
    columns: Sequence[str],
    methods: Sequence[str] = METHOD_NAMES,
    initial: DataFrame | None = None,
    starts: Starts | None = None,
) -> DataFrame:
    """``method, changes_applied, source_rows, missing, stale, ghost, rows_wrong, periods`` over all tables."""
    scores = score_tables(log, columns, methods, initial, starts)
    return scores.groupBy("method").agg(*[F.sum(c).alias(c) for c in scores.columns[2:]])
