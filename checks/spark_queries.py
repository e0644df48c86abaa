"""One Spark query per operator, each over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from weirflow.functions import documents as doc
from weirflow.functions import positions as lsn
from weirflow.model import POS_HI, POS_LO, TableSpec
from weirflow.operators import changes as ch
from weirflow.operators import compare as cmp
from weirflow.operators import history as hist
from weirflow.operators import quality as qc
from weirflow.operators import upsert as up
from weirflow.plans import audit, replay
from weirflow.session import materialize
from weirflow.session import new_folder as _new_folder
from weirflow.sources import capture as cap
from weirflow.sources import landed as landed_source
from weirflow.sources import messages as msg
from weirflow.sources import ranges, runs
from weirflow.sources.snapshot import declared_columns, load_tables
from weirflow.streaming import lag, stateful, sync
from weirflow.streaming.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The driver tables as captured tables.
USERS = TableSpec(
    "users",
    "pk",
    (("pk", "bigint"), ("status", "string"), ("amount_cents", "bigint")),
    version_type="timestamp_ntz",
    tracked="status",
)
STORED_ORDERS = TableSpec(
    "orders",
    "o_orderkey",
    (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string")),
    version="o_orderdate",
    version_type="timestamp_ntz",
    tracked="o_orderstatus",
)
STORED_CUSTOMERS = TableSpec(
    "customer",
    "c_custkey",
    (("c_custkey", "bigint"), ("c_name", "string"), ("c_mktsegment", "string")),
    version="loaded_at",
    version_type="timestamp_ntz",
)
COLUMNS = ["status", "amount_cents"]
IMAGE = [*COLUMNS, "updated_at"]
# Parameters of single-poll queries.
POLL = 5
MARK = "1997-06-01 00:00:00"
SPLIT_POLL = 5
# Polls after which a reader comes by; the source has grown in between.
SYNC_POLLS = (2, 5, 1 << 40)
LAG_POSITIONS = {"reader_a": 0, "reader_b": 1000, "reader_c": 15_000}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _log(spark: SparkSession, d: str, hot: bool = False) -> DataFrame:
    return fx.derive(spark, d, fx.HOT_LOG_SQL if hot else fx.LOG_SQL)


def _messages(log: DataFrame) -> DataFrame:
    """The log's messages as landed files, which is what a decoder reads."""
    return materialize(fx.message_table(log), "messages")


def _commit_changes(log: DataFrame) -> DataFrame:
    return ch.canonical_changes(log, ["commit_lsn", "seq"], keep=COLUMNS)


def _queue_changes(log: DataFrame) -> DataFrame:
    return ch.canonical_changes(log, ["poll_no", "seq"], keep=COLUMNS)


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


# ---- scans -------------------------------------------------------------------------


@query
def snapshot_scan(spark: SparkSession, d: str) -> DataFrame:
    loaded_at = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    return declared_columns(fx.table(spark, d, "customer"), STORED_CUSTOMERS, loaded_at)


@query
def snapshot_parts(spark: SparkSession, d: str) -> DataFrame:
    """A whole table written as part files and read back as a first version."""
    folder = _new_folder(spark, "snapshot")
    fx.table(spark, d, "customer").repartition(3).write.parquet(f"{folder}/customer")
    loaded_at = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    return load_tables(spark, folder, [STORED_CUSTOMERS], loaded_at)["customer"]


@query
def bootstrap_history(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "orders").select(*STORED_ORDERS.all_names)
    return hist.bootstrap_periods(rows, "o_orderkey", "o_orderstatus", "o_orderdate")


@query
def high_watermark_start(spark: SparkSession, d: str) -> DataFrame:
    tables = [fx.table(spark, d, "orders"), fx.table(spark, d, "lineitem")]
    return cap.greatest_version(tables, ["o_orderdate", "l_shipdate"])


def _above_mark(spark: SparkSession, d: str) -> DataFrame:
    mark = F.lit(MARK).cast("timestamp_ntz")
    orders = cap.above_mark(fx.table(spark, d, "orders"), mark, "o_orderdate")
    lines = cap.above_mark(fx.table(spark, d, "lineitem"), mark, "l_shipdate")
    return ch.union_tables(
        [
            rows.select(
                F.lit(name).alias("tbl"), F.col(key).alias("pk"), F.col(at).alias("ts"),
                F.unix_micros(F.col(at).cast("timestamp")).alias(POS_HI), F.col(key).alias(POS_LO),
            )
            for name, rows, key, at in (
                ("orders", orders, "o_orderkey", "o_orderdate"),
                ("lineitem", lines, "l_orderkey", "l_shipdate"),
            )
        ]
    ).withColumn("op", F.lit("U"))


@query
def high_watermark_poll(spark: SparkSession, d: str) -> DataFrame:
    return _above_mark(spark, d)


@query
def high_watermark_position(spark: SparkSession, d: str) -> DataFrame:
    return cap.new_position(_above_mark(spark, d), "ts", F.lit(MARK).cast("timestamp_ntz"))


@query
def seq_poll(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    before = replay.positions_by_poll(log).filter(F.col("poll_no") == POLL)
    position = before.select("prev_max_seq").scalar()
    read = cap.after_sequence(cap.visible(log, POLL), position)
    return ch.canonical_changes(read, ["seq"], keep=["seq", *COLUMNS]).drop(POS_LO)


@query
def queue_poll(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    read = cap.not_taken(cap.visible(log, POLL), cap.visible(log, POLL - 1))
    return ch.canonical_changes(read, ["seq"], keep=["seq", *COLUMNS]).drop(POS_LO)


@query
def queue_poll_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The same poll with the numbers taken before kept as runs."""
    log = _log(spark, d)
    taken = materialize(runs.joined_runs(cap.visible(log, POLL - 1)), "taken")
    read = runs.outside_runs(cap.visible(log, POLL), taken)
    return ch.canonical_changes(read, ["seq"], keep=["seq", *COLUMNS]).drop(POS_LO)


@query
def taken_runs(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of three polls as runs, each joined to those of the polls before."""
    log, taken = _log(spark, d), None
    for low, high in ((-1, 1), (1, 4), (4, POLL)):
        seen = log.filter((F.col("poll_no") > low) & (F.col("poll_no") <= high))
        taken = materialize(runs.joined_runs(seen, taken), "taken")
    return taken


@query
def commit_order_poll(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    done = cap.visible(log, POLL - 1).agg(F.max("commit_lsn")).scalar()
    read = cap.after_commit(cap.visible(log, POLL), done)
    return ch.canonical_changes(read, ["commit_lsn", "seq"], keep=COLUMNS)


@query
def next_position_by_poll(spark: SparkSession, d: str) -> DataFrame:
    return replay.positions_by_poll(_log(spark, d))


@query
def latest_image_at_poll(spark: SparkSession, d: str) -> DataFrame:
    return replay.latest_images(cap.visible(_log(spark, d), POLL), replay.KEYS, IMAGE)


# ---- canonical changes ---------------------------------------------------------------


@query
def canonical_changes(spark: SparkSession, d: str) -> DataFrame:
    return _commit_changes(_log(spark, d))


@query
def document_changes(spark: SparkSession, d: str) -> DataFrame:
    """Rows to documents and back: the key and the typed columns come from the text.

    Every third document gives its time with an offset, as an instant.
    """
    names = ["pk", *IMAGE]
    log = _log(spark, d)
    text = doc.row_document(names)
    zoned = F.regexp_replace(text, r'("updated_at":"[^"]*)"', '$1+00:00"')
    text = F.when(F.col("seq") % 3 == 0, zoned).otherwise(text)
    with_doc = ch.canonical_changes(
        log.withColumn("doc", F.when(F.col("op") != "D", text)),
        ["commit_lsn", "seq"],
        keep=["doc"],
    ).withColumn("pk", F.coalesce(doc.document_key("doc", "pk"), "pk"))
    return ch.route(ch.known_tables(with_doc, ["users"]), USERS)


@query
def published_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes of two tables, of which only one is listed for capture."""
    changes = _commit_changes(_log(spark, d))
    other = changes.withColumn("tbl", F.lit("unlisted"))
    kept = ch.published(ch.union_tables([changes, other]), ["users"])
    return kept.groupBy("tbl", "op").agg(F.count(F.lit(1)).alias("n_changes"))


@query
def changelog_from_snapshots(spark: SparkSession, d: str) -> DataFrame:
    before, after = fx.derive(spark, d, fx.COPY_SQL), fx.derive(spark, d, fx.SOURCE_SQL)
    columns = ["o_custkey", "o_orderstatus", "o_orderdate"]
    return ch.changes_between(before, after, "o_orderkey", columns)


@query
def smallest_key(spark: SparkSession, d: str) -> DataFrame:
    orders = fx.table(spark, d, "orders").select(*STORED_ORDERS.all_names)
    return ch.smallest_key_row(orders, "o_orderkey")


@query
def time_texts(spark: SparkSession, d: str) -> DataFrame:
    events = fx.table(spark, d, "events")
    return events.select(
        "event_id",
        doc.iso_text("ts").alias("iso"),
        doc.clock_text("ts", "+00:00").alias("clock"),
        doc.from_iso_text(doc.iso_text("ts")).cast("timestamp_ntz").alias("ts_back"),
    )


# ---- apply ---------------------------------------------------------------------------


def _upserts(spark: SparkSession, d: str) -> DataFrame:
    return fx.derive(spark, d, fx.UPSERTS_SQL).withColumns(
        {POS_HI: F.col("pos"), POS_LO: F.lit(0).cast("bigint")}
    )


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return fx.derive(spark, d, fx.STORED_SQL)


@query
def versioned_upsert(spark: SparkSession, d: str) -> DataFrame:
    upserts = _upserts(spark, d).filter(F.col("op") == "U")
    return up.apply_changes(_stored(spark, d), upserts, ["pk"], ["status"])


@query
def key_delete(spark: SparkSession, d: str) -> DataFrame:
    return up.delete_keys(_stored(spark, d), _upserts(spark, d), ["pk"])


@query
def apply_batch(spark: SparkSession, d: str) -> DataFrame:
    return up.apply_changes(_stored(spark, d), _upserts(spark, d), ["pk"], ["status"])


@query
def fold_batches(spark: SparkSession, d: str) -> DataFrame:
    """Net rows of every poll, folded: equals applying the whole log."""
    changes = _queue_changes(_log(spark, d)).withColumn("batch_no", F.col(POS_HI))
    nets = up.net_changes(changes, ["batch_no", "pk"], COLUMNS)
    return up.net_rows(up.fold_nets(nets, ["pk"], COLUMNS), ["pk"], IMAGE)


# ---- history -------------------------------------------------------------------------


@query
def scd2_history(spark: SparkSession, d: str) -> DataFrame:
    return hist.status_periods(_commit_changes(_log(spark, d)), ["pk"]).drop("seeded")


@query
def scd2_history_busy_keys(spark: SparkSession, d: str) -> DataFrame:
    changes = _commit_changes(_log(spark, d, hot=True))
    return hist.status_periods(changes, ["pk"]).drop("seeded")


# Rows from which on a group counts as hot in the queries below, so that small inputs take that way too.
HOT_ROWS = 50


@query
def scd2_history_split(spark: SparkSession, d: str) -> DataFrame:
    """Busy keys cut in reading order, as if each were too big for one task."""
    changes = _commit_changes(_log(spark, d, hot=True))
    return hist.status_periods(changes, ["pk"], hot_rows=HOT_ROWS).drop("seeded")


@query
def net_of_hot_keys(spark: SparkSession, d: str) -> DataFrame:
    """Upserts of busy keys, reduced behind a broadcast last delete."""
    net = up.net_changes(_queue_changes(_log(spark, d, hot=True)), ["pk"], COLUMNS, hot_rows=HOT_ROWS)
    return up.net_rows(net, ["pk"], IMAGE)


@query
def open_periods(spark: SparkSession, d: str) -> DataFrame:
    return hist.still_open(scd2_history(spark, d)).drop("valid_to")


def _split_log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    changes = _queue_changes(_log(spark, d))
    at = F.col(POS_HI)
    return changes.filter(at <= SPLIT_POLL), changes.filter(at > SPLIT_POLL)


@query
def touched_open_periods(spark: SparkSession, d: str) -> DataFrame:
    early, late = _split_log(spark, d)
    stored = hist.status_periods(early, ["pk"]).drop("seeded")
    nxt = late.filter(F.col(POS_HI) == SPLIT_POLL + 1)
    return hist.touched_open_periods(stored, nxt, ["pk"]).drop("valid_to")


@query
def history_across_batches(spark: SparkSession, d: str) -> DataFrame:
    """A second batch against the stored open periods gives what one batch would."""
    early, late = _split_log(spark, d)
    stored = hist.status_periods(early, ["pk"]).drop("seeded")
    before = hist.touched_open_periods(stored, late, ["pk"]).drop("valid_to")
    fresh = hist.status_periods(late, ["pk"], open_periods=before).drop("seeded")
    closed = stored.filter(F.col("valid_to").isNotNull())
    quiet = hist.still_open(stored).join(hist.touched_keys(late, ["pk"]), "pk", "left_anti")
    return ch.union_tables([closed, quiet, fresh])


# ---- comparison ----------------------------------------------------------------------

_PAIR_COLUMNS = ["o_custkey", "o_orderstatus", "o_orderdate"]


def _pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return fx.derive(spark, d, fx.SOURCE_SQL), fx.derive(spark, d, fx.COPY_SQL)


def _report(spark: SparkSession, d: str) -> DataFrame:
    source, copy = _pair(spark, d)
    customers = fx.table(spark, d, "customer")
    return cmp.diff_tables(
        {
            "orders": (source, copy, "o_orderkey", _PAIR_COLUMNS),
            "customer": (
                customers.filter(F.col("c_custkey") % 5 != 0), customers, "c_custkey", ["c_name"],
            ),
        }
    )


@query
def replica_diff(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d)


@query
def replica_diff_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The same report, rows compared only where sums over parts of the keys differ."""
    source, copy = _pair(spark, d)
    customers = fx.table(spark, d, "customer")
    kept = customers.filter(F.col("c_custkey") % 5 != 0)
    parts = [
        cmp.diff_by_parts(source, copy, ["o_orderkey"], _PAIR_COLUMNS).withColumn("tbl", F.lit("orders")),
        cmp.diff_by_parts(kept, customers, ["c_custkey"], ["c_name"]).withColumn("tbl", F.lit("customer")),
    ]
    return ch.union_tables(parts)


@query
def rows_wrong(spark: SparkSession, d: str) -> DataFrame:
    return cmp.rows_wrong(_report(spark, d))


@query
def wrong_by_method(spark: SparkSession, d: str) -> DataFrame:
    report = _report(spark, d).withColumn(
        "method", F.when(F.col("tbl") == "orders", "first").otherwise("second")
    )
    return cmp.wrong_by_method(report.unionByName(report.withColumn("method", F.lit("both"))))


@query
def wrong_rows(spark: SparkSession, d: str) -> DataFrame:
    source, copy = _pair(spark, d)
    compared = cmp.compare_rows(source, copy, ["o_orderkey"], ["o_orderkey", *_PAIR_COLUMNS])
    return compared.filter(F.col("verdict").isNotNull()).select("o_orderkey", "verdict")


@query
def row_difference(spark: SparkSession, d: str) -> DataFrame:
    source, copy = _pair(spark, d)
    return cmp.row_difference(source, copy, ["o_orderkey", *_PAIR_COLUMNS])


@query
def row_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "note"]
    rows = fx.table(spark, d, "orders").withColumn(
        "note", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus"))
    )
    return doc.with_fingerprint(rows, "o_orderkey", columns)


# ---- replay, audit, scores -------------------------------------------------------------


@query
def captured_changes(spark: SparkSession, d: str) -> DataFrame:
    captured = replay.capture_by_method(_log(spark, d), COLUMNS)
    return captured.select("method", "pk", "op", "ts", "seq", "poll_no")


@query
def replay_replicas(spark: SparkSession, d: str) -> DataFrame:
    captured = replay.capture_by_method(_log(spark, d), COLUMNS)
    return replay.replicas(captured, COLUMNS).drop("tbl")


@query
def replay_histories(spark: SparkSession, d: str) -> DataFrame:
    captured = replay.capture_by_method(_log(spark, d), COLUMNS)
    return replay.histories(captured).drop("tbl")


@query
def replay_four_policies(spark: SparkSession, d: str) -> DataFrame:
    return replay.score_methods(_log(spark, d), COLUMNS)


SNAPSHOT_POLL = 3


def _two_tables(log: DataFrame) -> DataFrame:
    return log.withColumn("tbl", F.when(F.col("pk") % 2 == 0, "users").otherwise("visits"))


def _snapshot(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two tables as they were at a poll, and the log before and after it."""
    log = _two_tables(_log(spark, d))
    before = cap.visible(log, SNAPSHOT_POLL)
    initial = materialize(replay.latest_images(before, replay.KEYS, IMAGE), "initial")
    return initial, before, log.filter(F.col("poll_no") > SNAPSHOT_POLL)


@query
def replay_from_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """All methods from a copy of two tables on, with one mark for both."""
    initial, before, later = _snapshot(spark, d)
    starts = replay.starts_after(initial, before)
    return replay.score_tables(later, COLUMNS, initial=initial, starts=starts)


@query
def truth_after_snapshot(spark: SparkSession, d: str) -> DataFrame:
    initial, _, later = _snapshot(spark, d)
    return audit.truth_counts(later, initial=initial, late=F.col("commit_lsn") % 2 == 1)


@query
def capture_miss_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.capture_audit(_log(spark, d)).drop("tbl")


@query
def capture_miss_audit_split(spark: SparkSession, d: str) -> DataFrame:
    return audit.capture_audit(_log(spark, d, hot=True), hot_rows=HOT_ROWS).drop("tbl")


@query
def capture_scorecard(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit_counts(audit.capture_audit(_log(spark, d)))


@query
def truth_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.truth_counts(_log(spark, d), late=F.col("commit_lsn") % 2 == 1)


def _recorded(log: DataFrame) -> DataFrame:
    captured = replay.capture_by_method(log, COLUMNS)
    return replay.histories(captured).groupBy("method").agg(
        F.count(F.lit(1)).alias("recorded")
    )


@query
def history_completeness(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    true_rows = replay.true_history(log).agg(F.count(F.lit(1)).alias("true_periods"))
    return audit.history_completeness(_recorded(log), true_rows)


@query
def poll_statistics(spark: SparkSession, d: str) -> DataFrame:
    captured = replay.capture_by_method(_log(spark, d), COLUMNS)
    sizes = captured.groupBy("method", "poll_no").agg(F.count(F.lit(1)).alias("n_changes"))
    return audit.poll_statistics(sizes, by=["method"])


@query
def consumer_lag(spark: SparkSession, d: str) -> DataFrame:
    return audit.consumer_lag(_log(spark, d), LAG_POSITIONS)


@query
def lsn_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    wide = F.col("commit_lsn") * 1_000_003
    text = lsn.format_lsn(wide)
    return _log(spark, d).select(
        "seq",
        text.alias("lsn"),
        lsn.parse_lsn(text).alias("lsn_number"),
        lsn.lsn_distance(text, F.lit("0/FF")).alias("distance"),
    )


@query
def pg_epoch(spark: SparkSession, d: str) -> DataFrame:
    micros = F.col("event_id") * 86_400_000_123
    stamp = lsn.server_micros_to_timestamp(micros)
    return fx.table(spark, d, "events").select("event_id", F.unix_micros(stamp).alias("unix_us"))


# ---- messages --------------------------------------------------------------------------


@query
def pgoutput_decode(spark: SparkSession, d: str) -> DataFrame:
    return _decoded_columns(msg.decode_messages(_messages(_log(spark, d))))


@query
def pgoutput_decode_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The whole log as one poll, decoded by many tasks."""
    messages = _messages(_log(spark, d)).withColumn("batch_id", F.lit(0).cast("bigint"))
    return _decoded_columns(ranges.decode_ranges(messages, ranges=16))


def _decoded_columns(decoded: DataFrame) -> DataFrame:
    new, old = F.col("new"), F.col("old")
    key = F.coalesce(F.try_element_at(new, F.lit("pk")), F.try_element_at(old, F.lit("pk")))
    return decoded.select(
        "batch_id",
        "xid",
        "commit_lsn",
        F.col("commit_ts").cast("timestamp_ntz").alias("commit_ts"),
        "tbl",
        "op",
        key.cast("bigint").alias("pk"),
        F.try_element_at(new, F.lit("status")).alias("status"),
        F.try_element_at(new, F.lit("amount_cents")).cast("bigint").alias("amount_cents"),
        F.when(F.map_contains_key(new, "amount_cents"), 1).otherwise(0).alias("amount_sent"),
        F.try_element_at(new, F.lit("updated_at")).cast("timestamp_ntz").alias("updated_at"),
        F.try_element_at(old, F.lit("pk")).cast("bigint").alias("old_pk"),
    )


@query
def decoded_transactions(spark: SparkSession, d: str) -> DataFrame:
    decoded = msg.decode_messages(_messages(_log(spark, d)))
    return msg.transactions(decoded).drop("commit_ts")


@query
def messages_to_replica(spark: SparkSession, d: str) -> DataFrame:
    """Bytes to rows: decode, restore unsent values, apply."""
    decoded = msg.decode_messages(_messages(_log(spark, d)))
    changes = msg.fill_unsent(msg.decoded_changes(decoded, USERS), "pk", ["amount_cents"])
    return up.net_rows(up.net_changes(changes, ["pk"], COLUMNS), ["pk"], IMAGE)


def _unlisted_commit(messages: DataFrame) -> DataFrame:
    """One more poll of one transaction that changes nothing: Begin and Commit at a position of their own."""
    last = messages.agg((F.max("batch_id") + 1).alias("batch_id"), (F.floor(F.max("msg_no") / 16) + 1).alias("at"))
    place, at = F.col("at") * 16, F.col("at")
    begin = F.concat(F.lit("B").cast("binary"), fx.int_bytes(at, 8), fx.int_bytes(0, 8), fx.int_bytes(1, 4))
    commit = F.concat(F.lit("C").cast("binary"), fx.int_bytes(0, 1), fx.int_bytes(at, 8), fx.int_bytes(at + 1, 8), fx.int_bytes(0, 8))
    both = F.array(F.struct(place.alias("msg_no"), begin.alias("data")), F.struct((place + 15).alias("msg_no"), commit.alias("data")))
    return last.select("batch_id", lsn.format_lsn("at").alias("lsn"), F.inline(both)).select(*messages.columns)


@query
def message_sync(spark: SparkSession, d: str) -> DataFrame:
    """The same rows by the reading method: polled into a store at a few positions, values restored from it.

    The last transaction has no captured change; the position, the row with key NULL, moves past it all the same.
    """
    log = _log(spark, d)
    store = Store(spark, _new_folder(spark, "messages"), [USERS])
    messages = _messages(log)
    messages = messages.unionByName(_unlisted_commit(messages))
    for poll in SYNC_POLLS:
        landed = messages.filter(F.col("batch_id") <= poll)
        sync.sync_once(store, cap.METHODS["messages"](), cap.Source({"users": USERS}, log=landed))
    saved = store.consumers().select(
        F.lit(None).cast("bigint").alias("pk"), F.col("position").alias("status"),
        F.lit(None).cast("bigint").alias("amount_cents"), F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )
    return store.table("users").select("pk", *IMAGE).unionByName(saved)


@query
def message_source_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same rows by a stream over the messages' own source, offsets being commit positions; two runs."""
    folder, messages = _new_folder(spark, "source"), _messages(_log(spark, d))
    store = Store(spark, f"{folder}/store", [USERS])
    landed_source.register(spark)

    def changes(batch: DataFrame) -> dict[str, DataFrame]:
        typed = materialize(msg.decoded_changes(msg.decode_messages(batch), USERS), "decoded")
        return {"users": msg.restored(typed, USERS, store.table("users"))}

    for poll in SYNC_POLLS[1:]:
        landed_source.land_polls(messages.filter(F.col("batch_id") <= poll), f"{folder}/messages")
        stream = spark.readStream.format(landed_source.FORMAT).load(f"{folder}/messages")
        newest = lsn.format_lsn(F.max(lsn.parse_lsn("lsn")))
        sync.catch_up(sync.start_sync(stream, store, "messages", changes, newest, f"{folder}/checkpoint"))
    saved = store.consumers().select(
        F.lit(None).cast("bigint").alias("pk"), F.col("position").alias("status"),
        F.lit(None).cast("bigint").alias("amount_cents"), F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )
    return store.table("users").select("pk", *IMAGE).unionByName(saved)


@query
def message_poll(spark: SparkSession, d: str) -> DataFrame:
    """Messages visible at a poll, read above the position the poll before ended with."""
    log = _log(spark, d)
    done = cap.visible(log, POLL - 1).agg(F.max("commit_lsn").alias("m")).first().m
    messages = _messages(cap.visible(log, POLL))
    changes, _ = msg.poll_messages(messages, [USERS], lsn.format_lsn_text(done))
    return changes["users"].drop("tbl", "sent", "ts", POS_LO)


@query
def message_position(spark: SparkSession, d: str) -> DataFrame:
    return msg.poll_messages(_messages(_log(spark, d)), [USERS], "0/0")[1]


# ---- store and stream --------------------------------------------------------------------


@query
def full_reload_counts(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, _new_folder(spark, "reload"), [STORED_ORDERS, STORED_CUSTOMERS])
    loaded_at = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    store.full_reload(
        {
            "orders": fx.table(spark, d, "orders"),
            "customer": declared_columns(fx.table(spark, d, "customer"), STORED_CUSTOMERS, loaded_at),
        }
    )
    return ch.union_tables(
        [
            store.table(n).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("tbl", F.lit(n))
            for n in ("orders", "customer")
        ]
    )


def _streamed_store(spark: SparkSession, d: str) -> Store:
    """Land the log in three steps and let the stream catch up after each."""
    folder = _new_folder(spark, "stream")
    store = Store(spark, f"{folder}/store", [USERS])
    log = _log(spark, d)
    schema = log.schema
    for low, high in ((0, 3), (3, 7), (7, 1 << 62)):
        part = log.filter((F.col("poll_no") >= low) & (F.col("poll_no") < high))
        part.write.mode("append").parquet(f"{folder}/landed")
        sync.catch_up(
            sync.start_sync(
                sync.landed_log(spark, f"{folder}/landed", schema),
                store,
                "queue",
                lambda batch: {"users": _queue_changes(batch)},
                sync.max_sequence(),
                f"{folder}/checkpoint",
            )
        )
    return store


@query
def stream_apply(spark: SparkSession, d: str) -> DataFrame:
    """Replica and history of a streamed log, in one result."""
    store = _streamed_store(spark, d)
    rows = store.table("users").select(
        F.lit("row").alias("kind"), "pk", "status", "amount_cents",
        F.col("updated_at").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"),
    )
    periods = store.history("users").select(
        F.lit("period").alias("kind"), "pk", "status", F.lit(None).cast("bigint").alias("amount_cents"),
        "valid_from", "valid_to",
    )
    return rows.unionByName(periods)


LAG_CHUNKS = ((-1, 3), (3, 7), (7, 1 << 62))


@query
def stream_lag(spark: SparkSession, d: str) -> DataFrame:
    """A running sync's lag after each of its batches, noted while it ran."""
    folder, log = _new_folder(spark, "lag"), _log(spark, d)
    for low, high in LAG_CHUNKS:
        part = log.filter((F.col("poll_no") > low) & (F.col("poll_no") <= high))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/landed")
    store = Store(spark, f"{folder}/store", [USERS])
    notes = lag.LagNotes(spark, store.root, "reader")
    stream = sync.landed_log(spark, f"{folder}/landed", log.schema, files_per_batch=1)
    spark.streams.addListener(notes)
    try:
        sync.catch_up(
            sync.start_sync(
                lag.observed(stream, F.max("commit_lsn")), store, "reader",
                lambda batch: {"users": _commit_changes(batch)}, F.max("commit_lsn"), f"{folder}/checkpoint",
            )
        )
        lag.settled(notes, len(LAG_CHUNKS))
    finally:
        spark.streams.removeListener(notes)
    return lag.lag_by_batch(spark, store.root, "reader", spark.read.schema(log.schema).parquet(f"{folder}/landed"))


@query
def redelivered_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of a stream given to the store again, as after a crash: a batch number counts once."""
    store, changes = Store(spark, _new_folder(spark, "again"), [USERS]), _queue_changes(_log(spark, d))
    low = -1
    for number, high in enumerate((3, 7, 1 << 62)):
        batch = materialize(changes.filter((F.col(POS_HI) > low) & (F.col(POS_HI) <= high)), "batch")
        for again in range(2):
            applied = store.apply({"users": batch}, "reader", str(number), number)
            assert applied == (again == 0)
        low = high
    return store.history("users")


@query
def stateful_history(spark: SparkSession, d: str) -> DataFrame:
    """The history of a streamed log from the copy on, open periods in the state store, over restarts of the stream."""
    folder = _new_folder(spark, "stateful")
    log = _log(spark, d)
    before = cap.visible(log, SNAPSHOT_POLL)
    initial = replay.latest_images(before, ["pk"], IMAGE).withColumnRenamed("updated_at", "valid_from")
    initial = materialize(initial, "initial")
    spark.conf.set(*stateful.PROVIDER)
    for low, high in ((SNAPSHOT_POLL, 7), (7, 1 << 62)):
        part = log.filter((F.col("poll_no") > low) & (F.col("poll_no") <= high))
        part.write.mode("append").parquet(f"{folder}/landed")
        changes = _queue_changes(sync.landed_log(spark, f"{folder}/landed", log.schema))
        ended = stateful.closed_periods(changes, "pk", initial=initial)
        sync.catch_up(stateful.start_history(ended, f"{folder}/closed", f"{folder}/checkpoint"))
    return stateful.history(spark, f"{folder}/closed", f"{folder}/checkpoint", "pk", "timestamp_ntz")


VISITS = replace(USERS, name="visits")


def _synced(spark: SparkSession, d: str, method: str) -> DataFrame:
    """Two tables polled into a store by one reader, the last poll twice: rows, periods and position."""
    log = _two_tables(_log(spark, d))
    store = Store(spark, _new_folder(spark, f"sync-{method}"), list(SPECS.values()))
    for poll in (*SYNC_POLLS, SYNC_POLLS[-1]):
        sync.sync_once(store, cap.METHODS[method](), _source_at(log, poll))
    return _contents(store)


SPECS = {"users": USERS, "visits": VISITS}


def _source_at(log: DataFrame, poll: int) -> cap.Source:
    """What a reader sees at a poll: the two tables as they are, and the visible log with documents."""
    seen = cap.visible(log, poll)
    rows = replay.latest_images(seen, replay.KEYS, IMAGE)
    tables = {n: rows.filter(F.col("tbl") == n).drop("tbl") for n in SPECS}
    document = F.when(F.col("op") != "D", doc.row_document(["pk", *IMAGE]))
    return cap.Source(SPECS, tables, seen.withColumn("row_data", document))


def _contents(store: Store) -> DataFrame:
    """Rows, periods and positions of a store in one result."""
    parts = []
    nothing = {"bigint": F.lit(None).cast("bigint"), "time": F.lit(None).cast("timestamp_ntz")}
    for name in SPECS:
        parts += [
            store.table(name).select(
                F.lit("row").alias("kind"), F.lit(name).alias("tbl"), "pk", "status", "amount_cents",
                F.col("updated_at").alias("valid_from"), nothing["time"].alias("valid_to"),
            ),
            store.history(name).select(
                F.lit("period").alias("kind"), F.lit(name).alias("tbl"), "pk", "status",
                nothing["bigint"].alias("amount_cents"), "valid_from", "valid_to",
            ),
        ]
    saved = store.consumers().select(
        F.lit("position").alias("kind"), F.col("consumer").alias("tbl"), nothing["bigint"].alias("pk"),
        F.col("position").alias("status"), nothing["bigint"].alias("amount_cents"),
        nothing["time"].alias("valid_from"), nothing["time"].alias("valid_to"),
    )
    return ch.union_tables([*parts, saved])


@query
def sync_queue_store(spark: SparkSession, d: str) -> DataFrame:
    return _synced(spark, d, "queue")


@query
def sync_commit_order_store(spark: SparkSession, d: str) -> DataFrame:
    return _synced(spark, d, "commit_order")


@query
def sync_high_watermark_store(spark: SparkSession, d: str) -> DataFrame:
    return _synced(spark, d, "high_watermark")


@query
def sync_sequence_store(spark: SparkSession, d: str) -> DataFrame:
    return _synced(spark, d, "sequence")


def _synced_from_snapshot(spark: SparkSession, d: str, folder: str) -> Store:
    """A store of many buckets that begins with a copy, is synced twice and compacted in between."""
    initial, before, _ = _snapshot(spark, d)
    store = Store(spark, _new_folder(spark, folder), list(SPECS.values()), buckets=24)
    start = before.agg(lsn.format_lsn(F.max("commit_lsn")).alias("p")).first()["p"]
    tables = {n: initial.filter(F.col("tbl") == n).drop("tbl") for n in SPECS}
    store.bootstrap(tables, {"commit_order": start})
    log = _two_tables(_log(spark, d))
    for poll in SYNC_POLLS[1:]:
        sync.sync_once(store, cap.METHODS["commit_order"](), _source_at(log, poll))
        if poll == SYNC_POLLS[1]:
            store.compact()
    return store


@query
def bucketed_sync(spark: SparkSession, d: str) -> DataFrame:
    return _contents(_synced_from_snapshot(spark, d, "bucketed"))


@query
def changes_of_versions(spark: SparkSession, d: str) -> DataFrame:
    """What changed since the copy, from the nets of the syncs and over a compaction."""
    store = _synced_from_snapshot(spark, d, "versions")
    last = store.versions()[-1]
    parts = [store.changes_of_versions(n, 1, last).withColumn("tbl", F.lit(n)) for n in SPECS]
    return ch.union_tables(parts)


@query
def report_as_json(spark: SparkSession, d: str) -> DataFrame:
    """A report written as JSON lines and read back."""
    path = _new_folder(spark, "report")
    report = replay.positions_by_poll(_log(spark, d))
    sync.write_result(report, path)
    return spark.read.schema(report.schema).json(path)


# ---- checks ------------------------------------------------------------------------------


@query
def key_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return qc.duplicate_keys(fx.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def open_period_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    """Two histories of the same keys laid over each other: every common open key shows."""
    periods = scd2_history(spark, d)
    early, _ = _split_log(spark, d)
    other = hist.status_periods(early, ["pk"]).drop("seeded")
    return qc.duplicate_open_periods(periods.unionByName(other), ["pk"])


@query
def null_check(spark: SparkSession, d: str) -> DataFrame:
    return qc.null_counts(_log(spark, d), ["seq", "pk", "status", "amount_cents", "updated_at"])


