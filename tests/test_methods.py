"""The four reading methods: what each loses, as a set query and poll by poll into a store."""

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.spark_queries import COLUMNS, USERS
from weirflow.functions.documents import row_document
from weirflow.plans import replay
from weirflow.plans.audit import truth_counts
from weirflow.sources.capture import METHODS, Source, greatest_version, visible
from weirflow.streaming.store import Store
from weirflow.streaming.sync import sync_once, write_result

IMAGE = [*COLUMNS, "updated_at"]


@pytest.fixture(scope="module")
def log(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "log")
    fx.derive(spark, sf_dir, fx.LOG_SQL).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def scores(log):
    return {r.method: r for r in replay.score_methods(log, COLUMNS).collect()}


@pytest.mark.parametrize("method", ["queue", "commit_order"])
def test_replaying_every_entry_loses_nothing(scores, method):
    assert scores[method].rows_wrong == 0
    assert scores[method].periods == scores["commit_order"].periods == 655
    assert scores[method].changes_applied == 1000


def test_reading_tables_only_shows_no_deletes(scores):
    r = scores["high_watermark"]
    assert (r.changes_applied, r.missing, r.stale, r.ghost, r.periods) == (392, 0, 4, 16, 316)


def test_numbers_taken_before_commit_hide_late_ones(scores):
    r = scores["sequence"]
    assert (r.changes_applied, r.missing, r.stale, r.ghost, r.periods) == (960, 0, 4, 0, 631)


def test_numbers_suffice_when_commits_keep_their_order(log):
    on_time = log.filter(F.col("commit_lsn") % 2 == 0)
    r = replay.score_methods(on_time, COLUMNS, ["sequence"]).first()
    assert r.rows_wrong == 0
    assert r.periods == replay.true_history(on_time).count()


def test_a_rerun_gives_the_same(log, scores):
    again = {r.method: r for r in replay.score_methods(log, COLUMNS).collect()}
    assert again == scores


@pytest.mark.parametrize("method", replay.METHOD_NAMES)
def test_polling_into_a_store_equals_the_set_query(spark, log, folder, method):
    """A loop over polls, each seeing only what had committed, against rule and history."""
    documents = log.withColumn(
        "row_data", F.when(F.col("op") != "D", row_document(["pk", *IMAGE]))
    )
    store = Store(spark, folder(), [USERS])
    capture = METHODS[method]()
    last = log.agg(F.max("poll_no")).first()[0]
    polls = sorted({0, 1, 2, 4, 6, last})  # several log polls may go into one of ours
    for poll in polls:
        table = replay.latest_images(visible(log, poll), ["pk"], IMAGE)
        source = Source({"users": USERS}, {"users": table}, visible(documents, poll))
        capture.install(source)
        sync_once(store, capture, source)
    remapped = log.withColumn(
        "poll_no",
        F.coalesce(*[F.when(F.col("poll_no") <= p, F.lit(p).cast("bigint")) for p in polls]),
    )
    captured = replay.capture_by_method(remapped, COLUMNS, [method])
    rows = replay.replicas(captured, COLUMNS).select("pk", *IMAGE)
    assert store.table("users").select("pk", *IMAGE).exceptAll(rows).count() == 0
    assert store.table("users").count() == rows.count()
    periods = replay.histories(captured).select("pk", "status", "valid_from", "valid_to")
    got = store.history("users")
    assert got.count() == periods.count()
    assert got.exceptAll(periods).count() == 0


def test_start_of_an_empty_source_reads_everything(spark):
    empty = spark.createDataFrame([], "pk bigint, status string, amount_cents bigint, updated_at timestamp_ntz")
    source = Source({"users": USERS}, {"users": empty})
    capture = METHODS["high_watermark"]()
    assert capture.start(source) is None
    assert greatest_version([empty]).first()[0] is None
    poll = capture.poll(source, None)
    assert poll.changes.count() == 0 and poll.position_text() is None


def test_truth_with_rows_before_the_log(spark, log):
    initial = spark.createDataFrame(
        [("users", k, "view") for k in range(5)], "tbl string, pk bigint, status string"
    ).withColumn("valid_from", F.lit("2020-01-01").cast("timestamp_ntz"))
    alone, seeded = truth_counts(log).first(), truth_counts(log, initial=initial).first()
    assert alone.status_periods == alone.inserted + alone.transitions == 655
    assert seeded.status_periods == 5 + seeded.inserted + seeded.transitions


def test_report_as_json(spark, log, folder):
    path = folder()
    write_result(replay.positions_by_poll(log), path)
    assert spark.read.json(path).count() == replay.positions_by_poll(log).count()
