"""Time the headline queries and one sync cycle per reading method; prints one JSON line.

BENCH_SF_DIR  input folder   (default /root/testdata/sf0.1)
BENCH_CPUS    local threads  (default 8)
BENCH_QUERIES comma-separated names, or "all"
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.spark_queries import COLUMNS, QUERIES, USERS
from weirflow.functions.documents import row_document
from weirflow.plans.replay import METHOD_NAMES, latest_images
from weirflow.session import build_session, drop_steps, shared_folder
from weirflow.sources.capture import METHODS, Source, visible
from weirflow.streaming.store import Store
from weirflow.streaming.sync import sync_once

HEADLINE = (
    "scd2_history",
    "scd2_history_busy_keys",
    "apply_batch",
    "fold_batches",
    "changelog_from_snapshots",
    "replica_diff",
    "high_watermark_poll",
    "next_position_by_poll",
    "captured_changes",
    "replay_four_policies",
    "capture_scorecard",
    "truth_counts",
    "pgoutput_decode",
    "messages_to_replica",
    "stream_apply",
)
CYCLES = (5, 6, 7, 8)  # polls synced one by one; everything before is in the first copy


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 4)


def sync_cycles(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Median seconds of one sync cycle per method, and of one full reload."""
    folder = f"{shared_folder(spark)}/bench-{uuid.uuid4().hex[:12]}"
    names = ["pk", *COLUMNS, "updated_at"]
    log = fx.derive(spark, sf_dir, fx.LOG_SQL)
    landed = log.withColumn("row_data", F.when(F.col("op") != "D", row_document(names)))
    landed.write.partitionBy("poll_no").parquet(f"{folder}/log")
    landed = spark.read.parquet(f"{folder}/log")

    def table_at(poll: int) -> DataFrame:
        return latest_images(visible(landed, poll), ["tbl", "pk"], [*COLUMNS, "updated_at"]).drop("tbl")

    for poll in (CYCLES[0] - 1, *CYCLES):
        table_at(poll).write.parquet(f"{folder}/table/{poll}")
    tables = {p: spark.read.parquet(f"{folder}/table/{p}") for p in (CYCLES[0] - 1, *CYCLES)}
    seconds: dict[str, float] = {}
    for name in METHOD_NAMES:
        capture = METHODS[name]()
        before = CYCLES[0] - 1
        store = Store(spark, f"{folder}/store-{name}", [USERS])
        done = visible(landed, before)
        start = {
            "high_watermark": lambda: capture.start(Source({"users": USERS}, {"users": tables[before]})),
            "sequence": lambda: str(done.agg(F.max("seq")).first()[0]),
            "queue": lambda: "0",
            "commit_order": lambda: None,
        }[name]()
        if name == "commit_order":
            start = capture.poll(Source({"users": USERS}, log=done), "0/0").position_text()
        taken = {name: done.select("seq")} if name == "queue" else {}
        store.bootstrap({"users": tables[before]}, {name: start}, taken)
        cycle_times = []
        for poll in CYCLES:
            source = Source({"users": USERS}, {"users": tables[poll]}, visible(landed, poll))
            cycle_times.append(timed(lambda s=source: sync_once(store, capture, s)))
        seconds[f"sync_{name}"] = round(statistics.median(cycle_times), 4)
    store = Store(spark, f"{folder}/store-reload", [USERS])
    last = tables[CYCLES[-1]]
    seconds["full_reload"] = statistics.median(
        [timed(lambda: store.full_reload({"users": last})) for _ in range(3)]
    )
    return seconds


# Changes per cycle against stored tables of different size (orders and lineitem of the input).
CHANGES = (2_000, 20_000)


def sync_growth(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Seconds of one sync and of a full reload, by stored rows and changes; all inputs are written before."""
    folder = f"{shared_folder(spark)}/bench-{uuid.uuid4().hex[:12]}"
    lines = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    tables = {
        "orders": fx.table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("pk"), F.col("o_orderstatus").alias("status"),
            F.col("o_orderdate").alias("updated_at"),
        ),
        "lineitem": fx.table(spark, sf_dir, "lineitem").select(
            lines.cast("bigint").alias("pk"), F.col("l_linestatus").alias("status"),
            F.col("l_shipdate").alias("updated_at"),
        ),
    }
    seconds: dict[str, float] = {}
    for name, rows in tables.items():
        spec = replace(USERS, name=name, columns=(("pk", "bigint"), ("status", "string")))
        rows = rows.dropDuplicates(["pk"])
        store = Store(spark, f"{folder}/{name}", [spec])
        stored = store.bootstrap({name: rows}, {"sequence": "0"})[name]
        seconds[f"reload_{stored}"] = timed(lambda: store.full_reload({name: store.table(name)}))
        done = 0
        for n in CHANGES:
            later = F.col("updated_at") + F.expr("interval 1 day")
            image = rows.withColumn("status", F.lit("changed")).withColumn("updated_at", later)
            log = image.orderBy(F.xxhash64("pk", F.lit(n))).limit(n).select(
                F.lit(name).alias("tbl"), F.lit("U").alias("op"), "pk",
                (F.monotonically_increasing_id() + done + 1).alias("seq"),
                row_document(["pk", "status", "updated_at"]).alias("row_data"), later.alias("changed_at"),
            )
            log.write.parquet(f"{folder}/{name}-log-{n}")
            log = spark.read.parquet(f"{folder}/{name}-log-{n}")
            done = log.agg(F.max("seq")).first()[0]
            source = Source({name: spec}, log=log)
            seconds[f"sync_{n}_into_{stored}"] = timed(lambda s=source: sync_once(store, METHODS["sequence"](), s))
    return seconds


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    consume(QUERIES["scd2_history"](spark, sf_dir))  # warm the JVM
    seconds = {}
    for name in names:  # the better of two runs: the first one compiles
        run = lambda n=name: consume(QUERIES[n](spark, sf_dir))
        seconds[name] = min(timed(run), timed(run))
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    if not wanted:
        seconds |= sync_cycles(spark, sf_dir)
    growth = sync_growth(spark, sf_dir) if not wanted else {}
    rows = fx.table(spark, sf_dir, "lineitem").count()
    drop_steps(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "growth": growth,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "lineitem_rows": rows,
            }
        )
    )


if __name__ == "__main__":
    main()
