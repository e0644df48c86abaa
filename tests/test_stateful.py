"""The stateful history against periods found at once: few buckets of many keys, deletes, a copy to start from, a restart."""

from pyspark.sql import functions as F

from weirflow.operators.history import status_periods
from weirflow.streaming import stateful, sync

SCHEMA = "pk bigint, op string, ts timestamp, status string, pos_hi bigint, pos_lo bigint"


def test_keys_share_buckets(spark, folder):
    home, moves = folder(), "aabcDbbaDDcabDa"
    n = F.col("id")
    # Null stands for a key too; the last rows of a key come first.
    key = F.when(n % 41 != 7, n % 41)
    state = F.substring(F.lit(moves), (n * 7 % len(moves) + 1).cast("int"), F.lit(1))
    rows = spark.range(800).orderBy(F.desc("id")).select(
        key.alias("pk"), F.when(state == "D", "D").otherwise("U").alias("op"), F.timestamp_seconds(n).alias("ts"),
        F.when(state != "D", state).alias("status"), (n % 5 + F.floor(n / 400) * 5).alias("pos_hi"), n.alias("pos_lo"),
    )
    initial = spark.range(50).selectExpr("id as pk", "'a' as status", "timestamp_seconds(-id) as valid_from")
    spark.conf.set(*stateful.PROVIDER)
    try:
        for low, high in ((0, 5), (5, 10)):
            rows.where((F.col("pos_hi") >= low) & (F.col("pos_hi") < high)).write.mode("append").parquet(f"{home}/landed")
            changes = sync.landed_log(spark, f"{home}/landed", rows.schema)
            ended = stateful.closed_periods(changes, "pk", initial=initial, buckets=3)
            sync.catch_up(stateful.start_history(ended, f"{home}/closed", f"{home}/checkpoint"))
        got = stateful.history(spark, f"{home}/closed", f"{home}/checkpoint", "pk")
        assert spark.read.format("statestore").option("stateVarName", "open").load(f"{home}/checkpoint").count() == 3
        expected = status_periods(rows, ["pk"], open_periods=initial).drop("seeded")
        as_text = lambda df: sorted(str(tuple(r)) for r in df.collect())
        assert as_text(got) == as_text(expected)
    finally:
        spark.conf.unset(stateful.PROVIDER[0])
