"""Change logs, table pairs and messages derived from the driver tables.

Each text is valid in Spark SQL and in DuckDB, so both sides start from the same
rows. ``{events}`` and the like name the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions.positions import format_lsn
from weirflow.session import lookup_side

_LOG = """
select event_id as seq, txid, 'users' as tbl,
       case when event_type = 'error' then 'D' when event_type = 'signup' then 'I' else 'U' end as op,
       {key} as pk,
       case when event_type = 'error' then null else event_type end as status,
       case when event_type = 'error' then null else cast(round(value * 100) as bigint) end as amount_cents,
       min(ts) over (partition by txid) as updated_at,
       ts as changed_at,
       (txid * 10 + 9 + late * p) * 2 + late as commit_lsn,
       cast(floor((txid * 10 + 9 + late * p) / (p * 1.0)) as bigint) as poll_no
from (
  select e.*, case when txid % 25 = 7 then 1 else 0 end as late
  from (
    select event_id, ts, user_id, event_type, value,
           cast(floor(event_id / 10.0) as bigint) as txid,
           greatest(cast(floor((select count(*) from {events}) / 10.0) as bigint), 1) as p
    from {events}
  ) e
) t
"""
# A change log with late transactions; a key is quiet while its late transaction is open.
LOG_SQL = _LOG.replace("{key}", "cast(floor(event_id / 2.0) as bigint) % p")
# The same log with few, busy keys that late transactions share with others.
HOT_LOG_SQL = _LOG.replace("{key}", "user_id")

# Upserts and deletes against orders(pk, status, updated_at).
UPSERTS_SQL = """
select l_orderkey as pk, cast(l_linenumber as bigint) as pos,
       max(concat(l_linestatus, l_returnflag)) as status, max(l_shipdate) as updated_at,
       case when count(*) >= 3 then 'D' else 'U' end as op
from {lineitem} group by l_orderkey, l_linenumber
"""
STORED_SQL = "select o_orderkey as pk, o_orderstatus as status, o_orderdate as updated_at from {orders}"

# A source and its diverged copy.
SOURCE_SQL = """
select o_orderkey, o_custkey, o_orderstatus, o_orderdate from {orders} where o_orderkey % 17 <> 0
"""
COPY_SQL = """
select o_orderkey, o_custkey, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as o_orderstatus,
       o_orderdate
from {orders} where o_orderkey % 13 <> 0
"""

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a fixture text over the driver tables it names."""
    used = [t for t in TABLES if "{" + t + "}" in text]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def in_sql(text: str) -> str:
    """The same text for an engine that has the tables as views."""
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text.strip()


# ---- encoded replication messages ---------------------------------------------------

SCHEMA_NAME, RELATION_ID = "shop", 16400


def int_bytes(value, size: int):
    """Big-endian two's complement of ``size`` bytes."""
    col = value if not isinstance(value, int) else F.lit(value)
    digits = F.right(F.lpad(F.hex(col.cast("bigint")), 16, "0"), F.lit(size * 2))
    return F.unhex(digits)


def _bytes(text: str):
    return F.lit(text).cast("binary")


def _value(col):
    raw = col.cast("string").cast("binary")
    sent = F.concat(_bytes("t"), int_bytes(F.length(raw), 4), raw)
    return F.when(col.isNull(), _bytes("n")).otherwise(sent)


def message_table(log: DataFrame) -> DataFrame:
    """The log as protocol messages: ``batch_id, msg_no, lsn, data``.

    Message numbers come from the commit position, so no numbering pass is
    needed: Begin at 0, Relation at 1, rows from 2, Commit at 15 of 16 places.
    """
    count = int_bytes(4, 2)
    nothing = F.concat(_bytes("n"), _bytes("n"), _bytes("n"))
    key_only = F.concat(_bytes("K"), count, _value(F.col("pk")), nothing)
    updated = F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    unsent = (F.col("op") == "U") & (F.col("seq") % 11 == 0)
    amount = F.when(unsent, _bytes("u")).otherwise(_value(F.col("amount_cents")))
    image = F.concat(
        _bytes("N"), count, _value(F.col("pk")), _value(F.col("status")), amount, _value(updated)
    )
    rel = int_bytes(RELATION_ID, 4)
    with_old = (F.col("op") == "U") & (F.col("seq") % 5 == 0)
    body = (
        F.when(F.col("op") == "D", F.concat(_bytes("D"), rel, key_only))
        .when(with_old, F.concat(_bytes("U"), rel, key_only, image))
        .otherwise(F.concat(F.col("op").cast("binary"), rel, image))
    )
    place = F.col("commit_lsn") * 16
    rows = log.select(
        F.col("poll_no").alias("batch_id"),
        (place + 2 + F.col("seq") % 10).alias("msg_no"),
        "commit_lsn",
        body.alias("data"),
    )
    server_us = F.unix_micros(F.col("commit_ts").cast("timestamp")) - 946_684_800_000_000
    tx = log.groupBy("poll_no", "txid", "commit_lsn").agg(F.max("changed_at").alias("commit_ts"))
    opening = lookup_side(log.groupBy("poll_no").agg(F.min("commit_lsn").alias("opening_lsn")))
    first = F.col("commit_lsn") == F.col("opening_lsn")
    column = lambda flag, name, oid: F.concat(
        int_bytes(flag, 1), _bytes(name + "\0"), int_bytes(oid, 4), int_bytes(-1, 4)
    )
    relation = F.concat(
        _bytes("R"), rel, _bytes(f"{SCHEMA_NAME}\0users\0d"), count,
        column(1, "pk", 20), column(0, "status", 25),
        column(0, "amount_cents", 20), column(0, "updated_at", 1114),
    )
    begin = F.concat(_bytes("B"), int_bytes(F.col("commit_lsn"), 8), int_bytes(server_us, 8), int_bytes(F.col("txid"), 4))
    commit = F.concat(
        _bytes("C"), int_bytes(0, 1), int_bytes(F.col("commit_lsn"), 8),
        int_bytes(F.col("commit_lsn") + 1, 8), int_bytes(server_us, 8),
    )
    frames = tx.join(opening, "poll_no").select("*", first.alias("first")).select(
        F.col("poll_no").alias("batch_id"),
        "commit_lsn",
        F.inline(
            F.array_compact(
                F.array(
                    F.struct(place.alias("msg_no"), begin.alias("data")),
                    F.when(
                        F.col("first"), F.struct((place + 1).alias("msg_no"), relation.alias("data"))
                    ),
                    F.struct((place + 15).alias("msg_no"), commit.alias("data")),
                )
            )
        ),
    )
    return rows.unionByName(frames).select(
        "batch_id", "msg_no", format_lsn("commit_lsn").alias("lsn"), "data"
    )
