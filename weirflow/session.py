"""Session settings and the few questions operators ask about a session."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Settings the operators rely on; pass them to a session builder or submit command.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

# A key group with more rows than this is split over several tasks.
HOT_ROWS_CONF = "spark.weirflow.hotGroupRows"
HOT_ROWS_DEFAULT = 2_000_000
# Inputs below this need no skew handling: one task could process all of them.
ONE_TASK_CONF = "spark.weirflow.oneTaskBytes"
ONE_TASK_DEFAULT = 64 << 20
# Most bytes a lookup side may have to be broadcast; beyond it the join shuffles.
LOOKUP_BYTES = 64 << 20

_local_folders: dict[str, str] = {}


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def hot_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


def input_bytes(df: DataFrame) -> int | None:
    """Sum of the optimizer's sizes of what a plan reads, or None where a session hides it.

    The inputs are summed, not the result estimated: that estimate multiplies the
    sides of every join, and the joins here look keys up, they do not multiply rows.
    """
    try:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        sizes = [leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size())]
    except AttributeError:
        return None
    return sum(int(str(size)) for size in sizes)


def fits_one_task(df: DataFrame) -> bool:
    size = input_bytes(df)
    limit = int(df.sparkSession.conf.get(ONE_TASK_CONF, str(ONE_TASK_DEFAULT)))
    return size is not None and size <= limit


def lookup_side(df: DataFrame, max_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """Mark a narrow lookup table for broadcast only after measuring it.

    Small inputs are left to the optimizer's size estimate. A table above
    ``max_bytes`` is returned as it is, so the join shuffles and the adaptive
    skew join takes care of hot keys.
    """
    if fits_one_task(df):
        return df
    lengths = [
        F.coalesce(F.octet_length(f.name), F.lit(0))
        for f in df.schema
        if isinstance(f.dataType, (T.StringType, T.BinaryType))
    ]
    row = reduce(lambda a, b: a + b, lengths, F.lit(16 * (len(df.columns) + 1)))
    size = df.agg(F.sum(row)).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach; a local session may fall back to /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="weirflow-")
    return _local_folders[app]


def _steps_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/weirflow/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own among this session's steps, for what a job writes besides them."""
    return f"{_steps_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop_steps(spark: SparkSession) -> None:
    """Delete what this session has written below ``new_folder`` and by ``materialize``; for when its results are saved."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_steps_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and go on from there.

    Used where a large input feeds several later steps: it ends the lineage (a
    lost executor re-reads, it does not recompute), keeps plans linear, and gives
    the optimizer the true size. The files stay until ``drop_steps``, as lazy results
    go on reading them.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
