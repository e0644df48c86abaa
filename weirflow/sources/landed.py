"""Landed replication messages as a data source of their own, in batch and as a stream.

    <path>/poll=<batch_id>/part-*.parquet   the messages of one poll
    <path>/_polls/<lsn>-<batch_id>          says that the poll is whole, and its last commit
    <path>/_acknowledged/<lsn>              says that a reader is past a commit

Offsets of the stream are commit positions, partitions are whole polls, and a poll is there when its mark is,
so a reader sees whole transactions however the writer died. Spark's commit of an offset becomes the
acknowledgement, which lets the writer drop polls (``drop_acknowledged``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from weirflow.functions.positions import parse_lsn
from weirflow.model import MESSAGE_SCHEMA

# The source travels with the job: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "landed_messages"
_POLLS, _ACKNOWLEDGED = "_polls", "_acknowledged"
_COLUMNS = MESSAGE_SCHEMA.names


@dataclass
class Poll(InputPartition):
    """One poll: everything a task has to know to read it."""

    lsn: int
    batch_id: int


class _Folder:
    """The marks and polls of a folder; every file system that pyarrow opens by its address will do."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _open(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def marks(self, name: str) -> list[str]:
        system, root = self._open()
        found = system.get_file_info(fs.FileSelector(f"{root}/{name}", allow_not_found=True))
        return [f.base_name for f in found if f.type == fs.FileType.File]

    def mark(self, folder: str, name: str) -> None:
        system, root = self._open()
        system.create_dir(f"{root}/{folder}", recursive=True)
        with system.open_output_stream(f"{root}/{folder}/{name}") as out:
            out.write(b"1")

    def polls(self, above: int = -1, upto: int | None = None) -> list[Poll]:
        """Whole polls in commit order, those behind a position and up to another."""
        read = (name.split("-") for name in self.marks(_POLLS))
        found = sorted((int(lsn, 16), int(batch)) for lsn, batch in read)
        return [Poll(lsn, batch) for lsn, batch in found if lsn > above and (upto is None or lsn <= upto)]

    def acknowledged(self) -> int:
        return max((int(n, 16) for n in self.marks(_ACKNOWLEDGED)), default=0)

    def read(self, poll: Poll) -> Iterator[pa.RecordBatch]:
        system, root = self._open()
        files = ds.dataset(f"{root}/poll={poll.batch_id}", filesystem=system, format="parquet")
        yield from files.to_batches(columns=_COLUMNS, batch_size=4096)

    def drop(self, poll: Poll) -> None:
        system, root = self._open()
        system.delete_file(f"{root}/{_POLLS}/{poll.lsn:016x}-{poll.batch_id}")
        system.delete_dir(f"{root}/poll={poll.batch_id}")


class _Batch(DataSourceReader):
    def __init__(self, folder: _Folder) -> None:
        self.folder = folder

    def partitions(self) -> Sequence[InputPartition]:
        return self.folder.polls()

    def read(self, partition: Poll) -> Iterator[pa.RecordBatch]:
        # A source without polls has one partition, None.
        yield from self.folder.read(partition) if partition else ()


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: _Folder) -> None:
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802
        return {"lsn": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"lsn": max((p.lsn for p in self.folder.polls()), default=self.folder.acknowledged())}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.folder.polls(start["lsn"], end["lsn"])

    def read(self, partition: Poll) -> Iterator[pa.RecordBatch]:
        yield from self.folder.read(partition) if partition else ()

    def commit(self, end: dict) -> None:
        if end["lsn"] > self.folder.acknowledged():
            self.folder.mark(_ACKNOWLEDGED, f"{end['lsn']:016x}")


class LandedMessages(DataSource):
    """``spark.read`` and ``spark.readStream`` of the format ``landed_messages``; load gives the folder."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return MESSAGE_SCHEMA

    def _folder(self) -> _Folder:
        return _Folder(self.options["path"].rstrip("/"))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self._folder())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self._folder())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedMessages)


def land_polls(messages: DataFrame, path: str) -> None:
    """Write polls that are not there yet, each with its mark last. One row per poll reaches the driver.

    Polls are landed in commit order by one writer; a poll that was landed before is left as it is.
    """
    folder = _Folder(path.rstrip("/"))
    there = {p.batch_id for p in folder.polls()}
    fresh = messages.where(~F.col("batch_id").isin(sorted(there))) if there else messages
    tops = fresh.groupBy("batch_id").agg(F.max(parse_lsn("lsn")).alias("lsn")).orderBy("lsn").collect()
    rows = fresh.select(*_COLUMNS, F.col("batch_id").alias("poll")).repartition("poll").sortWithinPartitions("poll", "msg_no")
    # Folders of polls whose writer died before the mark are written anew, not added to.
    conf = ("partitionOverwriteMode", "dynamic")
    rows.write.option(*conf).partitionBy("poll").mode("overwrite").parquet(path)
    for batch_id, lsn in tops:
        folder.mark(_POLLS, f"{lsn:016x}-{batch_id}")


def drop_acknowledged(path: str) -> int:
    """Delete polls every reader of the stream is past; returns how many."""
    folder = _Folder(path.rstrip("/"))
    past = folder.polls(upto=folder.acknowledged())
    for poll in past:
        folder.drop(poll)
    return len(past)
