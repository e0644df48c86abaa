"""A versioned store on a shared file system: data and consumer position in one commit.

    <root>/_manifest/<n>.json                                     what version n consists of
    <root>/<table>/batch_no=<n>/attempt=<id>/bucket=<b>/          base rows or one batch's net rows
    <root>/<history>/batch_no=<n>/attempt=<id>/kind=/bucket=<b>/  what a batch says about periods
    <root>/<consumer>_taken/batch_no=<n>/attempt=<id>/            runs of numbers a queue reader took
    <root>/_landed/<id>/                                          a batch while it is applied

All rows lie in buckets by a hash of their key, and a manifest says which buckets a part has. A batch writes
only its own net rows and reads only its buckets of the open periods; the stored table is the base with the
nets since folded in, and ``compact`` turns that into new base rows of the buckets that have nets. A version
exists when its manifest does: the manifest is renamed into place last, so
readers never see data without its position or the other way round. One writer
per store. Leftovers of a failed attempt are never listed, hence never read; ``expire`` deletes them.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable, Collection, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack, contextmanager
from copy import deepcopy
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.model import TableSpec
from weirflow.operators.changes import changes_between
from weirflow.operators.history import SEEDED, bootstrap_periods, status_periods
from weirflow.operators.upsert import (
    LIVE,
    RESET,
    SMALL_NET_BYTES,
    fold_nets,
    merge_net,
    net_changes,
    net_rows,
)
from weirflow.session import fits_one_task, lookup_side
from weirflow.sources.runs import joined_runs

BATCH = "batch_no"
BUCKET = "bucket"
# Buckets of a new store. A batch touches at most one bucket a key, and writes a file for each it touches.
BUCKETS = 8
KIND, NOW, CLOSED = "kind", "now", "closed"
PARALLEL_WRITES = 4


class Files:
    """The few file-system calls a commit needs, on whatever the path points to."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._fs.getUri(), self._conf
        )

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(path)]

    def read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream).decode()
        finally:
            stream.close()

    def size(self, folders: Sequence[str]) -> int:
        """Bytes of all files below some folders."""
        return sum(self._fs.getContentSummary(self._path(f)).getLength() for f in folders)

    def remove(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)

    def publish_text(self, path: str, text: str) -> None:
        """Write aside, then rename; fails when the target exists."""
        aside = self._path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(aside, False)
        stream.write(text.encode())
        stream.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        # No option given means: never overwrite.
        none = self._jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 0)
        self._context.rename(aside, self._path(path), none)


@dataclass
class Landed:
    """A written copy of a batch, and what was counted while it was written."""

    rows: DataFrame
    facts: dict[str, Any]


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(buckets)).cast("int")


class Store:
    def __init__(
        self, spark: SparkSession, root: str, specs: Sequence[TableSpec], buckets: int = BUCKETS
    ) -> None:
        """``buckets`` counts for a new store; one that has a version keeps its own."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.specs = {s.name: s for s in specs}
        self.files = Files(spark, self.root)
        self.buckets = self.current().get("buckets") or buckets

    # ---- versions ------------------------------------------------------------

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/_manifest/{version}.json"

    def versions(self) -> list[int]:
        names = self.files.names(f"{self.root}/_manifest")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def current(self) -> dict:
        """The newest version's manifest."""
        numbers = self.versions()
        return self.at(numbers[-1]) if numbers else {"version": 0, "tables": {}, "history": {}, "consumers": {}}

    def at(self, version: int) -> dict:
        """The manifest of one version, to be given to the reading methods."""
        return json.loads(self.files.read_text(self._manifest_path(version)))

    def _publish(self, manifest: dict) -> None:
        text = json.dumps(manifest, indent=1, sort_keys=True)
        self.files.publish_text(self._manifest_path(manifest["version"]), text)

    def _next(self) -> dict:
        manifest = deepcopy(self.current())
        manifest["version"] += 1
        manifest["buckets"] = self.buckets
        return manifest

    # ---- files ---------------------------------------------------------------

    def _write(
        self, df: DataFrame, name: str, version: int, by: Sequence[str] = (), counted: str = "true"
    ) -> dict:
        """Write a new attempt folder; returns it as a part: path, rows, and the buckets that have any."""
        seen = Observation()
        path = f"{self.root}/{name}/{BATCH}={version}/attempt={uuid.uuid4().hex[:12]}"
        facts = [F.count_if(F.expr(counted)).alias("n")]
        if BUCKET in by:
            facts.append(F.collect_set(BUCKET).alias("buckets"))
        df.observe(seen, *facts).write.partitionBy(*by).parquet(path)
        found = seen.get
        return {"path": path, "batch": version, "rows": int(found.get("n") or 0), "buckets": sorted(found.get("buckets") or [])}

    @contextmanager
    def land(self, name: str, df: DataFrame, **facts: Column) -> Iterator[Landed]:
        """A written copy of a batch, there until the block ends: one read of a source that may grow.

        ``facts`` are aggregates over its rows, which are taken while they are written.
        """
        path = f"{self.root}/_landed/{name}-{uuid.uuid4().hex[:12]}"
        seen = Observation()
        counted = df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in facts.items()])
        counted.write.parquet(path)
        try:
            yield Landed(self.spark.read.schema(df.schema).parquet(path), dict(seen.get))
        finally:
            self.files.remove(path)

    def touched(self, spec: TableSpec, key: str | None = None, own: Column | None = None) -> Column:
        """An aggregate for ``land``: the buckets of one table's rows."""
        number = bucket_of(key or spec.key, self.buckets)
        return F.collect_set(number if own is None else F.when(own, number))

    def _read(
        self,
        name: str,
        parts: Sequence[dict],
        schema: T.StructType,
        buckets: Collection[int] | None = None,
        kind: str | None = None,
    ) -> DataFrame:
        """Rows of some parts with their batch and bucket; of the given ``buckets`` only.

        A part may have handed buckets over to a later one. Both are conditions on partition columns,
        so files of other buckets are not opened.
        """
        wanted = [p for p in parts if buckets is None or set(p["buckets"]) & set(buckets)]
        extra = [(BATCH, T.LongType()), ("attempt", T.StringType())]
        extra += [(KIND, T.StringType())] if kind else []
        fields = [T.StructField(n, t) for n, t in [*extra, (BUCKET, T.IntegerType())]]
        full = T.StructType([*schema.fields, *fields])
        if not wanted:
            rows = self.spark.createDataFrame([], full)
        else:
            reader = self.spark.read.schema(full).option("basePath", f"{self.root}/{name}")
            rows = reader.parquet(*[p["path"] for p in wanted])
            if kind:
                rows = rows.filter(F.col(KIND) == kind)
            if buckets is not None:
                rows = rows.filter(F.col(BUCKET).isin(sorted(buckets)))
            for p in wanted:
                if p.get("cut"):
                    rows = rows.filter((F.col(BATCH) != p["batch"]) | F.col(BUCKET).isin(p["buckets"]))
        return rows.drop("attempt", *([KIND] if kind else []))

    def _dealt(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows with their bucket, the rows of a bucket in one task."""
        return self._together(rows.withColumn(BUCKET, bucket_of(key, self.buckets)))

    def _together(self, rows: DataFrame) -> DataFrame:
        tasks = min(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return rows.repartition(tasks, BUCKET)

    def _net_schema(self, spec: TableSpec) -> T.StructType:
        flags = [T.StructField(RESET, T.BooleanType()), T.StructField(LIVE, T.BooleanType())]
        return T.StructType([*spec.schema.fields, *flags])

    @staticmethod
    def _image(spec: TableSpec) -> list[str]:
        return [c for c in spec.column_names if c != spec.key]

    # ---- tables --------------------------------------------------------------

    def _rows(self, name: str, manifest: dict, buckets: Collection[int] | None = None) -> DataFrame:
        """The stored rows with their bucket. Key and bucket together are the key of every join."""
        spec = self.specs[name]
        entry = manifest["tables"].get(name, {"base": [], "nets": []})
        base = self._read(name, entry["base"], spec.schema, buckets).drop(BATCH)
        if not entry["nets"]:
            return base
        keys = [BUCKET, spec.key]
        nets = self._read(name, entry["nets"], self._net_schema(spec), buckets)
        if len(entry["nets"]) == 1:
            net = nets.drop(BATCH)
        else:
            net = fold_nets(nets, keys, self._image(spec), spec.version)
        if not entry["base"]:
            return net_rows(net, keys, spec.image_names)
        small = self.files.size([p["path"] for p in entry["nets"]]) <= SMALL_NET_BYTES
        return merge_net(base, net, keys, self._image(spec), spec.version, small)

    def table(
        self, name: str, manifest: dict | None = None, buckets: Collection[int] | None = None
    ) -> DataFrame:
        """The stored rows of one table at one version, of all buckets or of some."""
        rows = self._rows(name, manifest or self.current(), buckets)
        return rows.select(*self.specs[name].all_names)

    def _put_base(self, manifest: dict, name: str, rows: DataFrame) -> int:
        spec = self.specs[name]
        dealt = self._dealt(rows.select(*spec.all_names), spec.key)
        part = self._write(dealt, name, manifest["version"], by=[BUCKET])
        manifest["tables"][name] = {"base": [part], "nets": []}
        return part["rows"]

    def full_reload(self, tables: Mapping[str, DataFrame]) -> dict[str, int]:
        """Replace all table copies in one version; history and positions stay."""
        manifest = self._next()
        with ThreadPoolExecutor(PARALLEL_WRITES) as pool:
            started = {n: pool.submit(inheritable_thread_target(self.spark)(self._put_base), manifest, n, df) for n, df in tables.items()}
            counts = {n: f.result() for n, f in started.items()}
        self._publish(manifest)
        return counts

    def bootstrap(
        self,
        tables: Mapping[str, DataFrame],
        positions: Mapping[str, str | None] | None = None,
        taken: Mapping[str, DataFrame] | None = None,
    ) -> dict[str, int]:
        """First load: tables, one open period per tracked row, starting positions.

        ``taken`` are numbers (``seq``) that the copy holds already, by queue reader.
        """
        manifest = self._next()
        counts = {name: self._put_base(manifest, name, df) for name, df in tables.items()}
        manifest["history"], manifest["consumers"] = {}, {}
        for name in tables:
            spec = self.specs[name]
            if spec.tracked:
                rows = self._rows(name, manifest)
                periods = bootstrap_periods(rows, spec.key, spec.tracked, spec.version, [BUCKET])
                name = self._history_name(name)
                part = self._write(periods.withColumn(KIND, F.lit(NOW)), name, manifest["version"], by=[KIND, BUCKET])
                manifest["history"][spec.name] = {"now": [part], "closed": []}
        for consumer, position in (positions or {}).items():
            self._put_position(manifest, consumer, position, None)
        for consumer, numbers in (taken or {}).items():
            if consumer not in manifest["consumers"]:
                self._put_position(manifest, consumer, None, None)
            manifest["consumers"][consumer]["taken"] = self._write_taken(manifest, consumer, numbers, None)
        self._publish(manifest)
        return counts

    # ---- history -------------------------------------------------------------

    @staticmethod
    def _history_name(name: str) -> str:
        return f"{name}_history"

    def _period_schema(self, spec: TableSpec) -> T.StructType:
        fields = {f.name: f for f in spec.schema.fields}
        when = fields[spec.version].dataType
        ends = [T.StructField(n, when) for n in ("valid_from", "valid_to")]
        return T.StructType([fields[spec.key], fields[spec.tracked], *ends])

    def open_periods(
        self,
        name: str,
        touched: DataFrame | None = None,
        manifest: dict | None = None,
        buckets: Collection[int] | None = None,
    ) -> DataFrame:
        """Open periods now with their bucket, of all keys or only of the ``touched`` ones (bucket, key).

        A batch says of each key whose period it opens or ends what is so after it: the open
        period, or the end of the last one. The last batch that says anything about a key decides.
        """
        spec = self.specs[name]
        parts = (manifest or self.current())["history"].get(name, {}).get("now", [])
        keys = [BUCKET, spec.key]
        rows = self._read(self._history_name(name), parts, self._period_schema(spec), buckets, NOW)
        if touched is not None:
            rows = rows.join(lookup_side(touched), keys, "left_semi")
        said = [spec.tracked, "valid_from"]
        if not _in_several(parts):
            return rows.filter(F.col("valid_to").isNull()).select(*keys, *said)
        # Of one batch an open period counts, not the end of the one before. One partial aggregate, hot keys included.
        still = F.col("valid_to").isNull()
        last = F.max_by(F.struct(still.alias("still"), *said), F.struct(F.col(BATCH), still))
        return rows.groupBy(*keys).agg(last.alias("_last")).filter("_last.still").select(
            *keys, *[F.col(f"_last.{c}").alias(c) for c in said]
        )

    def history(self, name: str, manifest: dict | None = None) -> DataFrame:
        """All periods: ``key, status, valid_from, valid_to``."""
        spec = self.specs[name]
        manifest = manifest or self.current()
        parts = manifest["history"].get(name, {}).get("closed", [])
        columns = [spec.key, spec.tracked, "valid_from", "valid_to"]
        schema = self._period_schema(spec)
        closed = self._read(self._history_name(name), parts, schema, None, CLOSED)
        still = self.open_periods(name, manifest=manifest).withColumn(
            "valid_to", F.lit(None).cast(schema["valid_to"].dataType)
        )
        return closed.select(*columns).unionByName(still.select(*columns))

    # ---- consumers -------------------------------------------------------------

    @staticmethod
    def _put_position(
        manifest: dict, consumer: str, position: str | None, batch_id: int | None
    ) -> None:
        before = manifest["consumers"].get(consumer, {})
        manifest["consumers"][consumer] = {
            "position": position,
            "batch_id": batch_id,
            "updated_at": datetime.now(UTC).isoformat(),
            "taken": before.get("taken"),
        }

    def position(self, consumer: str) -> str | None:
        return self.current()["consumers"].get(consumer, {}).get("position")

    def taken(self, consumer: str, manifest: dict | None = None) -> DataFrame | None:
        """Runs (``low, high``) of numbers a queue reader has taken, None before it has taken any."""
        path = (manifest or self.current())["consumers"].get(consumer, {}).get("taken")
        return self.spark.read.schema("low long, high long").parquet(path) if path else None

    def consumers(self) -> DataFrame:
        """Saved positions as a DataFrame."""
        rows = [
            (name, c["position"], c["batch_id"], c["updated_at"])
            for name, c in self.current()["consumers"].items()
        ]
        schema = "consumer string, position string, batch_id bigint, updated_at string"
        state = self.spark.createDataFrame(rows, schema)
        return state.withColumn("updated_at", F.to_timestamp("updated_at"))

    # ---- batches ---------------------------------------------------------------

    def apply(
        self,
        changes: Mapping[str, DataFrame],
        consumer: str,
        position: str | None | Callable[[], str | None],
        batch_id: int | None = None,
        taken: DataFrame | None = None,
        buckets: Mapping[str, Collection[int]] | None = None,
    ) -> bool:
        """Apply one batch of typed changes per table and save the position, as one commit.

        ``position`` may be a function, which then runs beside the writes; ``taken`` are numbers (``seq``) a queue
        reader took. Changes are landed first, as several steps read them, unless the caller has done that
        and says which ``buckets`` each table's rows lie in. Returns False without doing anything when this batch of the consumer is
        already committed: replaying rows would be harmless, replaying a batch's
        history would not.
        """
        done = self.current()["consumers"].get(consumer, {}).get("batch_id")
        if batch_id is not None and done is not None and batch_id <= done:
            return False
        with ExitStack() as held:
            if buckets is None:
                landed = {n: held.enter_context(self.land(n, df, buckets=self.touched(self.specs[n]))) for n, df in changes.items()}
                changes = {n: x.rows for n, x in landed.items()}
                buckets = {n: x.facts["buckets"] for n, x in landed.items()}
            self._commit(changes, buckets, consumer, position, done if batch_id is None else batch_id, taken)
        return True

    def _commit(
        self,
        changes: Mapping[str, DataFrame],
        buckets: Mapping[str, Collection[int]],
        consumer: str,
        position: str | None | Callable[[], str | None],
        batch_id: int | None,
        taken: DataFrame | None,
    ) -> None:
        manifest = self._next()
        # The parts do not depend on each other; written side by side, published together.
        with ThreadPoolExecutor(PARALLEL_WRITES) as pool:

            def start(write, *args):
                return pool.submit(inheritable_thread_target(self.spark)(write), *args)

            written, cached = {}, []
            for name, batch in changes.items():
                if not buckets[name]:
                    continue
                spec = self.specs[name]
                keyed = batch.withColumn(BUCKET, bucket_of(spec.key, self.buckets))
                dealt = self._together(keyed)
                if spec.tracked and not fits_one_task(batch):
                    # Used twice: shuffled once, and lost blocks are read again from the landed batch. Only a filled
                    # cache tells the optimizer how it is dealt.
                    dealt.persist(StorageLevel.MEMORY_AND_DISK).count()
                    cached.append(dealt)
                net = start(self._write_net, manifest, spec, dealt)
                written[name] = net, None
                if spec.tracked:
                    touched = keyed.select(BUCKET, spec.key)
                    written[name] = net, start(self._write_periods, manifest, spec, dealt, touched, buckets[name])
            saved = start(position) if callable(position) else None
            before = self.taken(consumer, manifest)
            runs = start(self._write_taken, manifest, consumer, taken, before) if taken is not None else None
        for dealt in cached:
            dealt.unpersist()
        for name, (net, periods) in written.items():
            entry = manifest["tables"].setdefault(name, {"base": [], "nets": []})
            entry["nets"] += [net.result()]
            if periods:
                part = periods.result()
                entry = manifest["history"].setdefault(name, {"now": [], "closed": []})
                entry["now"] += [part]
                entry["closed"] += [part] if part["rows"] else []
        self._put_position(manifest, consumer, saved.result() if saved else position, batch_id)
        if runs:
            manifest["consumers"][consumer]["taken"] = runs.result()
        self._publish(manifest)

    def _write_net(self, manifest: dict, spec: TableSpec, batch: DataFrame) -> dict:
        net = net_changes(batch, [BUCKET, spec.key], self._image(spec), spec.version)
        columns = [f.name for f in self._net_schema(spec)]
        return self._write(net.select(*columns, BUCKET), spec.name, manifest["version"], by=[BUCKET])

    def _write_periods(
        self, manifest: dict, spec: TableSpec, batch: DataFrame, touched: DataFrame, buckets: Collection[int]
    ) -> dict:
        keys = [BUCKET, spec.key]
        before = self.open_periods(spec.name, touched, manifest, buckets)
        # Dealt like the batch, so the two are put together without another shuffle of it.
        periods = status_periods(batch, keys, spec.tracked, open_periods=self._together(before))
        ended, seeded = F.col("valid_to").isNotNull(), F.col(SEEDED)
        # An open period the batch leaves as it was is not said again.
        kinds = F.array(F.when(ended, F.lit(CLOSED)), F.when(ended == seeded, F.lit(NOW)))
        said = periods.withColumn(KIND, F.explode(F.array_compact(kinds))).drop(SEEDED)
        name = self._history_name(spec.name)
        return self._write(said, name, manifest["version"], by=[KIND, BUCKET], counted=f"{KIND} = '{CLOSED}'")

    def _write_taken(self, manifest: dict, consumer: str, numbers: DataFrame, before: DataFrame | None) -> str:
        """The reader's runs with the numbers of a batch; there is one row per run, whatever was taken."""
        runs = joined_runs(numbers, before)
        return self._write(runs, f"{consumer}_taken", manifest["version"])["path"]

    def changes_of_versions(self, name: str, older: int, newer: int) -> DataFrame:
        """The change log that turns one version's rows into a later one's: ``op, key, columns.., version``.

        It comes from the nets written in between: they are folded, and only the older version's
        buckets that have any are read, for the keys the nets speak of. Where a base was rewritten by a reload
        in between, the two versions are compared instead.
        """
        spec, before, after = self.specs[name], self.at(older), self.at(newer)
        nets = [n for n in self._nets_between(name, older, newer) if n["buckets"]]
        image, keys = spec.image_names, [BUCKET, spec.key]
        if any(n["path"] is None for n in nets):
            return changes_between(self.table(name, before), self.table(name, after), spec.key, image)
        buckets = {b for n in nets for b in n["buckets"]}
        said = self._read(name, nets, self._net_schema(spec))
        net = fold_nets(said, keys, self._image(spec), spec.version)
        old = self._rows(name, before, buckets).join(lookup_side(net.select(*keys)), keys, "left_semi")
        new = merge_net(old, net, keys, self._image(spec), spec.version)
        return changes_between(old.drop(BUCKET), new.drop(BUCKET), spec.key, image)

    def _nets_between(self, name: str, older: int, newer: int) -> Iterator[dict]:
        """Nets of the versions after ``older`` up to ``newer``; a reload has none, so it gives a part without path."""
        for version in range(older + 1, newer + 1):
            entry = self.at(version)["tables"].get(name, {"base": [], "nets": []})
            yield from (n for n in entry["nets"] if n["batch"] == version)
            if any(p["batch"] == version and not p.get("compacted") for p in entry["base"]):
                yield {"path": None, "buckets": [0]}

    # ---- compaction and retention ------------------------------------------------------

    def compact(self, names: Sequence[str] | None = None) -> None:
        """New base rows and open periods for the buckets that have batches; closed periods become one part.

        Buckets without batches keep their files. A plain join and write per table.
        """
        manifest, before = self._next(), self.current()
        version = manifest["version"]
        for name in names or list(self.specs):
            spec, entry = self.specs[name], before["tables"].get(name, {"nets": []})
            touched = {b for p in entry["nets"] for b in p["buckets"]}
            if touched:
                rows = self._dealt(self.table(name, before, touched), spec.key)
                part = {**self._write(rows, name, version, by=[BUCKET]), "compacted": True}
                manifest["tables"][name] = {"base": [*_without(entry["base"], touched), part], "nets": []}
            said = before["history"].get(name, {"now": [], "closed": []})
            fresh = [p for p in said["closed"] if not p.get("joined")]
            touched = _in_several(said["now"])
            if not touched and len(fresh) < 2:
                continue
            schema, history = self._period_schema(spec), self._history_name(name)
            closed = self._read(history, fresh, schema, None, CLOSED).drop(BATCH).withColumn(KIND, F.lit(CLOSED))
            still = self.open_periods(name, manifest=before, buckets=touched).withColumns(
                {"valid_to": F.lit(None).cast(schema["valid_to"].dataType), KIND: F.lit(NOW)}
            )
            both = closed.unionByName(still).repartition(KIND, BUCKET)
            part = self._write(both, history, version, by=[KIND, BUCKET], counted=f"{KIND} = '{CLOSED}'")
            joined = [p for p in said["closed"] if p.get("joined")]
            now = {**part, "buckets": sorted(touched & set(part["buckets"])), "cut": True}
            manifest["history"][name] = {
                "now": [*_without(said["now"], touched), *([now] if now["buckets"] else [])],
                "closed": [*joined, *([{**part, "joined": True}] if part["rows"] else [])],
            }
        self._publish(manifest)

    def expire(self, keep: int = 1) -> int:
        """Delete manifests before the last ``keep`` and every folder none of those lists; returns how many folders.

        For when nobody reads an older version and no batch is under way.
        """
        numbers = self.versions()
        listed = {p for v in numbers[-keep:] for p in _paths(self.at(v))}
        for version in numbers[:-keep]:
            self.files.remove(self._manifest_path(version))
        gone = [f"{self.root}/_landed/{n}" for n in self.files.names(f"{self.root}/_landed")]
        for name in self.files.names(self.root):
            for batch in self.files.names(f"{self.root}/{name}") if not name.startswith("_") else ():
                folder = f"{self.root}/{name}/{batch}"
                gone += [p for a in self.files.names(folder) if (p := f"{folder}/{a}") not in listed]
        for path in gone:
            self.files.remove(path)
        return len(gone)


def _without(parts: Sequence[dict], buckets: set[int]) -> list[dict]:
    """Parts less some buckets; a part that has none left is not listed."""
    cut = [{**p, "buckets": sorted(set(p["buckets"]) - buckets), "cut": True} for p in parts]
    return [p if buckets.isdisjoint(p["buckets"]) else c for p, c in zip(parts, cut, strict=True) if c["buckets"]]


def _in_several(parts: Sequence[dict]) -> set[int]:
    """Buckets that more than one part has."""
    counts = Counter(b for p in parts for b in p["buckets"])
    return {b for b, n in counts.items() if n > 1}


def _paths(manifest: dict) -> Iterator[str]:
    for entry in [*manifest["tables"].values(), *manifest["history"].values()]:
        yield from (p["path"] for parts in entry.values() for p in parts)
    yield from (c["taken"] for c in manifest["consumers"].values() if c.get("taken"))
