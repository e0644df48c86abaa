"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by its nearest pivots in order. Similar vectors have most of
their nearest pivots in common, so the index keeps inverted lists of pivots, and two vectors are
candidates when they share ``shared`` of their ``nearest`` pivots. Lists are kept under pairs of pivots: of two vectors with
so many pivots in common, two stand among the nearest - shared + 2 rarest of either, so only pairs of those are posted.
Candidates are verified by their cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm.graph import components, spanning_links
from weirflow.llm.postings import BLOCK, pairs, units, whole_units
from weirflow.session import materialize

# Pivots are drawn from a sample of so many different vectors, the only thing the index is fitted on.
SAMPLE = 4096
PIVOTS = 256
APART = 0.6  # pivots are less similar than this, else a large group of copies would take most of them
NEAREST = 8
SHARED = 4


def choose_pivots(sample: np.ndarray, count: int = PIVOTS, apart: float = APART) -> np.ndarray:
    """Unit vectors from the sample, each unlike all chosen before it."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen = unit[:1]
    for v in unit[1:]:
        if len(chosen) == count:
            break
        if (chosen @ v).max() < apart:
            chosen = np.concatenate([chosen, v[None, :]])
    return chosen


def _packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec): the components as bytes; null for vectors that can have no link."""
    field = vectors.schema["embedding"].dataType
    kind = "<f4" if isinstance(field, T.ArrayType) and isinstance(field.elementType, T.FloatType) else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                a = None if not v or None in v else np.array(v, dtype=kind)
                out.append(None if a is None or not np.isfinite(a).all() or not a.any() else a.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    items = "array<float>" if kind == "<f4" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(items))
    return rows.mapInArrow(run, "vec_id long, vec binary"), kind


def _matrix(column: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)


def described(classes: DataFrame, pivots: np.ndarray, kind: str, nearest: int = NEAREST) -> DataFrame:
    """Adds ``order``, the numbers of a vector's nearest pivots, the nearest first."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)
    nearest = min(nearest, len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                like = _matrix(batch.column(1).to_pylist(), kind) @ shared.value.T
                order = np.argsort(-like, axis=1, kind="stable")[:, :nearest].astype("<i4")
                columns = [*batch.columns, pa.array([o.tobytes() for o in order], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["rep", "vec", "size", "order"])

    return classes.select("rep", "vec", "size").mapInArrow(run, "rep long, vec binary, size long, order binary")


def links(classes: DataFrame, kind: str, least: float = 0.95, shared: int = SHARED, nearest: int = NEAREST, block: int = BLOCK) -> DataFrame:
    """(rep, root, links): for each vector with a link, how many vectors it is linked to, and connecting links.

    ``classes`` (rep, vec, size) has different vectors of one dimension, each standing for ``size`` copies. Rows
    (rep, root) connect the same vectors as all pairs do, so a group costs rows in proportion to its vectors. A pair that
    meets in several lists counts in the first of its common ones only; ``links`` are to be summed by rep.
    """
    sample = [bytes(r["vec"]) for r in classes.orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).select("vec").collect()]
    pivots = choose_pivots(_matrix(sample, kind))
    nearest = min(nearest, len(pivots))
    shared = min(shared, nearest)
    index = materialize(described(classes, pivots, kind, nearest), "described")

    # How often each pivot is among the nearest decides which ones are rare; one row per pivot.
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pivots), dtype=np.int64)
        for batch in batches:
            for order in batch.column(0).to_pylist():
                total[np.frombuffer(order, "<i4")] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["pivot", "n"])

    counted = index.select("order").mapInArrow(tally, "pivot long, n long").groupBy("pivot").agg(F.sum("n").alias("n"))
    rows = counted.orderBy("n", "pivot").collect()
    rank = np.empty(len(pivots), dtype=np.int64)
    rank[[r["pivot"] for r in rows]] = np.arange(len(rows))
    posted = nearest - shared + 2
    first, second = np.triu_indices(min(posted, nearest), 1)
    single = len(first) == 0  # one pivot only: all vectors are in its list

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4").reshape(batch.num_rows, -1)
            ranks = np.sort(rank[order], axis=1)
            keys = ranks[:, :1] if single else ranks[:, first] * len(rank) + ranks[:, second]
            at = np.repeat(np.arange(batch.num_rows), keys.shape[1])
            ranked = pa.array([r.tobytes() for r in ranks.astype("<i4")], pa.binary())
            columns = [pa.array(keys.ravel()), *(c.take(pa.array(at)) for c in (batch.column(0), batch.column(1), ranked, batch.column(3)))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "rep", "vec", "ranks", "size"])

    postings = index.select("rep", "vec", "order", "size").mapInArrow(post, "key long, rep long, vec binary, ranks binary, size long")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_units(batches):
            v = t["vec"].copy().view(kind).astype(np.float64)
            ranks = t["ranks"].copy().view("<i4")
            norm = np.sqrt(np.einsum("ij,ij->i", v, v))
            n_links = np.zeros(len(v), dtype=np.int64)
            one, two = [], []
            for a, b in pairs(t):
                same = (ranks[a][:, :, None] == ranks[b][:, None, :]).any(axis=2)
                ok = same.sum(axis=1) >= shared
                a, b, same = a[ok], b[ok], same[ok]
                ok = np.einsum("ij,ij->i", v[a], v[b]) >= least * norm[a] * norm[b]
                a, b, same = a[ok], b[ok], same[ok]
                one.append(t["rep"][a])
                two.append(t["rep"][b])
                # ranks are sorted, so the first two in common are the first list that both are in
                common = np.sort(np.where(same, ranks[a], len(rank)), axis=1)
                own = common[:, 0] if single else common[:, 0].astype(np.int64) * len(rank) + common[:, 1]
                here = own == t["key"][a]
                np.add.at(n_links, a[here], t["size"][b[here]])
                np.add.at(n_links, b[here], t["size"][a[here]])
            some = np.flatnonzero(n_links)
            node, root = spanning_links(np.concatenate(one), np.concatenate(two)) if one else (np.empty(0, np.int64),) * 2
            reps = pa.array(np.concatenate([t["rep"][some], node]), pa.int64())
            roots = pa.array([*[None] * len(some), *root.tolist()], pa.int64())
            counts = pa.array(np.concatenate([n_links[some], np.zeros(len(node), np.int64)]), pa.int64())
            yield pa.RecordBatch.from_arrays([reps, roots, counts], names=["rep", "root", "links"])

    return units(postings, "rep", block).mapInArrow(verify, "rep long, root long, links long")


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding).

    Vectors are linked at a cosine of ``least`` or more, whatever their other columns say; n_links counts the linked
    rows, component_id is the smallest vec_id reachable, kept whether the row is that one. Equal vectors meet first and
    stand in the index once. Rows that share a vec_id are vectors of their own, each with its own links. Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without vec_id, link with nothing; so do vectors of different dimensions. Every row is indexed.
    """
    packed, kind = _packed(vectors)
    rows = materialize(packed, "vectors")
    key = F.md5("vec")
    sound = rows.where("vec is not null and vec_id is not null").select("vec_id", "vec", key.alias("md5"))
    classes = sound.groupBy("md5").agg(F.min("vec_id").alias("first_id"), F.first("vec").alias("vec"), F.count("*").alias("size"))
    # Different vectors may share their ids, so a class has a number of its own, written down with it.
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    found = None
    for row in classes.select(F.length("vec").alias("n")).distinct().orderBy("n").collect():
        of_one = materialize(links(classes.where(F.length("vec") == row["n"]), kind, least), "found")
        found = of_one if found is None else found.unionByName(of_one)
    own = F.col("vec_id")
    if found is None:
        return rows.select(own, F.lit(0).cast("long").alias("n_links"), own.alias("component_id"), F.lit(True).alias("kept"))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.where("root is not null").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    groups = (
        classes.select("md5", "rep", "size", "first_id")
        .join(counted, "rep", "left")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .select("md5", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("root"), "first_id")
    )
    groups = materialize(groups, "groups")
    smallest = groups.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = groups.join(smallest, "root").select("md5", "n_links", "component_id")
    marked = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), key).alias("md5")).join(groups, "md5", "left")
    component = F.coalesce("component_id", "vec_id")
    return marked.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (own == component).alias("kept")
    )
