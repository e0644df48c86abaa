"""Ranked lexical search, exact, through ball trees of sparse document vectors.

A score is an inner product: how often a query names a term, times what a document has for that term. A
ball of documents with a centre c and a radius r has no score above q.c + |q| r. So a tree of balls is searched best
first, and a subtree whose bound is below the worst of a query's best documents is left out whole. Bounds are
rounded up further than floating point can be wrong; documents in a leaf are scored in whole numbers.

Trees stand over some documents each, as they lie in their files, and over the terms of some queries: documents are neither shuffled
nor gathered, and a tree has a bounded size whatever the table's. Each task keeps the best of its trees; Spark ranks those.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirflow.session import materialize

# In UTF-8: digits, letters and every byte of a character beyond ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
# Terms of all queries that are searched for in one pass over the documents, the bound of what goes to tasks.
PASS_TERMS = 1 << 20
# Different terms that the queries of one tree have together, if there are two queries or more.
TREE_TERMS = 256
# Most documents in a tree, and most cells (documents by terms) of its matrix.
TREE_DOCS, TREE_CELLS = 2048, 1 << 23
LEAF_DOCS = 32
_EXACT = 1 << 53  # whole numbers below this are exact as doubles, in sums too
_SAFE = 1e-9  # far more than the relative error of any bound
_NO_ID = 1 << 63  # a missing id, after all others


def terms(text: str | None) -> list[bytes]:
    """Terms of a whole text in order; bytes.lower changes A-Z only."""
    return TERM.findall((text or "").encode().lower())


@dataclass
class Queries:
    """Queries that share trees: the columns are term numbers, each cell how often a query names the term."""

    keys: list[int]
    columns: np.ndarray
    names: np.ndarray  # (query, column), whole numbers

    @classmethod
    def grouped(cls, queries: Sequence[tuple[int, dict[int, int]]], most: int) -> Iterator[Queries]:
        held: list[tuple[int, dict[int, int]]] = []
        known: set[int] = set()
        for key, named in queries:
            if held and len(known | named.keys()) > most:
                yield cls._of(held, known)
                held, known = [], set()
            held.append((key, named))
            known |= named.keys()
        if held:
            yield cls._of(held, known)

    @classmethod
    def _of(cls, held: list[tuple[int, dict[int, int]]], known: set[int]) -> Queries:
        columns = np.array(sorted(known), dtype=np.int64)
        names = np.zeros((len(held), len(columns)), dtype=np.int64)
        for row, (_, named) in enumerate(held):
            at = np.searchsorted(columns, np.fromiter(named, np.int64, len(named)))
            names[row, at] = np.fromiter(named.values(), np.int64, len(named))
        return cls([key for key, _ in held], columns, names)


class BallTree:
    """Balls over the rows of a matrix of whole numbers (documents by terms)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF_DOCS):
        self.x, self.leaf = x, leaf
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray] = []
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self._squares = np.einsum("ij,ij->i", x, x, dtype=np.float64)
        self._ball(np.arange(len(x)))

    def _ball(self, rows: np.ndarray) -> int:
        """Adds the ball of some rows and those inside of it; returns its number."""
        at, x, squares = len(self.rows), self.x[rows].astype(np.float64, copy=False), self._squares[rows]

        def apart(point: np.ndarray) -> np.ndarray:
            return squares - 2 * (x @ point) + point @ point

        centre = x.mean(axis=0)
        far = apart(centre)
        # The difference of squares may be wrong by its terms' rounding, so that is added before the root is taken.
        worst = np.maximum(far, 0) + _SAFE * (squares + centre @ centre)
        self.children.append(None)
        self.rows.append(rows)
        self.centres.append(centre)
        self.radii.append(math.sqrt(worst.max()) * (1 + _SAFE))
        if len(rows) > self.leaf:
            # Halves by which of two far rows is nearer; equal rows are halved too, so this ends.
            one = x[far.argmax()]
            from_one = apart(one)
            order = np.argsort(from_one - apart(x[from_one.argmax()]), kind="stable")
            half = len(rows) // 2
            del x
            self.children[at] = (self._ball(rows[order[:half]]), self._ball(rows[order[half:]]))
        return at

    def bounds(self, names: np.ndarray) -> np.ndarray:
        """(query, ball): no row of the ball has a greater inner product with the query."""
        q = names.astype(np.float64)
        reach = np.sqrt(np.einsum("ij,ij->i", q, q))[:, None] * np.array(self.radii)[None, :]
        return (q @ np.array(self.centres).T + reach) * (1 + _SAFE) + 1


class Best:
    """The best ``k`` documents of a query: greater scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k = k
        self.heap: list[tuple[int, int]] = []  # (score, -id), the worst first

    @property
    def least(self) -> int:
        """No score below this can enter."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def add(self, score: int, doc_id: int) -> None:
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, (score, -doc_id))
        else:
            heapq.heappushpop(self.heap, (score, -doc_id))


def search_tree(tree: BallTree, ids: Sequence[int], names: np.ndarray, best: Sequence[Best]) -> int:
    """Adds the tree's rows to the best of each query, by best-first search; returns how many rows were scored."""
    bounds, scored = tree.bounds(names), 0
    leaves: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for q, own in enumerate(best):
        row = bounds[q]
        open_balls = [(-row[0], 0)]
        while open_balls:
            bound, ball = heapq.heappop(open_balls)
            if -bound < own.least:
                break
            inside = tree.children[ball]
            if inside:
                for child in inside:
                    heapq.heappush(open_balls, (-row[child], child))
                continue
            if ball not in leaves:
                # All queries that may still come here are scored together.
                some = [p for p in range(q, len(best)) if bounds[p, ball] >= best[p].least]
                scores = tree.x[tree.rows[ball]] @ names[some].T.astype(tree.x.dtype)
                leaves[ball] = (np.array(some), scores.astype(np.int64))
                scored += scores.size
            some, scores = leaves[ball]
            found = scores[:, np.searchsorted(some, q)]
            for at in np.flatnonzero(found >= own.least).tolist():
                own.add(int(found[at]), ids[tree.rows[ball][at]])
    return scored


def query_terms(items: DataFrame) -> DataFrame:
    """(key, item_id, terms, named): the different terms of each row of (item_id, text) and how often it names them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(terms(t)) for t in batch.column(2).to_pylist()]
            found = pa.array([[t.decode() for t in c] for c in counts], pa.list_(pa.string()))
            named = pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))
            columns = [batch.column(0), batch.column(1), found, named]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "item_id", "terms", "named"])

    rows = items.select(F.monotonically_increasing_id(), F.col("item_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "key long, item_id long, terms array<string>, named array<long>")


def document_terms(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tf): a document's number of terms, and which of the ``known`` ones it has how often."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            sizes, numbers, times = [], [], []
            for text in batch.column(1).to_pylist():
                all_terms = terms(text)
                counts = Counter(map(number, all_terms))
                counts.pop(None, None)
                sizes.append(len(all_terms))
                numbers.append(list(counts))
                times.append(list(counts.values()))
            lists = pa.list_(pa.int32())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(numbers, lists), pa.array(times, lists)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def weights(found: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms in all, and the weight of every term; one row a term reaches the driver."""
    n_docs, length = found.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holders = found.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    out = np.zeros(n_terms, dtype=np.int64)
    for term, df in holders:
        out[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    return n_docs, length, out


def _best_of_tasks(found: DataFrame, groups: list[Queries], n_docs: int, length: int, weight: np.ndarray, k: int) -> DataFrame:
    """(key, score, doc_id): the best documents of each task for each query."""
    shared = found.sparkSession.sparkContext.broadcast((groups, weight))
    largest = int(weight.max(initial=0)) * 1_000_000  # more than any cell has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, weight = shared.value
        best = [[Best(k) for _ in g.keys] for g in groups]
        ids: list[int] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = min(TREE_DOCS, max(1, TREE_CELLS // max(len(g.columns) for g in groups)))

        def search() -> None:
            place = np.repeat(np.arange(len(held)), [len(t) for t, _ in held])
            term, cell = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            for g, own in zip(groups, best, strict=True):
                at = np.minimum(np.searchsorted(g.columns, term), len(g.columns) - 1)
                mine = g.columns[at] == term
                some, rank = np.unique(place[mine], return_inverse=True)
                if len(some):
                    exact = int(g.names.sum(axis=1).max()) * largest < _EXACT
                    x = np.zeros((len(some), len(g.columns)), dtype=np.float64 if exact else np.int64)
                    x[rank, at[mine]] = cell[mine]
                    search_tree(BallTree(x), [ids[i] for i in some.tolist()], g.names, own)

        for batch in batches:
            for doc_id, n, term, tf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m = 100 - 25 + 25 * n * n_docs // length
                number, times = np.array(term, dtype=np.int64), np.array(tf, dtype=np.int64)
                ids.append(_NO_ID if doc_id is None else doc_id)
                held.append((number, weight[number] * (1_000_000_000 * times // (1000 * times + 12 * m))))
                if len(held) == rows:
                    search()
                    ids.clear()
                    held.clear()
        if held:
            search()
        out = [(key, s, None if -i == _NO_ID else -i) for g, own in zip(groups, best, strict=True)
               for key, b in zip(g.keys, own, strict=True) for s, i in b.heap]
        columns = [pa.array([r[c] for r in out], pa.int64()) for c in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "score", "doc_id"])

    some = found.where(F.size("terms") > 0)
    return some.mapInArrow(run, "key long, score long, doc_id long")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank int, doc_id, score): the k best documents (doc_id, text) of each item (item_id, text).

    Terms are runs of digits, letters and characters beyond ASCII, A-Z in lower case. A term weighs
    w = floor(1000 ln((2 N + 2) / (2 df + 1))), and a document scores the sum over the item's terms, repeats included, of
    w * (10**9 tf div (1000 tf + 12 m)), where m = 75 + 25 n N div L. Only scores above 0 count; equal scores
    go by ascending doc_id, a missing one last. Null and empty texts have no terms: such documents count nowhere, such items have no
    rows. Rows that share an id, of either table, are documents or items of their own. An empty table on
    either side gives no rows. Other columns are ignored. Items are searched for in passes of ``PASS_TERMS`` terms, as many as they need.
    """
    spark = docs.sparkSession
    asked = materialize(query_terms(items), "queries")
    size = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = max(1, math.ceil(size / PASS_TERMS))
    out = spark.createDataFrame([], "key long, score long, doc_id long")
    for number in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == number).orderBy("key").collect()
        known = {t: i for i, t in enumerate(sorted({t.encode() for r in rows for t in r["terms"]}))}
        if known:
            found = materialize(document_terms(docs, known), "document-terms")
            n_docs, length, weight = weights(found, len(known))
            named = [(r["key"], {known[t.encode()]: n for t, n in zip(r["terms"], r["named"], strict=True)}) for r in rows]
            groups = list(Queries.grouped([x for x in named if x[1]], TREE_TERMS))
            out = out.union(_best_of_tasks(found, groups, n_docs, length, weight, k))
    best = W.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")
