"""SimHash near-duplicates, candidates by a ring of segments.

A fingerprint is cut into segments laid out in a ring. If two fingerprints differ
in at most t bits in total, some segment starts a chain in which every prefix of l
segments differs in at most t * l / segments bits (were each start to break its
budget, the broken stretches would cover the ring and add up to more than t). A
chain's first segments have a budget below one bit, so they are equal: they are the
key under which fingerprints meet. The budgets of the longer prefixes then prune
pairs before all bits are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.graph import components, spanning_links
from weirflow.llm.postings import BLOCK, pairs, units, whole_units
from weirflow.session import materialize

BITS = 64
_SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of a text; zero for a text without words.

    Shingles of ``width`` words count as often as they occur; a text of fewer words
    is one shingle. bytes.lower and bytes.split treat exactly A-Z and the six ASCII
    blanks, whatever else the text holds.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    joined, width = b" ".join(words), min(width, len(words))
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(starts), _SHINGLES_AT_ONCE):
        part = zip(starts[i : i + _SHINGLES_AT_ONCE], stops[i : i + _SHINGLES_AT_ONCE], strict=True)
        h = np.array([xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in part], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for each row of documents; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def budgets(distance: int, segments: int) -> list[int]:
    """Most differing bits of a chain's first 1, 2, .. segments."""
    return [distance * n // segments for n in range(1, segments + 1)]


def _keys(fp, distance: int, segments: int):
    """One key per start of a chain: the start's number and the equal segments after it."""
    size = BITS // segments
    span = size * sum(b == 0 for b in budgets(distance, segments))
    keys = []
    for start in range(segments):
        turned = fp if not start else F.shiftrightunsigned(fp, size * start).bitwiseOR(F.shiftleft(fp, BITS - size * start))
        keys.append(turned.bitwiseAND(F.lit((1 << span) - 1)).bitwiseOR(F.lit(start << span)))
    return F.array(*keys), span


def _linked(x: np.ndarray, start: np.ndarray, distance: int, segments: int) -> np.ndarray:
    """Which differences x keep all budgets of the chain from ``start``; the last budget is the full check."""
    size, limits = BITS // segments, budgets(distance, segments)
    turn = (start * size).astype(np.uint64)
    turned = np.where(turn == 0, x, (x >> turn) | (x << ((np.uint64(BITS) - turn) % np.uint64(BITS))))
    ok = np.ones(len(x), dtype=bool)
    for n, limit in enumerate(limits, 1):
        if n == segments or limits[n] > limit:  # the longest prefix with this budget implies the shorter ones
            bits = turned if n == segments else turned & np.uint64((1 << (n * size)) - 1)
            ok &= np.bitwise_count(bits) <= limit
    return ok


def links(classes: DataFrame, distance: int = 3, segments: int = 16, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the ``rep`` ids of fingerprints within ``distance`` bits.

    ``classes`` has one row (fp, rep) per fingerprint. The links returned connect the same
    ids as all pairs within the distance do. Lists of more than ``block`` fingerprints under one
    key are cut into blocks, and each pair of blocks is one unit of work: no list is
    read whole by one task, and none is shortened.
    """
    keys, span = _keys(F.col("fp"), distance, segments)
    postings = classes.select("fp", "rep", F.explode(keys).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_units(batches):
            fp, start, one, two = t["fp"].view(np.uint64), t["key"] >> span, [], []
            for a, b in pairs(t):
                ok = _linked(fp[a] ^ fp[b], start[a], distance, segments)
                one.append(t["rep"][a[ok]])
                two.append(t["rep"][b[ok]])
            if one:
                ends = spanning_links(np.concatenate(one), np.concatenate(two))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], names=["a", "b"])

    return units(postings, "fp", block).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 3, width: int = 3, segments: int = 16) -> DataFrame:
    """(doc_id, fp, component_id) for each row of documents.

    component_id is the smallest doc_id reachable over fingerprints that differ in at
    most ``distance`` bits. Equal fingerprints meet first, so copies cost no pairs. Texts
    that are null or have no words share the fingerprint zero and are linked. A row
    without doc_id is fingerprinted and has no component; repeated rows stay. An empty table
    gives an empty result.
    """
    marked = materialize(fingerprints(docs, width), "fingerprints")
    classes = marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "classes")
    joined = components(links(classes, distance, segments))
    groups = classes.join(joined, classes.rep == joined.node, "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return marked.join(materialize(groups, "groups"), "fp", "left").select("doc_id", "fp", own.alias("component_id"))
