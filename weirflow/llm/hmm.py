"""A hidden Markov language model: trained by Baum-Welch over all partitions, scored by the scaled forward recursion.

States emit word classes, and a class its words by their counts. The commonest words are a class each, all others
share classes by their first and last letters, so transition and emission counts have a fixed
size, while the word counts grow with the corpus and are only ever joined. A text is its words and one end.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.session import materialize

STATES = 6
OWN_CLASS = 1 << 11  # commonest words with a class of their own
SHARED_CLASSES = 1 << 11
END = OWN_CLASS + SHARED_CLASSES
CLASSES = END + 1
# Commonest words whose counts are broadcast, so that only rarer ones are shuffled; bounds the broadcast.
FREQUENT = 1 << 17
ROUNDS = 6
_SYMBOLS_AT_ONCE = 1 << 21
_WORDS_AT_ONCE = 1 << 20


def words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes methods know ASCII letters and blanks only."""
    return (text or "").encode().lower().split()


def shared_class(word: bytes) -> int:
    return OWN_CLASS + zlib.crc32(word[:1] + word[-2:]) % SHARED_CLASSES


@dataclass
class Model:
    """start[s], move[s, s'] and emit[s, class] are probabilities of their rows."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def first(cls, class_counts: np.ndarray, seed: int = 5) -> Model:
        """States that stay, with the corpus's class shares tilted at random by a seed."""
        rng = np.random.default_rng(seed)
        move = np.full((STATES, STATES), 0.05 / (STATES - 1))
        np.fill_diagonal(move, 0.95)
        emit = (class_counts + 0.1) * rng.gamma(1.0, 1.0, (STATES, CLASSES))
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=1, keepdims=True))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        start, move, emit = start + 1, move + 1, emit + 0.1
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


class Batch:
    """Class sequences laid out step by step: the longest text first, so the texts still running are a prefix."""

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(s) for s in sequences])
        self.order = np.argsort(-sizes, kind="stable")
        ends = np.cumsum(sizes[self.order])
        step = np.arange(ends[-1]) - np.repeat(ends - sizes[self.order], sizes[self.order])
        if len(sizes) and sizes.max() <= 1 << 16:
            step = step.astype(np.uint16)  # sorted by digits, several times as fast
        self.symbols = np.concatenate([sequences[i] for i in self.order])[np.argsort(step, kind="stable")]
        self.running = np.bincount(step)
        self.starts = np.concatenate([[0], np.cumsum(self.running)])

    def log10(self, model: Model) -> np.ndarray:
        """log10 probability of each sequence, in the order they came in."""
        emit, out, ones = np.ascontiguousarray(model.emit.T), np.zeros(len(self.order)), np.ones(STATES)
        a = None
        for t, n in enumerate(self.running.tolist()):
            e = emit[self.symbols[self.starts[t] : self.starts[t + 1]]]
            a = model.start * e if a is None else (a[:n] @ model.move) * e
            scale = a @ ones
            a /= scale[:, None]
            out[:n] += np.log10(scale)
        back = np.empty_like(out)
        back[self.order] = out
        return back

    def counts(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions (Baum-Welch) of these sequences."""
        e = np.ascontiguousarray(model.emit.T, dtype=np.float32)[self.symbols]
        start, move, ones = model.start.astype(np.float32), model.move.astype(np.float32), np.ones(STATES, np.float32)
        ahead, scale = np.empty_like(e), np.empty(len(e), dtype=np.float32)
        running, starts = self.running.tolist(), self.starts.tolist()
        for t, n in enumerate(running):
            here = slice(starts[t], starts[t] + n)
            a = start * e[here] if not t else (ahead[starts[t - 1] : starts[t - 1] + n] @ move) * e[here]
            scale[here] = s = a @ ones
            ahead[here] = a / s[:, None]
        e /= scale[:, None]
        moves, behind, back = np.zeros((STATES, STATES)), None, np.ascontiguousarray(move.T)
        for t in range(len(running) - 1, -1, -1):
            n, at = running[t], starts[t]
            if behind is None:
                now = np.ones((n, STATES), dtype=np.float32)
            else:
                m, after = len(behind), starts[t + 1]
                coming = e[after : after + m] * behind
                moves += ahead[at : at + m].T @ coming
                now = coming @ back
                if m < n:  # texts that end here
                    now = np.concatenate([now, np.ones((n - m, STATES), dtype=np.float32)])
            behind = now
            ahead[at : at + n] *= now  # from here on the probability of each state given the whole text
        ahead /= ahead.sum(axis=1, keepdims=True)
        emitted = np.stack([np.bincount(self.symbols, ahead[:, s], CLASSES) for s in range(STATES)])
        return ahead[: running[0]].sum(axis=0, dtype=np.float64), moves * model.move, emitted


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Groups of rows with some two million symbols in all, with their decoded sequences."""
    rows: list = []
    sequences: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(row)
            sequences.append(np.frombuffer(row[column], "<u2"))
            size += len(sequences[-1])
            if size >= _SYMBOLS_AT_ONCE:
                yield rows, sequences
                rows, sequences, size = [], [], 0
    if rows:
        yield rows, sequences


def held_out() -> Column:
    """Documents that are not learned from: one in seven by a checksum of the id, and those without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(True))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts; summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words(text))
                if len(seen) >= _WORDS_AT_ONCE:
                    yield out(seen)
                    seen.clear()
        yield out(seen)

    def out(seen: Counter) -> pa.RecordBatch:
        columns = [pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["word", "c"])

    return texts.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def coded(docs: DataFrame, frequent: dict[bytes, tuple[int, int]]) -> DataFrame:
    """Per row: doc_id, held_out, its class sequence, what the frequent words add up to, and its other words.

    ``frequent`` has (class, count) by word. The sums are of log10(count + 1) over all frequent words (``known_log``)
    and over those in shared classes (``shared_log``), both with the end.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {w: (k, np.log10(c + 1)) for w, (k, c) in shared.value.items()}
        for batch in batches:
            sequences, sizes, known, logs, shared_logs, rest = [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                tokens = words(text)
                found = [table.get(w) for w in tokens]
                rare = [w for w, f in zip(tokens, found, strict=True) if f is None]
                sequence = [shared_class(w) if f is None else f[0] for w, f in zip(tokens, found, strict=True)]
                sequences.append(np.array([*sequence, END], dtype="<u2").tobytes())
                sizes.append(len(tokens) + 1)
                known.append(len(tokens) - len(rare))
                logs.append(float(sum(f[1] for f in found if f is not None)))
                shared_logs.append(float(sum(f[1] for f in found if f is not None and f[0] >= OWN_CLASS)))
                rest.append([w.decode() for w in rare])
            values = [sequences, sizes, known, logs, shared_logs, rest]
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string())]
            columns = [*batch.columns[:2], *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "held_out", "sequence", "n_tokens", "known", "known_log", "shared_log", "rare"]
    schema = (
        "doc_id long, held_out boolean, sequence binary, n_tokens long, known long, "
        "known_log double, shared_log double, rare array<string>"
    )
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def train(rows: DataFrame, class_counts: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the class sequences of all training rows.

    Tasks add up the expected counts of their texts; one table of CLASSES + STATES + 1 rows, summed by Spark, comes back
    per round, whatever the corpus.
    """
    model = Model.first(class_counts)
    sequences = rows.where("not held_out").select("sequence")
    schema = ", ".join(["k long", *(f"s{i} double" for i in range(STATES))])
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros((CLASSES + STATES + 1, STATES))
            for _, group in _batches(batches, 0):
                start, move, emit = Batch(group).counts(Model(*shared.value))
                total += np.concatenate([emit.T, move, start[None, :]])
            some = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(c) for c in total[some].T)], names=names)

        names = ["k", *(f"s{i}" for i in range(STATES))]
        sums = sequences.mapInArrow(run, schema).groupBy("k").agg(*(F.sum(c).alias(c) for c in names[1:])).collect()
        total = np.zeros((CLASSES + STATES + 1, STATES))
        for k, *values in sums:
            total[k] = values
        model = Model.from_counts(total[-1], total[CLASSES:-1], total[:CLASSES].T)
        shared.unpersist()
    return model


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of documents.

    base_score is the add-one unigram log10 probability, score that of the model: the exact sequence
    likelihood of the classes times the words' shares of their classes, add-one smoothed with one
    place for all unknown words. Null texts are empty: an end and no words. Repeated rows are scored, and learned from, each.
    Without training rows every word is unknown.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = materialize(word_counts(texts.where(~held_out())), "words")
    # Commonness in steps of an eighth of a doubling: few rows, and a cut that never takes more than FREQUENT words.
    step = F.floor(8 * F.log2("c"))
    cut, taken = 0, 0
    for at, size in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        taken += size
        if taken > FREQUENT:
            cut = at + 1
            break
    top = sorted(counts.where(step >= cut).collect(), key=lambda r: (-r["c"], r["word"]))
    frequent = {
        r["word"].encode(): (i if i < OWN_CLASS else shared_class(r["word"].encode()), r["c"]) for i, r in enumerate(top)
    }
    rows = materialize(coded(docs, frequent), "coded")
    ends = rows.where("not held_out").count()
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + ends, v + (ends > 0)

    # The words beyond the frequent ones, with their class by the same rule as in the tasks.
    rare = counts.where(step < cut)
    b = F.col("word").cast("binary")
    letters = F.concat(F.substring(b, 1, 1), F.substring(b, -2, 2))
    slot = F.when(F.length(b) == 1, F.concat(b, b)).otherwise(letters)
    rare_class = (OWN_CLASS + F.crc32(slot) % SHARED_CLASSES).cast("long")
    per_class = rare.groupBy(rare_class.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in per_class:
        class_n[r["k"]], class_v[r["k"]] = r["n"], r["v"]
    for k, c in frequent.values():
        class_n[k] += c
        class_v[k] += 1
    class_n[END] = ends

    model = train(rows, class_n)
    words_of_rows = rows.select("row", F.explode("rare").alias("word"))
    c = F.coalesce("c", F.lit(0))
    rare_sums = (
        words_of_rows.join(rare.select("word", "c"), "word", "left")
        .groupBy("row")
        .agg(F.sum(F.log10(c + 1)).alias("rare_log"), F.sum((c > 0).cast("long")).alias("rare_known"))
    )
    bound = rows.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit, np.log10(class_n + class_v + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *parts, class_log = bound.value
        model = Model(*parts)
        class_log = np.where((np.arange(CLASSES) >= OWN_CLASS) & (np.arange(CLASSES) < END), class_log, 0.0)
        for group, sequences in _batches(batches, 0):
            chain = Batch(sequences).log10(model)
            inside = np.array([class_log[s].sum() for s in sequences])
            values = [*zip(*group, strict=True)][1:]
            columns = [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(chain - inside)], names=[*names, "chain"])

    names = ["row", "doc_id", "held_out", "n_tokens", "known", "known_log", "shared_log"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    chains = rows.select("sequence", *names).mapInArrow(
        run,
        "row long, doc_id long, held_out boolean, n_tokens long, known long, known_log double, shared_log double, chain double",
    )
    whole = chains.join(rare_sums, "row", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    base = F.col("known_log") + rare_log + F.log10(F.lit(float(ends + 1))) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("chain") + F.col("shared_log") + rare_log).alias("score"),
    )
