"""From documents to token ids in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import lines, mixing, quality, queries, simhash
from weirflow.session import materialize

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
REST = ("lang", "source")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is in ``ids``, the null one included; the ids grow with the rows, so they are never broadcast."""
    wanted = ids.select(F.col("doc_id").alias("wanted")).hint("merge")
    rows = docs.select(F.struct("*").alias("row"))  # whatever the table's columns are called
    return rows.join(wanted, F.col("row.doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows that share a doc_id stay if one of them is kept."""
    return _only(docs, quality.judge(docs).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one has; a document of such lines only is left empty."""
    cut = lines.deduplicate_lines(docs, keep=REST)
    return cut.select("doc_id", "text", *REST, F.length("text").cast("long").alias("n_chars"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies; rows without doc_id belong to no group and stay."""
    found = simhash.near_duplicates(docs)
    return _only(docs, found.where("component_id is null or doc_id = component_id"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the words that the mix takes of it; documents of which it takes none go."""
    taken = mixing.mix(docs, carry=("text", "lang")).where("taken > 0")
    which = ["whole", "first_word", "extra", "blocks", "turn", "block_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, text, lang, source, *words = batch.columns
            rows = zip(text.to_pylist(), *(w.to_pylist() for w in words), strict=True)
            texts = [mixing.taken_text(*row) for row in rows]
            columns = [doc_id, pa.array(texts, pa.string()), lang, source, pa.array([len(t) for t in texts])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "lang", "source", "n_chars"])

    return taken.select("doc_id", "text", "lang", "source", *which).mapInArrow(run, COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text's ids and of what they decode to."""
    return queries.tokens(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_near_dedup),
    ("mixing", mixed),
    ("byte-level BPE", byte_bpe),
]

# The learned accuracies, seeded fingerprints and merges have no SQL; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
