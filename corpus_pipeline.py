"""The corpus pipeline: each stage applies one operator to all rows that the stage before kept.

All stages but the last return the columns of documents; rows that a stage rejects are gone, and text that it changes is
changed (n_chars follows). The last returns the pieces of the packed sequences with their token ids.

Edge cases are those of the operators: a null text is rejected as low quality where there is a classifier, and else packed
as one end id; a null doc_id is kept by near-dedup; rows with one doc_id are judged by their own texts, but for near-dedup,
which keeps or drops them together; other columns, also with names that operators use inside, pass all stages but the
last; an empty table gives an empty result at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontamination, near_dedup, packing, quality, suffix_dedup
from larkspur.llm.common import release, tables_written, written
from larkspur.llm.queries import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8."""
    return near_dedup.filtered(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that a smaller doc_id holds."""
    out = suffix_dedup.filtered(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.filtered(docs, table(spark, sf_dir, "benchmark"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences, with their ids (little-endian unsigned 32-bit)."""
    return packing.placed_pieces(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sequence_packing", sequence_packing),
]

#: Model fitting and tokenisation have no SQL form: tests/llm holds the pipeline against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each written as Parquet to the shared folder and read again; once that is done, what the stage wrote on its way and what it read are removed."""
    docs, mark = table(spark, sf_dir, "documents"), tables_written()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        release(mark, keep=1)
    return docs
