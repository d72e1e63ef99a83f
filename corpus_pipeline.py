"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``docs``; the last returns a row per packed piece, with its token ids.

Rows with one doc_id are versions of one document: near_dedup and decontaminate keep or drop them together, so exact repeated rows
that stay all stay. Rows with a null doc_id are never dropped by these two and count for no repeated line. Null and empty texts
have no letter and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.llm._common import table, written
from sensorframe.llm.decontaminate import contaminated
from sensorframe.llm.language_id import keep_known, least_score, train_on
from sensorframe.llm.line_dedup import dedup_lines
from sensorframe.llm.near_duplicates import near_duplicates
from sensorframe.llm.packing import pack_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and those that score less in every language than nearly all labelled ones that training did not
    read. What looks like a learned language to the model stays."""
    model = train_on(docs)
    return keep_known(docs, model, least=least_score(docs, model))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the first; so do documents of which no line is left."""
    out = dedup_lines(docs).where("n_dropped < n_lines")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays."""
    gone = near_duplicates(docs).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exactly or edited, go."""
    gone = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]
#: No SQL expresses the recurrent network or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
