"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents; the last
adds the copy's number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontamination, langid, linededup, mixing, simhash
from lodestar.llm.common import checkpoint_folder, load


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: null, empty, without a letter, or with no language that leads.

    Repeated rows stay or go together; ties go to the first language by name; very long
    texts are read whole; an empty table gives no rows. Without any known language all
    documents with a letter stay.
    """
    return langid.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that an earlier document has go from the text; every document stays.

    Null and empty texts stay as they are; rows with equal id and text lose nothing to each
    other; ties go to the smaller id, then to the smaller hash of the text; very long texts
    are read whole; an empty table gives no rows.
    """
    return linededup.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id.

    Null, empty and blank texts are one group; of repeated rows one stays; null ids come
    last; very long texts are read whole; an empty table gives no rows.
    """
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go.

    Null and empty texts stay; repeated rows stay or go together; very long texts are read
    whole; an empty table gives no rows, and an empty benchmark keeps all.
    """
    return decontamination.keep_clean(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, numbered by `copy` (or a free name like it).

    Texts without words have size 0; null sources are one source; repeated rows and ids are
    documents of their own; ties are broken by a hash; an empty table gives no rows.
    """
    return mixing.emit(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: No SQL: language filters, near-duplicate groups and systematic draws have no form in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between them the table is written to the shared checkpoint folder."""
    folder = f"{checkpoint_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
