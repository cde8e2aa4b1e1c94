"""A corpus pipeline of five stages: language ID, near duplicates, decontamination, personal data, BPE.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents, with n_chars
following the text, where the table has it.

Every stage takes empty tables, nulls in any column, whole texts of any length, repeated rows and further columns, whatever
their names. What becomes of nulls, empty texts and repeated rows is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellgauge.llm import bpe, decontaminate, langid, neardup, pii
from shellgauge.llm.common import crc_mod, renamed, written


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that the language models reject: null, empty or without letters, or like none of the languages.

    Without a labelled text to learn from all go. Repeated rows are judged one by one."""
    identifier = langid.learn(docs, crc_mod("doc_id", 4) != 2)
    rows, names = renamed(docs)
    judged = langid.identify(rows, identifier, text=names["text"], keep=names.values())
    return judged.where(~F.col("rejected")).select(*[F.col(n).alias(c) for c, n in names.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document of the smallest id stays, one row of it if rows are repeated.

    Null texts all stay; of those without words one does."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents lose the passages that benchmark items have; one of which no word is left goes.

    Null texts and those without words stay as they are, and so do all if there are no items. Rows are cleaned one by one."""
    return _recounted(decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind. No row goes; null and empty texts stay as they are."""
    return _recounted(pii.redact(docs, pii.learn(docs)))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids; the ids are decoded again and digests of both are returned.

    One row a document; a null text counts as empty and has no tokens."""
    return bpe.round_trip_digests(docs, *bpe.public_vocabulary())


STAGES = [
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("BPE", encoding),
]

#: Kneser-Ney models, Order MinHash, boosted trees and BPE are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
