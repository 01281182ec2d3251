"""From raw documents to packed training sequences, in four stages.

Every stage gets what the one before kept, written as Parquet and read again, so that a lost executor costs no more than
one stage. The first three return the columns of documents. Null and empty texts are rejected by the first stage; repeated
rows of one id, rows without id and very long texts go through all; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import shared_folder
from lectern.llm.joins import keep_one_of_each
from lectern.llm.languages import fit_languages, keep_predicted
from lectern.llm.packing import digests, pack_documents
from lectern.llm.pseudonyms import replace_texts


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose text has no letter, or no language of score 0.5. The models are fitted on the labelled
    documents themselves."""
    return keep_predicted(docs, fit_languages(docs, F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of texts whose five-word shingles are alike by 0.8 or more."""
    return keep_one_of_each(docs, n=5, num=80, den=100)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced in the text, and n_chars of the new text."""
    return replace_texts(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, and their places in sequences of 1024 ids."""
    return digests(pack_documents(docs))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("pseudonyms", pseudonyms), ("packing", packing)]

#: The merges of a tokenizer and forward sums are nothing that SQL can express; tests compare the operators that the
#: stages call with brute force and libraries.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
