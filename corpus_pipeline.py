"""The corpus pipeline: language ID, toxicity, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return
the columns of documents. ``run`` writes each stage's rows as Parquet to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creasework.llm import decontaminate, language, packing, simhash, toxicity
from creasework.llm.common import settle, table

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def _rows(docs: DataFrame) -> DataFrame:
    """Each row as one column, so that names of documents can't clash with those that an operator adds."""
    return docs.select(F.struct(*docs.columns).alias("row"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; null texts and texts without letters go."""
    found = language.identify(_rows(docs), language.fit(docs), ["row"], "row.text")
    return found.where("lang_pred <> 'und'").select("row.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scan_texts(_rows(docs), model, ["row"], "row.text").where("predicted = 0").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies (five-word shingles, similarity 0.8): the smallest doc_id."""
    return simhash.dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: hit spans are cut, documents that are mostly hits go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their sequence and offset."""
    return packing.pack(docs, packing.default_tokenizer()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, name)
    return docs
