"""The training-data pipeline: five stages over `documents`, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir).  All but the last return the columns of
`documents`; the last returns the packed pieces.

In every stage a null text counts as empty, other columns may be null and stay
so, further columns of docs are left out, and an empty table stays empty.
Repeated rows are rows of their own, but for near-duplicate removal, which
keeps all rows of the id that it keeps.  A null id is a document of its own in
each stage; texts that share an id are scored, searched, cut and packed each by
itself, and kept or dropped together as near duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.decontaminate import contamination
from recordloom.llm.neardup import near_duplicates
from recordloom.llm.packing import packed, pieces_of
from recordloom.llm.quality import LIMIT, scored, trained
from recordloom.llm.stages import forget, stored
from recordloom.llm.substrings import remove_repeated

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at least 0.3."""
    network = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, network).where(F.col("score") >= LIMIT).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least id, of each near-duplicate group."""
    kept = near_duplicates(docs).where("kept").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages; the others' texts stay as they are."""
    cut = remove_repeated(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark windows."""
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit = 0").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, each with its sequence and its place in it."""
    return packed(pieces_of(docs)).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("packing", packing)]

#: None: a stage runs a trained network and another one a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        if k:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
