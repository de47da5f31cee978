"""The training-data pipeline: quality, near duplicates, benchmark leaks, secrets, mixture.

Each stage gets what the one before it kept and decides for all of it. A run writes each stage as
Parquet in the shared folder and reads it again, so a lost executor costs a part of one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.llm.common import cut, free, shared_folder, table
from quiverlake.llm.decontaminate import decontaminate
from quiverlake.llm.jaccard_join import labelled
from quiverlake.llm.mixing import mix_sources
from quiverlake.llm.quality import filter_quality
from quiverlake.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return filter_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, of its smallest doc_id; null ids and texts without words stay.

    Rows are told apart by doc_id and text: those that share a doc_id are decided each for itself.
    """
    row = cut(labelled(docs).where("grp is not null").groupBy("grp", F.col("doc_id").alias("row_id"), "text_hash").agg(F.count("*").alias("copies")))
    first = row.groupBy("grp").agg(F.min(F.struct("row_id", "text_hash")).alias("first"))
    told = row.join(first, "grp").withColumn("kept", F.struct("row_id", "text_hash") == F.col("first"))
    key = [free("row_id", docs.columns), free("text_hash", docs.columns)]
    keyed = docs.withColumn(key[0], F.col("doc_id").cast("long")).withColumn(key[1], F.xxhash64("text"))
    named = [F.col("row_id").alias(key[0]), F.col("text_hash").alias(key[1])]
    kept = keyed.join(told.where("not kept or copies > 1").select(*named), key, "left_anti").select(*docs.columns)
    repeated = cut(told.where("kept and copies > 1").select(*named))
    if not repeated.isEmpty():
        kept = kept.unionByName(keyed.join(repeated, key, "left_semi").dropDuplicates(key).select(*docs.columns))
    return kept


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that leak several items or consist of them, and without single leaked spans."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents by their sources' target weights, in global random order."""
    return mix_sources(docs).withColumn("copy_no", F.col("copy_no").cast("long"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("secret scans", secrets),
    ("mixing sources", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


#: The classifier can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
