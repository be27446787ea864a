"""A corpus through five stages: toxicity, near duplicates, benchmark decontamination, mixing, token files.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that run() writes as
Parquet to the shared folder and reads again as the next one's docs.  All but the last return the columns of documents.
Null doc_ids and texts pass through every stage but mixing, which takes no copies of documents without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinetrace.llm.common import Workspace, maybe_broadcast
from kinetrace.llm.decontam import decontaminate
from kinetrace.llm.jaccard import jaccard_components
from kinetrace.llm.mixing import pareto_mix
from kinetrace.llm.queries import op2_token_blocks
from kinetrace.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group; of rows that repeat that doc_id, the least by their columns."""
    work = Workspace(spark, "near-duplicates")
    groups = work.write(jaccard_components(docs), "groups")
    gone = work.write(groups.where("component_id is not null and doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = docs.join(maybe_broadcast(gone), "doc_id", "left_anti").select(docs.columns)
    again = work.write(groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    if not again.take(1):
        return kept
    order = W.partitionBy("doc_id").orderBy(*[c for c in docs.columns if c != "doc_id"])
    several = kept.join(maybe_broadcast(again), "doc_id", "left_semi").withColumn("row_", F.row_number().over(order)).where("row_ = 1").drop("row_")
    return kept.join(maybe_broadcast(again), "doc_id", "left_anti").unionByName(several)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item is found."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; texts stay where they are."""
    mixed = pareto_mix(docs, keep=True, work=Workspace(spark, "mixing")).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order; per document what is read back from them.  Workers hold other stages' memory too,
    so caches are half as large."""
    return op2_token_blocks(spark, sf_dir, docs, cache=60_000)


STAGES = [("toxicity", toxicity), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: The first stage is a trained classifier, which SQL can't express.  tests/llm/test_pipeline.py holds the other four stages
#: against brute force on a fixture; of the first it checks that rows go by the score of the same fitted model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the table documents."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"stage-{i}")
        if i > 0:
            work.drop(f"stage-{i - 1}")
    return docs
