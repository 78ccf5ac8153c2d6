"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of
``documents``; the last adds shard and slot. ``run`` writes each stage's output as Parquet and
reads it again for the next, so a stage never repeats the work of those before it.

Null or empty texts pass every stage but mixing, which may sample them out only with their
cell. Empty tables give empty results. Further columns of ``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.llm import toxicity
from sitefold.llm.decontaminate import drop_contaminated
from sitefold.llm.frames import id_fold, table
from sitefold.llm.mixing import mix_sources
from sitefold.llm.near_dedup import drop_near_duplicates
from sitefold.llm.sharding import shard_documents
from sitefold.session import Workspace

SHARDS = 40
# Share of the tokens that mixing is to keep, at any size and whatever rare values there are.
MIX_KEEP = 0.7


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), id_fold(F.col("k_id"), 5) != 0)
    judged = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), "text")
    return toxicity.score_texts(judged, model).where("predicted = 0").select("doc.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_duplicates(docs, size=5, threshold=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to raked shares of source, language and topic, as far as those reach."""
    return mix_sources(docs, keep=MIX_KEEP).where("kept").select("doc.*")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each with its shard and its slot there."""
    return shard_documents(docs, n_shards=SHARDS)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

# The classifier, the signatures and the alignments are not SQL; tests hold the stages against
# brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = work.settle(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)
        before = name
    return docs
