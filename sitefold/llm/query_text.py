"""Queries of the operators that judge whole texts."""

from pyspark.sql import functions as F

from sitefold.llm import language_id, toxicity
from sitefold.llm.decontaminate import find_contamination
from sitefold.llm.frames import id_fold, table
from sitefold.llm.registry import query
from sitefold.session import Workspace


@query()
def op4_decontaminate(spark, sf_dir):
    leaks = find_contamination(
        table(spark, sf_dir, "documents"),
        table(spark, sf_dir, "benchmark"),
        Workspace(spark, "op4"),
    )
    return leaks.select("k_id", "item_id", "edits").withColumnRenamed("k_id", "doc_id")


@query()
def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), id_fold(F.col("k_id"), 5) != 0)
    return toxicity.score_texts(docs, model).select(
        "doc_id", (id_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted"
    )


@query()
def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs, id_fold(F.col("k_id"), 3) != 1)
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (id_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score"
    )
