"""Queries of the de-duplication operators."""

from pyspark.sql import functions as F

from sitefold.llm.frames import table
from sitefold.llm.near_dedup import near_classes
from sitefold.llm.registry import query
from sitefold.llm.simhash import fingerprint_hex, near_components
from sitefold.llm.substring_dedup import dedup_substrings
from sitefold.session import Workspace


@query()
def op2_substring_dedup(spark, sf_dir):
    kept = dedup_substrings(table(spark, sf_dir, "documents"), k=35)
    return kept.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query()
def op1_near_dedup(spark, sf_dir):
    work = Workspace(spark, "op1")
    classes = near_classes(table(spark, sf_dir, "documents"), work, size=5, threshold=0.8)
    return classes.select(F.col("k_id").alias("doc_id"), "class_id", "chosen")


@query()
def op13_simhash(spark, sf_dir):
    work = Workspace(spark, "op13")
    found = near_components(table(spark, sf_dir, "documents"), work, size=3, max_bits=3)
    return found.select(
        F.col("k_id").alias("doc_id"), fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id"
    )
