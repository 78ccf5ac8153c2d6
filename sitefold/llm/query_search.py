"""Queries over embeddings."""

from pyspark.sql import functions as F

from sitefold.llm.frames import table
from sitefold.llm.kd_search import top_products
from sitefold.llm.registry import query
from sitefold.llm.whitening import whiten


@query("""
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM scores
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 20
""")
def op5_kd_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_products(vectors, F.col("vec_id") % 20 == 0, k=20, scale=64)


@query()
def op12_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), most=4, scale=256)
