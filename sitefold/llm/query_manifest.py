"""Query of the dataset manifest."""

from pyspark.sql import functions as F

from sitefold.llm.frames import table
from sitefold.llm.merkle import proof_digest, verify_claims
from sitefold.llm.registry import query


@query("""
WITH RECURSIVE rows_of AS (
  SELECT doc_id, lang,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
         || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS chars,
         coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') AS more,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         xor(list_reduce(
           list_prepend(4294967295::BIGINT,
             list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
           lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))
         ), 4294967295::BIGINT) % 7 = 0 AS tampered
  FROM documents
), leaves AS MATERIALIZED (
  SELECT doc_id, lang, sha256(head || chars || tail) AS leaf,
         CASE WHEN tampered THEN sha256(head || more || tail)
              ELSE sha256(head || chars || tail) END AS claim
  FROM rows_of
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY lang) AS n
  FROM leaves
), nodes AS (
  SELECT 0 AS level, lang, place, n, leaf AS digest FROM placed
  UNION ALL
  SELECT level + 1, lang, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place))
  FROM nodes WHERE n > 1 GROUP BY level, lang, place // 2, n
), subroots AS MATERIALIZED (
  SELECT lang, level AS height, digest AS subroot,
         row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, place, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place))
  FROM tops WHERE n > 1 GROUP BY level, place // 2, n
), proofs AS (
  SELECT 0 AS level, p.doc_id, p.lang, p.place, p.n, p.leaf, s.subroot, s.place AS top_place,
         p.claim AS folded, '' AS siblings
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT p.level + 1, p.doc_id, p.lang, p.place // 2, (p.n + 1) // 2, p.leaf, p.subroot, p.top_place,
         sha256(CASE WHEN p.place % 2 = 0 THEN p.folded || coalesce(s.digest, '')
                     ELSE coalesce(s.digest, '') || p.folded END),
         p.siblings || coalesce(s.digest, '')
  FROM proofs p LEFT JOIN nodes s
    ON s.level = p.level AND s.lang IS NOT DISTINCT FROM p.lang AND s.place = xor(p.place, 1)
  WHERE p.n > 1
), whole AS (
  SELECT 0 AS level, doc_id, leaf, subroot, top_place AS place, (SELECT count(*) FROM subroots) AS n,
         folded, siblings FROM proofs WHERE n = 1
  UNION ALL
  SELECT w.level + 1, w.doc_id, w.leaf, w.subroot, w.place // 2, (w.n + 1) // 2,
         sha256(CASE WHEN w.place % 2 = 0 THEN w.folded || coalesce(s.digest, '')
                     ELSE coalesce(s.digest, '') || w.folded END),
         w.siblings || coalesce(s.digest, '')
  FROM whole w LEFT JOIN tops s ON s.level = w.level AND s.place = xor(w.place, 1)
  WHERE w.n > 1
)
SELECT doc_id, leaf, subroot, (SELECT digest FROM tops WHERE n = 1) AS root,
       sha256(siblings) AS proof_sha256, folded AS folded_root,
       folded = (SELECT digest FROM tops WHERE n = 1) AS verified
FROM whole WHERE n = 1
""")
def op11_merkle(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    # A decimal, since the largest long has no successor.
    n_chars = F.col("n_chars").cast("decimal(20,0)")
    docs = table(spark, sf_dir, "documents").withColumn("n_chars", n_chars)
    altered = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars")).cast("decimal(20,0)")}
    return verify_claims(docs, altered).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", "verified",
    )
