"""Queries of sharding and mixing."""

from pyspark.sql import functions as F

from sitefold.llm.frames import table
from sitefold.llm.mixing import mix_sources
from sitefold.llm.registry import query
from sitefold.llm.sharding import shard_manifest


SHARDS = 40


def sharding_sql(shards: int) -> str:
    """The two ranks as windows; crc32 by half bytes, the lower of a byte first."""
    return f"""
WITH steps AS MATERIALIZED (
  SELECT list(list_reduce([n, 0, 0, 0, 0],
                lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1))) ORDER BY n) AS half
  FROM range(16) t(n)
), sized AS (
  SELECT doc_id, source, coalesce(strlen(text), 0) + 16 AS size,
         regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\\2\\1', 'g') AS digits,
         CAST('0x' || substr(md5('shards:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS mixed
  FROM documents
), summed AS (
  SELECT doc_id, source, size, mixed,
         xor(list_reduce(
           list_prepend(4294967295::BIGINT,
             list_transform(list_filter(string_split(digits, ''), lambda c: c <> ''), lambda c: CAST('0x' || c AS BIGINT))),
           lambda crc, d: xor(crc >> 4, half[(xor(crc, d) & 15) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM sized, steps
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY mixed, doc_id NULLS FIRST) - 1 AS r,
         count(*) OVER (PARTITION BY source) AS n
  FROM summed
), cut AS (
  SELECT *, row_number() OVER (
           ORDER BY CAST(2 * r + 1 AS DOUBLE) / (2 * n), source NULLS FIRST, mixed, doc_id NULLS FIRST) - 1 AS pos,
         count(*) OVER () AS total
  FROM ranked
)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law,
       CAST(pos * {shards} // total AS INTEGER) AS shard,
       CAST(pos - (pos * {shards} // total * total + {shards - 1}) // {shards} AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""


@query(sharding_sql(SHARDS))
def op10_sharding(spark, sf_dir):
    return shard_manifest(table(spark, sf_dir, "documents"), n_shards=SHARDS).select(
        F.col("k_id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


MIX_TEMPER, MIX_SWEEPS = 0.7, 6


def mixing_sql(temper: float, sweeps: int) -> str:
    """The raking of ``mix_sources`` unrolled into one WITH clause for each scaling."""
    dims = ("source", "lang", "topic")
    steps, last = [], "started"
    for sweep in range(sweeps):
        for dim in dims:
            name = f"{dim}_{sweep}"
            steps.append(
                f"{name} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {dim}) > 0"
                f" THEN w * t_{dim} / sum(w) OVER (PARTITION BY {dim}) ELSE 0 END AS w) FROM {last})"
            )
            last = name
    shares = ", ".join(
        f"(SELECT pow(sum(tokens), {temper}) FROM cells x WHERE x.{d} = c.{d})"
        f" / (SELECT sum(pow(n, {temper})) FROM (SELECT sum(tokens) AS n FROM cells GROUP BY {d})"
        f" WHERE n > 0) AS t_{d}"
        for d in dims
    )
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
         CASE WHEN text IS NULL THEN '(none)' WHEN contains(text, 'License') THEN 'legal'
              WHEN contains(text, '@') THEN 'contact' WHEN contains(text, '|') THEN 'table'
              ELSE 'prose' END AS topic,
         CASE WHEN strlen(text) > 0
              THEN strlen(text) - strlen(replace(replace(text, ' ', ''), chr(10), '')) + 1
              ELSE 0 END AS tokens
  FROM documents
), cells AS MATERIALIZED (
  SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM docs GROUP BY ALL
), started AS MATERIALIZED (
  SELECT *, CAST(tokens AS DOUBLE) / (SELECT sum(tokens) FROM cells) AS w, {shares} FROM cells c
), {", ".join(steps)}, chances AS MATERIALIZED (
  SELECT source, lang, topic,
         coalesce(CASE WHEN tokens > 0 THEN w / tokens END
                  / (SELECT max(w / tokens) FROM {last} WHERE tokens > 0), 1) AS probability
  FROM {last}
)
SELECT doc_id, CAST(tokens AS BIGINT) AS tokens, topic, round(probability, 9) AS probability,
       CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT)
       / 281474976710656.0 < probability AS kept
FROM docs JOIN chances USING (source, lang, topic)
"""


@query(mixing_sql(MIX_TEMPER, MIX_SWEEPS))
def op9_mixing(spark, sf_dir):
    mixed = mix_sources(table(spark, sf_dir, "documents"), temper=MIX_TEMPER, sweeps=MIX_SWEEPS)
    return mixed.select(
        "doc.doc_id",
        "tokens",
        F.col("m_topic").alias("topic"),
        F.round("probability", 9).alias("probability"),
        "kept",
    )
