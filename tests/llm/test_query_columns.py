"""Every registered query over the smallest tables: its columns, their types and its rows."""

import pytest

from sitefold.llm.queries import QUERIES

COLUMNS = {
    "op1_near_dedup": {"doc_id": "bigint", "class_id": "bigint"},
    "op2_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op3_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_decontaminate": {},
    "op5_kd_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op6_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op8_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op9_mixing": {"doc_id": "bigint"},
    "op10_sharding": {
        "doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int",
        "slot": "bigint", "grown_shard": "int",
    },
    "op11_merkle": {
        "doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string",
        "proof_sha256": "string", "folded_root": "string", "verified": "boolean",
    },
    "op12_whitening": {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
        "whitened": "double", "explained": "double", "identity_error": "double",
    },
    "op13_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
}
# One row for each document or page of the input.
ROW_FOR_ROW = {
    f"op{n}_": table
    for n, table in {1: "documents", 2: "documents", 3: "documents", 6: "documents", 7: "documents",
                     8: "pages", 9: "documents", 10: "documents", 11: "documents", 13: "documents"}.items()
}


def test_every_query_is_listed():
    assert set(COLUMNS) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, sf, name):
    out = QUERIES[name](spark, sf)
    types = dict(out.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    table = ROW_FOR_ROW.get(name[: name.index("_") + 1])
    rows = out.count()
    assert rows == spark.read.parquet(f"{sf}/{table}.parquet").count() if table else rows > 0
