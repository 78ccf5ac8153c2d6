import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from sitefold.llm import toxicity
from sitefold.llm.frames import id_fold


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Output of each stage on the smallest tables."""
    sf, folder = "/root/testdata/sf0.001", tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in cp.STAGES:
        stage(spark, out[-1], sf).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return sf, out


def test_columns_and_order(stages):
    _, out = stages
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    assert all(df.columns == out[0].columns for df in out[1:-1])
    assert out[-1].columns == [*out[0].columns, "shard", "slot"]


def test_each_stage_against_brute_force(spark, stages):
    from tests.llm.test_decontaminate import edits_in
    from tests.llm.test_near_dedup import brute

    sf, out = stages
    ids = [[r.doc_id for r in df.select("doc_id").collect()] for df in out]
    model = toxicity.fit(out[0], spark.read.parquet(f"{sf}/labels.parquet"), id_fold(F.col("k_id"), 5) != 0)
    score = model.scorer()
    texts = {r.doc_id: r.text for r in out[0].collect()}
    assert sorted(ids[1]) == sorted(i for i in texts if score(texts[i]) < 0.5)
    left = sorted(ids[1])
    classes = brute([texts[i] for i in left])
    assert sorted(ids[2]) == sorted(left[c] for c in set(classes))
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = [i for i in ids[2] if any(item in texts[i] for item in items)]
    gone = set(ids[2]) - set(ids[3])
    assert set(whole) <= gone
    for i in gone - set(whole):
        flat = " ".join(texts[i].lower().split())
        assert any(edits_in(" ".join(t.lower().split())[:160], flat) <= 16 for t in items)
    assert set(ids[4]) <= set(ids[3]) and len(ids[4]) > len(ids[3]) / 2
    assert sorted(ids[5]) == sorted(ids[4])


def test_empty_documents(spark, stages):
    sf, out = stages
    empty = out[0].limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0
