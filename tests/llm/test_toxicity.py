import numpy as np
from pyspark.sql import functions as F

from sitefold.llm import toxicity as tx
from sitefold.llm.frames import id_fold, table

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").join(labels.select("doc_id").distinct(), "doc_id")
    model = tx.fit(docs, labels, id_fold(F.col("k_id"), 5) != 0)
    held = tx.score_texts(docs, model).where(id_fold(F.col("doc_id"), 5) == 0)
    rows = held.join(labels.select("doc_id", "toxic"), "doc_id").select("score", "toxic").collect()
    score, toxic = (np.array([r[i] for r in rows]) for i in (0, 1))
    wins = (score[toxic == 1][:, None] > score[toxic == 0]).mean()
    ties = (score[toxic == 1][:, None] == score[toxic == 0]).mean()
    assert wins + ties / 2 > 0.93
    assert ((score >= 0.5) & (toxic == 0)).sum() < 0.01 * (toxic == 0).sum()


def test_label_model_sees_through_noise_and_correlation():
    draw = np.random.default_rng(0)
    hidden = draw.random(4000) < 0.2
    rates = [(0.6, 0.02), (0.5, 0.05), (0.4, 0.02), (0.3, 0.3)]
    votes = np.column_stack([draw.random(4000) < np.where(hidden, a, b) for a, b in rates])
    votes = np.column_stack([votes, votes[:, 3:], votes[:, 3:]]).astype(np.uint8)  # one bad voter, thrice
    gold = np.where(draw.random(4000) < 0.05, ~hidden, hidden).astype(int)
    post = tx.label_model(votes, gold, np.ones(4000), 30)
    assert ((post >= 0.5) == hidden).mean() > (gold == hidden).mean()


def test_rough_rows(spark, docs):
    lab = lambda rows: spark.createDataFrame(rows, LABELS)
    frame = docs([(1, None), (2, ""), (3, "you idiot"), (3, "you idiot"), (None, "a fine day"), (6, "word " * 30_000)])
    alone = tx.fit(frame, lab([(1, 1, 0), (2, 1, None), (None, 1, 1)]), F.lit(True))
    out = tx.score_texts(frame, alone)
    assert out.columns == [c for c in frame.columns] + ["predicted"]
    assert [r.predicted for r in out.collect()] == [0, 0, 1, 1, 0, 0]
    train = [(i, f"{'vilestuff' if i % 3 == 0 else 'kindness'} and word{i}") for i in range(300)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(300)] + [(0, 1, 1), (9999, 1, 1)]
    model = tx.fit(docs(train), lab(labels), F.lit(True))
    got = tx.score_texts(docs([(1, "such vilestuff"), (2, "such kindness"), (3, None), (4, "")]), model).collect()
    assert [r.predicted for r in got] == [1, 0, 0, 0] and got[2].score == got[3].score
    assert tx.score_texts(docs([]), model).count() == 0
    assert tx.fit(docs([]), lab([]), F.lit(True)).voters
