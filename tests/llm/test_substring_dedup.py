import random
import re
from collections import Counter

import pytest

from sitefold.llm.substring_dedup import dedup_substrings


def brute(texts, k):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        lost = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                lost.update(range(i, i + k))
        out.append((len(w), len(lost), " ".join(x for i, x in enumerate(w) if i not in lost)))
    return out


def check(docs, texts, k):
    rows = dedup_substrings(docs(list(enumerate(texts))), k=k).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in rows}
    assert got == dict(enumerate(brute(texts, k)))


def test_given_documents(spark, sf, docs):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(docs, texts, 35)


@pytest.mark.parametrize("seed", range(3))
def test_random_small_vocabulary(docs, seed):
    draw = random.Random(seed)
    texts = [" ".join(draw.choice("abcd") for _ in range(draw.randrange(90))) for _ in range(40)]
    shared = " ".join(str(draw.randrange(50)) for _ in range(50))
    texts += [f"{draw.random()} {shared} {draw.random()}" for _ in range(20)]
    check(docs, texts, 35)


def test_repeats_inside_one_text_and_rough_texts(docs):
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [
        "a " * 200, None, "", "  \n\t ", "one two", "x y\x0bz\x85w " * 40, long,
        "head " + long + " tail", " ".join(f"u{i}" for i in range(35)), "é\x1cü ß " * 70,
    ]
    check(docs, texts, 35)


def test_repeated_rows_null_ids_and_empty_table(docs):
    text = " ".join(f"w{i}" for i in range(40))
    rows = dedup_substrings(docs([(1, text), (1, text), (None, "a b")])).collect()
    found = sorted((r.doc_id or -1, r.n_removed, r.kept_text) for r in rows)
    assert found == [(-1, 0, "a b"), (1, 40, ""), (1, 40, "")]
    assert dedup_substrings(docs([])).count() == 0
