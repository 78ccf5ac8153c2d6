import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sitefold.llm.near_dedup import (
    REGISTERS,
    drop_near_duplicates,
    near_classes,
    prob_minhash,
    probability_jaccard,
)
from sitefold.session import Workspace


def shingle_counts(text):
    words = (text or "").lower().split()
    if len(words) < 5:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(texts):
    """Smallest index of each text's component; None for texts without words."""
    sets = [shingle_counts(t) for t in texts]
    holders = defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].add(i)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = {(i, j) for h in holders.values() for i in h for j in h if i < j}
    for i, j in pairs:
        a, b = sets[i], sets[j]
        if sum((a & b).values()) >= 0.3 * max(sum(a.values()), sum(b.values())):
            na, nb = sum(a.values()), sum(b.values())
            scaled = (
                {g: a[g] / na for g in a} | {g: 0 for g in b if g not in a},
                {g: b[g] / nb for g in b} | {g: 0 for g in a if g not in b},
            )
            common = [g for g in a if g in b]
            total = sum(
                1 / sum(max(scaled[0][k] / scaled[0][g], scaled[1][k] / scaled[1][g]) for k in scaled[0])
                for g in common
            )
            if total >= 0.8 - 1e-9:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def classes(docs, rows):
    frame = docs(rows)
    return near_classes(frame, Workspace(frame.sparkSession, "test")).collect()


def test_given_documents(spark, sf, docs):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.k_id: r.class_id for r in classes(docs, list(enumerate(texts)))}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_group_of_edited_copies(docs):
    """Copies of one text, near to it but mostly not to each other, and chains of copies."""
    draw = random.Random(5)
    base = [f"w{draw.randrange(9999)}" for _ in range(150)]

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[draw.randrange(len(words))] = f"e{draw.randrange(10**6)}"
        return words

    texts = [" ".join(base)] + [" ".join(edited(base, draw.randrange(1, 9))) for _ in range(120)]
    chain = [f"c{draw.randrange(9999)}" for _ in range(150)]
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = edited(chain, 3)
    got = {r.k_id: r.class_id for r in classes(docs, list(enumerate(texts)))}
    want = brute(texts)
    # Banding finds a pair at 0.8 with probability 0.99995; nothing beyond the truth may be linked.
    assert sum(got[i] != want[i] for i in range(len(texts))) <= 1


def test_signature_estimates_probability_jaccard():
    draw = np.random.default_rng(1)
    a, b = draw.integers(1, 5, 300), draw.integers(1, 5, 300)
    ids = np.arange(400)
    parts = (ids[:300].astype(np.uint64), a), (ids[100:].astype(np.uint64), b)
    exact = probability_jaccard(*[(e, w.astype(float)) for e, w in parts])
    x = np.zeros(400)
    y = np.zeros(400)
    x[:300], y[100:] = a / a.sum(), b / b.sum()
    slow = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(100, 300))
    assert exact == pytest.approx(slow)
    same = []
    for shift in range(60):
        element = np.concatenate([parts[0][0], parts[1][0]]) + np.uint64(shift * 1000)
        text = np.repeat([0, 1], 300)
        sign = prob_minhash(text, element, np.concatenate([a, b]), 2)
        same.append((sign[0] == sign[1]).mean())
    assert np.mean(same) == pytest.approx(exact, abs=4 * (0.25 / (60 * REGISTERS)) ** 0.5)


def test_rough_rows(docs):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (2, text.upper()), (2, text.upper()), (None, text), (5, None), (6, ""), (7, " \n"), (8, "a b"), (9, "A  b")]
    got = sorted(((r.k_id or -1), r.class_id, r.chosen) for r in classes(docs, rows))
    assert got == [
        (-1, 2, False), (2, 2, True), (2, 2, True), (3, 2, False),
        (5, 5, True), (6, 6, True), (7, 7, True), (8, 8, True), (9, 8, False),
    ]
    frame = docs(rows)
    kept = drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 7, 8]
    assert drop_near_duplicates(docs([])).count() == 0
