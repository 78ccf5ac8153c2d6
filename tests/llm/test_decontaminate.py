import random

import numpy as np
import pytest

from sitefold.llm import decontaminate as dc
from sitefold.session import Workspace


def edits_in(pattern, text):
    """Smallest edit distance of the pattern to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def spoil(draw, text, n):
    out = list(text)
    for _ in range(n):
        at = draw.randrange(len(out))
        out[at : at + 1] = draw.choice([[], ["q"], [out[at], "q"]])
    return "".join(out)


def leaks(docs, rows, items):
    frame = docs(rows)
    bench = frame.sparkSession.createDataFrame(items, "item_id long, text string, k_id int")
    found = dc.find_contamination(frame, bench, Workspace(frame.sparkSession, "test"))
    return {(r.k_id, r.item_id): r.edits for r in found.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_against_full_alignment(docs, seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(draw.randrange(8, 26))[:150], 0) for i in range(12)]
    rows = []
    for i in range(40):
        body = prose(40)
        item = items[i % 12][1]
        planted = spoil(draw, item, draw.randrange(0, 2 + len(item) // 7))
        rows.append((i, f"{body} {planted} {prose(30)}"))
    got = leaks(docs, rows, items)
    for doc_id, text in rows:
        for item_id, item, _ in items:
            most = int(len(item) * dc.EDIT_SHARE)
            edits = edits_in(item.strip(), text)
            assert got.get((doc_id, item_id)) == (edits if edits <= most else None)


def test_band_edits_is_the_distance_in_the_region():
    draw = random.Random(9)
    for _ in range(50):
        piece = "".join(draw.choice("ab") for _ in range(40))
        region = "".join(draw.choice("ab") for _ in range(15)) + spoil(draw, piece, 3) + "abba"
        codes = [np.array([ord(c) for c in s], np.uint32) for s in (piece, region)]
        assert dc.band_edits(*codes, 8) == min(9, edits_in(piece, region))


@pytest.mark.parametrize("seed", range(2))
def test_spoiled_passages_at_the_ends_of_a_text(docs, seed):
    draw = random.Random(100 + seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(30)[: draw.choice([45, 60, 100, 150])].strip() + ".", 0) for i in range(12)]
    texts = []
    for _, item, _ in items:
        most = int(len(item) * dc.EDIT_SHARE)
        n = draw.randrange(1, most + 1)
        at = draw.randrange(10, len(item) - 10 - n)
        spoiled = [item[:-1], item[:-most], item[n:], item[:at] + item[at + n :], spoil(draw, item, n)]
        for part in spoiled:
            texts += [part, f"{part} {prose(30)}", f"{prose(30 + draw.randrange(30))} {part}"]
    rows = [(i, " ".join(text.split())) for i, text in enumerate(texts)]
    got = leaks(docs, rows, items)
    for doc_id, text in rows:
        item_id, item, _ = items[doc_id // 15]
        most = int(len(item) * dc.EDIT_SHARE)
        edits = edits_in(item, text)
        assert got.get((doc_id, item_id)) == (edits if edits <= most else None)


def test_parts_case_blanks_and_long_texts(docs):
    draw = random.Random(2)
    long = " ".join(f"word{draw.randrange(10**6)}" for _ in range(120))
    item = "The quick brown fox jumps over the lazy dog near the river bank today"
    rows = [
        (1, "x " * 50_000 + item.upper().replace(" ", " \n\t") + " y" * 50_000),
        (2, "before " + long[300:700] + " after"),
        (3, long[:100]),
        (4, item[:30]),
    ]
    assert set(leaks(docs, rows, [(1, item, 0), (2, long, 0)])) == {(1, 1), (2, 2)}


@pytest.mark.parametrize("seed", range(2))
def test_short_items_are_found_as_whole_words(docs, seed):
    draw = random.Random(20 + seed)
    word = lambda: "".join(draw.choice("abé1") for _ in range(draw.randrange(1, 4)))
    prose = lambda n: draw.choice([" ", ", ", "-"]).join(word() for _ in range(n))
    items = [(i, prose(draw.randrange(1, 8))[:31], 0) for i in range(40)] + [(99, " \n", 0), (3, "a", 0)]
    rows = [(i, draw.choice(["", " ", "("]) + prose(draw.randrange(0, 60)).upper()) for i in range(60)]
    rows += [(100 + i, f"{prose(9)} {items[i][1]}{draw.choice(['', '.', ' b', 'b'])}") for i in range(40)]
    got = leaks(docs, rows, items)
    expected = {}
    for doc_id, text in rows:
        low = " ".join(text.lower().split())
        for item_id, item, _ in items:
            item = item.strip()
            for at in range(len(low) if item else 0):
                end = at + len(item)
                left = at and low[at - 1].isalnum() and item[0].isalnum()
                right = end < len(low) and low[end].isalnum() and item[-1].isalnum()
                if low[at:end] == item and not left and not right:
                    expected[doc_id, item_id] = 0
    assert got == expected and len(got) > 60


def test_rough_rows(docs):
    item = "a passage of some words that is long enough to count"
    rows = [(1, None), (2, ""), (3, f"x {item} y"), (3, f"x {item} y"), (None, item), (5, "clean text")]
    items = [(7, item, 0), (8, item, 0), (None, item, 0), (9, None, 0), (10, "", 0), (11, "short", 0), (7, item, 0)]
    assert leaks(docs, rows, items) == {(d, i): 0 for d in (3, None) for i in (7, 8, -1)}
    frame = docs(rows)
    bench = frame.sparkSession.createDataFrame(items, "item_id long, text string, k_id int")
    kept = dc.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5]
    assert leaks(docs, [], items) == {} and leaks(docs, rows, []) == {}


def test_benchmark_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_BYTES", 100)
    items = [(i, f"item number {i} with a text of its own {i * 7919} and more {i}", 0) for i in range(9)]
    rows = [(i, f"some words {items[i][1]} other words") for i in range(9)]
    got = leaks(docs, rows, items)
    assert all(got[(i, i)] == 0 for i in range(9))
