import numpy as np
import pytest
from pyspark.sql import functions as F

from sitefold.llm import language_id as li
from sitefold.llm.frames import id_fold, table


@pytest.fixture(scope="module")
def pieces():
    return li.Pieces()


def test_forward_sums_all_segmentations(pieces):
    draw = np.random.default_rng(3)
    prob = draw.dirichlet(np.ones(pieces.size), 2).T
    words = ["▁the", "▁thing", "▁élan", "▁漢xq", "▁a", "▁there"]
    got = li.forward(pieces, prob, words)

    def ids(text):
        h = np.zeros(1, np.uint64)
        for c in text:
            h = pieces._step(h, np.array([ord(c)], np.uint64))
        found = int(pieces.lookup(h)[0])
        return pieces.unknown if found < 0 and len(text) == 1 else found

    def total(word, lang):
        if not word:
            return 1.0
        return sum(
            prob[ids(word[:n]), lang] * total(word[n:], lang)
            for n in range(1, min(16, len(word)) + 1)
            if ids(word[:n]) >= 0
        )

    for i, word in enumerate(words):
        for lang in range(2):
            assert got[i, lang] == pytest.approx(np.log(total(word, lang)))


def test_long_words_of_rare_characters_keep_their_order(pieces):
    prob = np.full((pieces.size, 4), 1e-6)
    prob[pieces.unknown] = [1e-7, 1e-8, 1e-9, 1e-12]
    word = "\U00012000" * 40
    got = li.forward(pieces, prob, [word])[0]
    assert got == pytest.approx(40 * np.log(prob[pieces.unknown]))
    used = li.expected_counts(pieces, prob[:, 3], [word], np.array([2.0]))
    assert used[pieces.unknown] == pytest.approx(80) and used.sum() == pytest.approx(80)


def test_numerals_are_no_letters():
    assert li.words_of("² ½ Ⅷ ①") == [] and li.words_of("m² x²y 漢字") == ["▁m", "▁x", "▁y", "▁漢字"]


def test_expected_counts_are_derivatives(pieces):
    """d log P(word) / d log p(piece) is the expected number of its uses."""
    draw = np.random.default_rng(4)
    prob = draw.dirichlet(np.ones(pieces.size))
    words, times = ["▁there", "▁then"], np.array([2.0, 1.0])
    got = li.expected_counts(pieces, prob, words, times)
    for piece in np.flatnonzero(got > 1e-3)[:10]:
        up = prob.copy()
        up[piece] *= 1 + 1e-6
        change = li.forward(pieces, up[:, None], words) - li.forward(pieces, prob[:, None], words)
        assert (change[:, 0] @ times) / 1e-6 == pytest.approx(got[piece], rel=1e-3)


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = li.fit(docs, id_fold(F.col("k_id"), 3) != 1, max_texts=40)
    told = li.identify(docs, model).where(id_fold(F.col("doc_id"), 3) == 1).collect()
    assert np.mean([r.lang == r.lang_pred for r in told]) > 0.97
    assert all(0 <= r.score <= 1 for r in told)


def test_rough_rows(docs):
    train = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "x", None), (4, None, "de")]
    model = li.fit(docs(train), F.lit(True))
    assert model.languages == ["en", "fr"]
    rows = [(1, None), (2, ""), (3, "12 _ ! ²"), (4, "the dog"), (4, "the dog"), (None, "le chien"), (6, "le " * 5000 + "x" * 20_000)]
    frame = docs(rows)
    told = li.identify(frame, model)
    assert told.columns == [c for c in frame.columns if c != "score"] + ["lang_pred", "score"]
    got = [(r.doc_id, r.lang_pred) for r in told.collect()]
    assert got[:3] == [(1, "und"), (2, "und"), (3, "und")]
    assert got[3] == got[4] == (4, "en") and got[5] == (None, "fr") and got[6][1] in ("en", "fr")
    assert li.identify(docs([]), model).count() == 0
    empty = li.fit(docs([]), F.lit(True))
    assert {(r.lang_pred, r.score) for r in li.identify(frame, empty).collect()} == {("und", 0.0)}
