import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside; they must not disturb them.
CLASHING = ", k_id string, k_hash string, score string, shard string, slot string, node string, words int"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) tuples, with clashing further columns."""

    def make(rows, clash=True):
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, *["en", "s"][len(row) - 2 :])
            extra = ("a", "b", "c", "d", "e", "f", 7) if clash else ()
            full.append((doc_id, text, lang, source, len(text or ""), *extra))
        return spark.createDataFrame(full, DOCS + (CLASHING if clash else ""))

    return make


@pytest.fixture
def sf():
    return "/root/testdata/sf0.001"
