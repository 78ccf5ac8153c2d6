"""What the URLs of the review jobs cost: canonical ones and plain ids are not parsed, ids are read by product."""

import pytest
from pyspark.sql import functions as F

from sitefold.functions.urls import canonicalize_url, extract_pid
from sitefold.plans import reviews
from sitefold.session import settle


def test_plain_urls_are_told_by_a_pattern(spark):
    """Canonical URLs skip the parse; all others are parsed as before."""
    same = ["https://a.example:80/x/p/itm1?pid=P1&page=2", "http://A.example", "https://a.example/?lid=x"]
    other = {
        "https://a.example/p?pid=1&pid=2": "https://a.example/p?pid=1",
        "https://a.example/p?pid=": "https://a.example/p",
        "https://a.example/p?iid=1&pid=2": "https://a.example/p?pid=2",
        "https://a.example/p;x?pid=1#f": "https://a.example/p?pid=1",
    }
    rows = spark.createDataFrame([(u,) for u in [*same, *other]], "u string")
    found = {r.u: r.c for r in rows.select("u", canonicalize_url(F.col("u")).alias("c")).collect()}
    assert found == {u: u for u in same} | other
    # ``pid`` left out by the caller's own rules is no plain key.
    own = rows.select(canonicalize_url(F.col("u"), ("pid",), ()).alias("c")).collect()
    assert [r.c for r in own if "pid" in r.c] == []


@pytest.mark.parametrize(
    "url, pid",
    [("https://a/p?pid=P.1&pid=2", "P.1"), ("https://a/p?x=1&pid=2", "2"), ("https://a/p?pid=a%20b", "a b"),
     ("https://a/p?pid=&pid=3", "3"), ("https://a/p?pids=4", "UNKNOWN")],
)
def test_id_of_a_url(one, url, pid):
    assert one(extract_pid(F.col("s")), url) == pid


def test_requested_job_reads_ids_by_product(spark, monkeypatch):
    """Pages carry no id before they meet their product, so it is read once for each product."""
    settled = {}

    def note(df, name):
        settled[name] = set(df.columns)
        return settle(df, name)

    monkeypatch.setattr(reviews, "settle", note)
    html = '<script type="application/ld+json">{"@type": "Review", "name": "n"}</script>'
    pages = spark.createDataFrame(
        [("https://a.example/x/product-reviews/i?pid=P1&page=1", 200, html)], "request_url string, status int, html string"
    )
    urls = spark.createDataFrame([(1, "https://a.example/x/p/i?iid=2&pid=P1")], "ordinal int, url string")
    rows = reviews.ingest_requested(pages, urls).reviews.collect()
    assert [(r.product_id, r.title) for r in rows] == [("P1", "n")]
    assert "product_id" in settled["request-manifest"] and "product_id" not in settled["review-lists"]
