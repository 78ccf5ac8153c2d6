"""Sources, sinks and the two jobs."""

import gzip
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks import job_queries
from sitefold.operators.requests import search_requests
from sitefold.plans.catalog import export_catalog
from sitefold.plans.metrics import catalog_metrics, review_totals
from sitefold.plans.reviews import ingest_reviews
from sitefold.settings import CATALOG_COLUMNS, REVIEW_COLUMNS, CatalogOptions, ReviewOptions
from sitefold.sources import seen, sinks, sitemaps, url_lists
from sitefold.sources.staged import StagedAppend

PAGES = "product_url string, page_no int, status int, html string"


def page(*names):
    reviews = [{"@type": "Review", "name": n, "reviewBody": n} for n in names]
    return f'<script type="application/ld+json">{json.dumps(reviews)}</script>' if names else "<p>"


def review_pages(spark):
    a, b, c = (f"https://h.com/x/p/i?pid={k}" for k in "ABC")
    return spark.createDataFrame(
        [
            (a + "&iid=1", 1, 200, page("r1", "r2", "r1")),
            (a, 2, 200, page("r2", "r3")),
            (a, 3, 200, page()),
            (a, 4, 200, page("late")),
            (b, 1, 200, page("r1")),
            (b, 2, 503, None),
            (b, 3, 200, page("after")),
            (c, 1, 404, ""),
        ],
        PAGES,
    )


def written(run):
    rows = run.reviews.orderBy("product_id", "review_page", "title").collect()
    return [(r.product_id, r.review_page, r.title) for r in rows]


def test_review_job(spark):
    run = ingest_reviews(review_pages(spark))
    assert run.reviews.columns == list(REVIEW_COLUMNS)
    assert written(run) == [("A", 1, "r1"), ("A", 1, "r2"), ("A", 2, "r3"), ("B", 1, "r1")]
    ends = {r.product_id: (r.last_page, r.outcome) for r in run.products.collect()}
    assert ends == {"A": (3, "done"), "B": (1, "failed"), "C": (0, "failed")}
    totals = review_totals(run.reviews, run.products).first()
    assert (totals.total_reviews, totals.failed_products) == (4, 2)


def test_second_run_adds_nothing(spark, tmp_path):
    first = ingest_reviews(review_pages(spark))
    sinks.write_reviews(first.reviews, str(tmp_path), "jsonl")
    known = seen.read_seen_hashes(spark, f"{tmp_path}/jsonl")
    assert known.count() == 4
    second = ingest_reviews(review_pages(spark), seen=known)
    assert written(second) == []


def test_known_pages_are_stale(spark):
    """Two pages of known reviews end the product before the new one."""
    url = "https://h.com/x/p/i?pid=A"
    pages = spark.createDataFrame(
        [(url, i, 200, page(f"r{i}")) for i in (1, 2, 3)], PAGES
    )
    known = ingest_reviews(pages.filter("page_no < 3")).reviews.select("review_id_hash")
    assert written(ingest_reviews(pages, seen=known)) == []
    options = ReviewOptions(seen_stop_threshold=3)
    assert written(ingest_reviews(pages, options, known)) == [("A", 3, "r3")]


def test_fail_fast(spark):
    with pytest.raises(RuntimeError):
        ingest_reviews(review_pages(spark), ReviewOptions(fail_fast=True))


def test_urls_with_one_id_share_their_reviews(spark):
    pages = spark.createDataFrame(
        [("https://h.com/a", 1, 200, page("same")), ("https://h.com/b", 1, 200, page("same", "b"))],
        PAGES,
    )
    assert written(ingest_reviews(pages)) == [("UNKNOWN", 1, "b"), ("UNKNOWN", 1, "same")]


def test_sinks(spark, tmp_path):
    reviews = ingest_reviews(review_pages(spark)).reviews.withColumn("title", F.lit('é "q"'))
    sinks.write_reviews(reviews, str(tmp_path), "both", per_product=True)
    line = (next((tmp_path / "jsonl" / "safe_product_id=B").glob("*.json"))).read_text()
    assert list(json.loads(line)) == list(REVIEW_COLUMNS)
    assert line.isascii() and json.loads(line)["rating"] is None
    text = next((tmp_path / "csv" / "safe_product_id=B").glob("*.csv")).read_bytes().decode()
    assert text.startswith(",".join(REVIEW_COLUMNS) + "\r\n") and '"é ""q"""' in text
    with pytest.raises(ValueError):
        sinks.write_reviews(reviews, str(tmp_path), "xml")
    sinks.write_reviews(reviews.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def product_page(name, category, url=None):
    data = {"@type": "Product", "name": name, "category": category}
    link = f'<link rel="canonical" href="{url}">' if url else ""
    return f'{link}<script type="application/ld+json">{json.dumps(data)}</script>'


WALL = "<p>reCAPTCHA</p><p>Are you a human?</p>"


def catalog_frames(spark):
    urls = [f"https://h.com/m/p/i{i}" for i in range(9)]
    html = [
        product_page("Case", "Covers", urls[2]), product_page("A", "Mobiles"),
        product_page("B", "Mobiles"), product_page("B2", "Mobiles", urls[2]), WALL, WALL, "", None,
        product_page("Last", "Mobiles"),
    ]
    status = [200, 200, 500, 200, 403, 200, 404, None, 200]
    pages = spark.createDataFrame(
        list(zip(urls, status, html)), "request_url string, status int, html string"
    )
    candidates = spark.createDataFrame(
        [(i, u, "map", f"d{i}") for i, u in enumerate(urls)],
        "ordinal long, product_url string, source_sitemap string, sitemap_lastmod string",
    )
    return candidates, pages


def test_catalog_job(spark):
    run = export_catalog(*catalog_frames(spark), CatalogOptions(domain="h.com"))
    rows = run.catalog.orderBy("ordinal").collect()
    assert run.catalog.columns == ["ordinal", *CATALOG_COLUMNS]
    assert [(r.product_id, r.title) for r in rows] == [("i1", "A"), ("i2", "B"), ("i8", "Last")]
    assert [r.sitemap_lastmod for r in rows] == ["d1", "d2", "d8"]
    found = [r.outcome for r in run.outcomes.orderBy("ordinal").collect()]
    assert found == ["non_mobile", "written", "written", "duplicate", "blocked", "non_mobile",
                     "gone", "failed", "written"]
    assert tuple(catalog_metrics(run.outcomes).first()) == (9, 3, 2, 1, 1)


def test_catalog_limit_and_resume(spark):
    candidates, pages = catalog_frames(spark)
    known = spark.createDataFrame([("i1",)], "product_id string")
    options = CatalogOptions(domain="h.com", max_products=1)
    run = export_catalog(candidates, pages, options, known)
    assert [r.product_id for r in run.catalog.collect()] == ["i2"]
    assert tuple(catalog_metrics(run.outcomes).first()) == (3, 1, 1, 0, 0)
    options = CatalogOptions(domain="h.com", include_accessories=True)
    run = export_catalog(candidates, pages, options)
    first = run.catalog.orderBy("ordinal").first()
    assert (first.product_id, first.title) == ("i2", "Case")


def test_url_list_files(spark, tmp_path):
    text = tmp_path / "a.txt"
    text.write_text("# https://h.com/1\nsee https://h.com/2) and\nplain\n")
    got = url_lists.read_url_list(spark, str(text)).orderBy("ordinal").collect()
    assert [r.url for r in got] == ["https://h.com/1", "https://h.com/2)"]
    text = tmp_path / "b.txt"
    text.write_text("# note\n\n h.com/1 \r\nh.com/2\n")
    got = url_lists.read_url_list(spark, str(text)).orderBy("ordinal").collect()
    assert [r.url for r in got] == ["h.com/1", "h.com/2"]
    assert [r.url for r in url_lists.read_seeds(spark, str(text)).orderBy("ordinal").collect()] == [
        "h.com/1", "h.com/2"
    ]
    table = tmp_path / "c.csv"
    table.write_text('product_url,url\nx," h.com/1 "\ny,\nz,h.com/2\n')
    got = url_lists.read_url_list(spark, str(table)).orderBy("ordinal").collect()
    assert [r.url for r in got] == ["h.com/1", "h.com/2"]
    table.write_text("link\nx\n")
    with pytest.raises(ValueError):
        url_lists.read_url_list(spark, str(table))
    blob = tmp_path / "d.json"
    blob.write_text('[" h.com/1", 5, "", null]')
    got = url_lists.read_url_list(spark, str(blob)).orderBy("ordinal").collect()
    assert [r.url for r in got] == ["h.com/1", "5", "None"]
    blob.write_text('{"a": 1}')
    with pytest.raises(Exception, match="array of URLs"):
        url_lists.read_url_list(spark, str(blob)).collect()


def test_missing_seen_files(spark, tmp_path):
    assert seen.read_seen_hashes(spark, f"{tmp_path}/no").count() == 0
    assert seen.read_seen_ids(spark, f"{tmp_path}/no").count() == 0


def test_sitemaps(spark, tmp_path):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    good = f"<sitemapindex {ns}><sitemap><loc> a.xml </loc></sitemap><sitemap/></sitemapindex>"
    (tmp_path / "a.xml").write_text(good)
    with gzip.open(tmp_path / "b.xml.gz", "wt") as file:
        file.write(good.replace("a.xml", "b.xml").replace("</loc>", "</loc><lastmod>d</lastmod>"))
    (tmp_path / "c.xml").write_text("<sitemapindex><sitemap><loc>bad")
    documents = sitemaps.read_xml_files(spark, str(tmp_path))
    rows = sitemaps.sitemap_index(documents).orderBy("loc").collect()
    assert [(r.loc, r.lastmod) for r in rows] == [("a.xml", ""), ("b.xml", "d")]
    entries = sitemaps.read_index_entries(spark, f"{tmp_path}/[ab]*").orderBy("loc").collect()
    assert [(r.loc, r.lastmod) for r in entries] == [("a.xml", ""), ("b.xml", "d")]


def test_search_requests(spark):
    searches = spark.createDataFrame([("h.com/s?q=a&page=9&b=",)], "search_url string")
    got = search_requests(searches, 2).orderBy("page_no").collect()
    assert [r.request_url for r in got] == [
        "https:h.com/s?q=a&page=1".replace("https:h", "https:h"), "https:h.com/s?q=a&page=2"
    ]


def test_missing_and_repeated_review_pages(spark):
    url = "https://h.com/x/p/i?pid=G"
    rows = [(url, 1, 200, page("r1")), (url, 2, 200, page("r2")), (url, 2, 503, None), (url, 4, 200, page("r4"))]
    run = ingest_reviews(spark.createDataFrame(rows, PAGES))
    assert written(run) == [("G", 1, "r1"), ("G", 2, "r2")]
    assert [(r.last_page, r.outcome) for r in run.products.collect()] == [(2, "failed")]


def test_seen_hashes_of_csv_targets(spark, tmp_path):
    run = ingest_reviews(review_pages(spark))
    sinks.write_reviews(run.reviews, str(tmp_path), "csv")
    known = seen.read_seen_hashes_csv(spark, f"{tmp_path}/csv")
    assert written(ingest_reviews(review_pages(spark), seen=known)) == []


def test_prefixed_sitemap(spark):
    xml = (
        '<s:urlset xmlns:s="u" xmlns:image="i"><s:url><s:loc>http://a/1</s:loc>'
        "<image:image><image:loc>http://a/no</image:loc></image:image></s:url></s:urlset>"
    )
    docs = spark.createDataFrame([(1, xml), (2, "<broken"), (3, ""), (4, None)], "id int, xml string")
    assert [(r.id, r.loc) for r in sitemaps.sitemap_urls(docs).collect()] == [(1, "http://a/1")]


def test_review_job_from_a_url_list(spark):
    """Listed products without pages failed, unlisted pages are not read, input order decides ties."""
    url = "https://h.com/{}/p/i?pid=L"
    first, second, absent = url.format("z"), url.format("a"), "https://h.com/x/p/i?pid=M"
    pages = spark.createDataFrame(
        [(first, 1, 200, page("r1")), (second, 1, 200, page("r1", "r2")), ("https://h.com/x/p/i?pid=N", 1, 200, page("n"))],
        PAGES,
    )
    urls = spark.createDataFrame([(0, first), (1, absent), (2, second), (3, first)], "ordinal long, url string")
    run = ingest_reviews(pages, urls=urls)
    got = {(r.product_url.split("/")[3], r.title) for r in run.reviews.collect()}
    assert got == {("z", "r1"), ("a", "r2")}
    assert {(r.product_id, r.outcome) for r in run.products.collect()} == {("L", "done"), ("M", "failed")}


def test_repeated_run_appends_once(spark, tmp_path, monkeypatch):
    schema = "product_id string, title string"
    rows = spark.createDataFrame([(f"p{i}", f"t{i}") for i in range(40)], schema).repartition(4)
    target = str(tmp_path / "out")
    moved, move = [], StagedAppend._move

    def break_off(self, source, place):
        if len(moved) == 3:
            raise InterruptedError
        moved.append(place.toString())
        move(self, source, place)

    monkeypatch.setattr(StagedAppend, "_move", break_off)
    with pytest.raises(InterruptedError):
        sinks.write_reviews(rows, target, "both", run_id="r1")
    assert len(moved) == 3
    monkeypatch.setattr(StagedAppend, "_move", move)
    # The repeated run may find nothing new, and must still finish what it had staged.
    sinks.write_reviews(rows.limit(0), target, "both", run_id="r1")
    sinks.write_reviews(rows, target, "both", run_id="r1")
    for found in (spark.read.json(f"{target}/jsonl"), spark.read.csv(f"{target}/csv", header=True)):
        assert sorted(r.product_id for r in found.collect()) == sorted(f"p{i}" for i in range(40))
    sinks.write_reviews(rows.limit(1), target, "both", run_id="r2")
    assert spark.read.json(f"{target}/jsonl").count() == 41
    products = str(tmp_path / "products")
    for run_id in ("r1", "r1", "r2"):
        sinks.write_reviews(rows, products, "jsonl", per_product=True, run_id=run_id)
    found = spark.read.json(f"{products}/jsonl").groupBy("safe_product_id").count().collect()
    assert sorted(tuple(r) for r in found) == sorted((f"p{i}", 2) for i in range(40))
    for _ in range(2):
        sinks.write_catalog(rows, str(tmp_path / "catalog"), run_id="r1")
    assert spark.read.csv(str(tmp_path / "catalog"), header=True).count() == 40
    for bad in ("", "_x", "a/b", "../x"):
        with pytest.raises(ValueError):
            sinks.write_reviews(rows, target, run_id=bad)


def test_places_of_entries_in_several_files(spark, tmp_path):
    for name, n in (("b.xml", 50), ("a.xml", 300)):
        entries = "".join(f"<url><loc> u{i} </loc></url><url/>" for i in range(n))
        (tmp_path / name).write_text(f"<urlset>{entries}</urlset>")
    rows = sitemaps.read_url_entries(spark, f"{tmp_path}/*.xml").collect()
    got = sorted((r.file.rsplit("/", 1)[-1], r.url_ord, r.loc) for r in rows)
    assert got == [(f, 2 * i, f"u{i}") for f, n in (("a.xml", 300), ("b.xml", 50)) for i in range(n)]


def test_csv_lists_are_in_file_order(spark, tmp_path):
    for name, n in (("b.csv", 400), ("a.csv", 3), ("c.csv", 90)):
        (tmp_path / name).write_text("url\n" + "\n".join(f"{name}/{i}" for i in range(n)))
    rows = url_lists.read_url_csv(spark, f"{tmp_path}/*.csv").orderBy("ordinal").collect()
    sizes = (("a.csv", 3), ("b.csv", 400), ("c.csv", 90))
    assert [r.url for r in rows] == [f"{f}/{i}" for f, n in sizes for i in range(n)]


def test_url_lists_of_many_pages_share_files(spark, tmp_path, monkeypatch):
    n = 5000
    pages = spark.range(n).selectExpr("id AS page_id", "concat('https://h.com/', id % 100) AS url")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    folders = []
    read = url_lists.read_url_json

    def noted(session, path):
        folders.append(path)
        return read(session, path)

    monkeypatch.setattr(url_lists, "read_url_json", noted)
    urls = job_queries.read_url_json(spark, str(tmp_path)).groupBy("url").count().collect()
    assert {r.url: r["count"] for r in urls if not r.url.isdigit()} == {f"https://h.com/{i}": n // 100 for i in range(100)}
    assert {r.url for r in urls if r.url.isdigit()} == {str(i) for i in range(n)}
    # One list per task and thousand pages; a file for each page before.
    files = list(Path(folders[0].removeprefix("file:")).rglob("part-*"))
    assert len(files) <= n / 1000 + 2 * spark.sparkContext.defaultParallelism
