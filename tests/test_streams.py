"""Key store, refusals and counters of the streams; filters before parsing; observed counters."""

import pytest
from pyspark.sql import functions as F

from checks import job_queries
from sitefold.operators import prefilter
from sitefold.operators.discover import traverse
from sitefold.operators.prefilter import key_bits, may_hold, only_wanted, surely_without
from sitefold.operators.refused import refused_inputs, review_page_reason
from sitefold.plans.metrics import catalog_metrics, observe_catalog, observe_reviews
from sitefold.plans.reviews import ingest_requested, ingest_reviews
from sitefold.session import new_path, settle
from sitefold.settings import CatalogOptions, ReviewOptions
from sitefold.sources.pages import stream_pages
from sitefold.streaming import jobs, keys
from sitefold.streaming.keys import KeyStore, key_prefix


def rows_of(spark, names):
    return settle(spark.createDataFrame([(n,) for n in names], "product_id string"), "rows")


def seen(store, rows, query, batch):
    found = store.seen(rows, query, batch)
    return set() if found is None else {r.product_id for r in found.collect()}


def test_store_reads_only_touched_prefixes(spark):
    store = KeyStore(spark, new_path(spark, "target"), "product_id")
    store.add(rows_of(spark, [f"P{i}" for i in range(500)] + [None]), "q", 0)
    some = rows_of(spark, ["P7", "new", None])
    found = store.seen(some, "q", 1)
    prefixes = {r[0] for r in some.select(key_prefix(F.col("product_id"))).collect() if r[0]}
    assert len(prefixes) == 2
    # The filter names the prefixes and is one on partition folders.
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert all(p in filters for p in prefixes)
    files = {r[0] for r in found.select(F.col("_metadata.file_path")).collect()}
    assert files and all(any(f"prefix={p}/" in f for p in prefixes) for f in files)
    assert seen(store, some, "q", 1) >= {"P7"}


def test_store_passes_over_its_own_batch_and_compacts(spark, monkeypatch):
    monkeypatch.setattr(keys, "COMPACT_AFTER", 3)
    target = new_path(spark, "target")
    store = KeyStore(spark, target, "product_id")
    every = rows_of(spark, [f"P{i}" for i in range(12)])
    for batch in range(6):
        new = rows_of(spark, [f"P{2 * batch}", f"P{2 * batch + 1}"])
        assert not seen(store, new, "q", batch) & {f"P{2 * batch}", f"P{2 * batch + 1}"}
        store.add(new, "q", batch)
        store.add(new, "q", batch)  # the batch runs again
    assert seen(store, every, "q", 6) == {f"P{i}" for i in range(12)}
    assert seen(store, every, "q", 5) == {f"P{i}" for i in range(10)}
    assert len(store._ids(f"{store.folder}/query_id=q")) <= 4
    # A run that ended before the old folders were removed.
    store._write(rows_of(spark, ["P0"]), "q", 1)
    store.compact("q", 5)
    assert seen(store, every, "q", 6) == {f"P{i}" for i in range(12)}
    assert seen(store, every, "other", 0) == {f"P{i}" for i in range(12)}


def test_store_takes_over_an_older_target(spark):
    target = new_path(spark, "target")
    rows_of(spark, ["A", "B"]).write.parquet(f"{target}/query_id=x/batch_id=0")
    assert seen(KeyStore(spark, target, "product_id"), rows_of(spark, ["A", "C"]), "q", 0) == {"A"}


PAGE = "ordinal long, request_url string, status int, html string"


def test_stream_records_refusals_and_counts(spark):
    bad = '<script type="application/ld+json">{"a</script>'
    rows = [(1, "u1", None, "x"), (2, "u2", 404, "x"), (3, "u3", 200, None), (4, "u4", 200, bad), (5, "u5", 200, "x")]
    source, target = new_path(spark, "in"), new_path(spark, "out")
    spark.createDataFrame(rows, PAGE).coalesce(1).write.parquet(source)
    stream = jobs.catalog_stream(
        stream_pages(spark, source, spark.createDataFrame([], PAGE).schema), target, new_path(spark, "state")
    )
    stream.awaitTermination()
    found = {(r.source, r.part, r.reason) for r in jobs.read_refused(spark, target).collect()}
    assert found == {("u1", None, "no response"), ("u2", None, "status 404"), ("u3", None, "no text"), ("u4", 0, "not JSON")}
    counts = jobs.read_counts(spark, target).select("landed", "refused", "written").collect()
    # The two pages that are read hold no phone.
    assert [tuple(c) for c in counts] == [(5, 3, 0)]


def test_bit_array_passes_all_wanted_and_few_others(spark):
    every = spark.range(20_000).select(F.concat(F.lit("https://h/"), "id").alias("url"))
    wanted = settle(every.where("url LIKE '%7'"), "wanted")
    bits = settle(key_bits(wanted, F.col("url"), words=1024), "bits")
    assert bits.count() <= 1024
    passed = may_hold(every, F.col("url"), bits, words=1024)
    assert passed.join(wanted, "url").count() == 2000
    assert 2000 <= passed.count() < 2000 + 18_000 * 0.05
    assert surely_without(every, F.col("url"), bits, words=1024).count() == 20_000 - passed.count()
    nothing = settle(key_bits(wanted.limit(0), F.col("url")), "bits")
    assert may_hold(every, F.col("url"), nothing).count() == 0


def test_long_lists_give_the_same_rows_with_few_pages_parsed(spark, monkeypatch):
    review = '<script type="application/ld+json">{"@type": "Review", "name": "t%d", "reviewBody": "b"}</script>'
    pages = spark.createDataFrame(
        [(f"https://h.com/p/itm{i}?pid=M{i}", 1, 200, review % i) for i in range(300)],
        "product_url string, page_no int, status int, html string",
    )
    urls = spark.createDataFrame([(i, f"https://h.com/p/itm{i}?pid=M{i}") for i in range(0, 300, 10)], "ordinal long, url string")
    small = sorted(ingest_reviews(pages, ReviewOptions(), urls=urls).reviews.drop("scraped_at").collect())
    monkeypatch.setattr(prefilter, "is_small", lambda *a: False)
    large = sorted(ingest_reviews(pages, ReviewOptions(), urls=urls).reviews.drop("scraped_at").collect())
    assert small == large and len(small) == 30
    listed = settle(urls.select(F.col("url").alias("product_url")), "listed")
    assert only_wanted(pages, F.col("product_url"), listed, "product_url").count() <= 33


def test_traversal_parses_reached_pages_only(spark):
    def page(i, links):
        html = "".join(f'<a href="/mobile-phone/p/itm{k}">x</a>' for k in links)
        url = f"https://www.shop.example/mobile-phone/p/itm{i}"
        return (url, url, 200, html)

    pages = [page(0, [1, 2]), page(1, [3]), page(2, [0, 3]), page(3, [4])] + [page(i, [i + 1]) for i in range(50, 90)]
    frame = spark.createDataFrame(pages, "request_url string, final_url string, status int, html string")
    seeds = spark.createDataFrame([(0, pages[0][0])], "ordinal long, url string")
    options = CatalogOptions(domain="shop.example", loose_url_filter=True)
    run = traverse(frame, seeds, options)
    assert run.pages_parsed == (1, 2, 1, 0)
    names = [r.product_url.rsplit("itm", 1)[1] for r in run.candidates.orderBy("ordinal").collect()]
    assert names == ["0", "1", "2", "3", "4"]


def test_requests_that_never_landed(spark):
    review = '<script type="application/ld+json">{"@type": "Review", "name": "t%d", "reviewBody": "b"}</script>'
    base = "https://h.com/a/product-reviews/itm1?pid=M1"
    pages = spark.createDataFrame(
        [(f"{base}&page=1", 200, review % 1), (f"{base}&page=2", 200, review % 2), ("https://h.com/x", 200, review % 3)],
        "request_url string, status int, html string",
    )
    urls = spark.createDataFrame(
        [(1, "https://h.com/a/p/itm1?pid=M1"), (2, "https://h.com/a/p/itm2?pid=M2")], "ordinal long, url string"
    )

    def outcome(max_pages):
        run = ingest_requested(pages, urls, ReviewOptions(max_pages=max_pages))
        rows = run.products.select("product_id", "last_page", "outcome").collect()
        return run.reviews.count(), {r.product_id: (r.last_page, r.outcome) for r in rows}

    assert outcome(2) == (2, {"M1": (2, "done"), "M2": (0, "failed")})
    assert outcome(None) == (2, {"M1": (2, "failed"), "M2": (0, "failed")})


def test_observed_counters_equal_the_counted_ones(spark):
    rows = [("written",), ("written",), ("blocked",), ("failed",), ("duplicate",)]
    outcomes = spark.createDataFrame(rows, "outcome string")
    observed, run = observe_catalog(outcomes)
    observed.write.parquet(new_path(spark, "observed"))
    assert run.get == catalog_metrics(outcomes).first().asDict()
    observed, run = observe_reviews(outcomes)
    observed.write.parquet(new_path(spark, "observed"))
    assert run.get == {"total_reviews": 5}


@pytest.mark.parametrize("reason", [review_page_reason])
def test_refusals_of_review_pages(spark, reason):
    rows = [("u1", 500, "x"), ("u2", 200, "x"), ("u3", None, None)]
    pages = spark.createDataFrame(rows, "request_url string, status int, html string")
    found = {(r.source, r.reason) for r in refused_inputs(pages, reason).collect()}
    assert found == {("u1", "status 500"), ("u3", "no response")}
    assert refused_inputs(pages.limit(0), reason).count() == 0


def test_stream_batches_have_a_file_for_each_core(spark, monkeypatch):
    """Pages land as three batches; two files to a batch left most cores idle."""
    cores, batches = spark.sparkContext.defaultParallelism, []
    pages = spark.range(4000).selectExpr("id AS ordinal", "'u' AS request_url")

    def noted(session, path, schema, maxFilesPerTrigger):
        files = session.read.parquet(path).inputFiles()
        batches.append((len(files), int(maxFilesPerTrigger)))
        return stream_pages(session, path, schema, maxFilesPerTrigger=maxFilesPerTrigger)

    def copy(stream, target, checkpoint):
        writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start(target)

    monkeypatch.setattr(job_queries, "stream_pages", noted)
    written = job_queries._run_stream(spark, pages, copy, "stream-files")
    assert written.distinct().count() == written.count() == 4000
    for files, at_once in batches:
        assert at_once >= cores and files >= 2 * at_once
