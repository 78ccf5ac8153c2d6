"""What a page costs: steps of a page are not repeated, and the results stay those of the plain forms."""

import pytest
from pyspark.sql import functions as F

from sitefold.functions import jsonld as J
from sitefold.functions.text import strip
from sitefold.functions.urls import to_review_url
from sitefold.operators import parse_pages as P
from sitefold.operators.requests import review_base


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_review_url_reads_its_query_once(spark):
    urls = spark.createDataFrame([("https://a.example/x/p/itm1?iid=7&pid=P1",)], "url string")
    plan = _plan(urls.select(review_base(F.col("url"))))
    assert plan.count("array_position") <= 2


@pytest.mark.parametrize(
    "url, found",
    [
        ("a.example/x/p/ABCDEFGHIJ1?lid=%41+b~*&x=1", "lid=A+b~%2A&pid=ABCDEFGHIJ1&page=2"),
        ("https://a.example/x/p/ABCDEFGHIJ1?pid=UNKNOWN&page=9", "pid=UNKNOWN&page=2"),
        ("https://a.example/x/p/i?p%69d=a%zz&page=1&lid==c", "pid=a%25zz&page=2&lid=%3Dc"),
        ("https://a.example/x/p/i?lid=%C3%A9", "lid=%C3%A9&page=2"),
        ("https://a.example/x/p/i", "page=2"),
    ],
)
def test_review_url(one, url, found):
    full = one(to_review_url(F.col("s"), F.lit(2)), url)
    assert full.startswith("https://a.example/x/product-reviews/") and full.split("?")[1] == found


def test_strip_at_the_ends_alone(one):
    assert one(strip(F.col("s")), " \x1c a\n\x1fb\U0001f600  \n") == "a\n\x1fb\U0001f600"
    assert one(strip(F.col("s")), " \n\x1d") == "" and one(strip(F.col("s")), "") == ""
    assert one(strip(F.col("s"))) is None


def test_script_ends_at_its_first_end_tag(spark):
    tag = '<script type="application/ld+json">'
    html = f'<p>{tag}{{"a": "</scripty> < <b"}}</SCRIPT ><!-- {tag}2</script> -->{tag} 3 </b></script x>'
    rows = spark.createDataFrame([(html,)], "html string").selectExpr(f"inline(array({P.P.struct(t=P.P.jsonld_texts('html'))}))")
    assert rows.first().t == ['{"a": "</scripty> < <b"}', "3 </b></script x>"]


def test_review_lists_copy_few_rows(spark):
    pages = spark.createDataFrame([(1, "<p>")], "id long, html string")
    assert _plan(P.review_lists(pages)).count("Generate inline") <= 10


def test_objects_in_document_order(spark):
    text = '[{"z": {"n": 1}, "a": [[{"n": 2}], "{}", null]}, 5, {}]'
    rows = spark.createDataFrame([(text,)], "t string")
    docs = f"transform(filter(array({J.parse_items('t')}), x -> size(x) = 1), x -> get(x, 0))"
    found = J.all_objects(docs, J.nesting("t"))
    paths = rows.selectExpr(f"transform({found}, n -> n.path) AS p").first().p
    assert sorted(paths) == [[0, 0], [0, 0, 0], [0, 0, 1, 0, 0], [0, 2]]


def test_bad_text_hides_no_later_review(spark):
    """Brackets that a bad text closes but never opened do not count against the next text."""
    texts = ("}}} Review", '{"a": [[{"@type": ["Review"], "name": "n", "author": {"name": "NaN"}}]]}')
    html = "".join(f'<script type="application/ld+json">{t}</script>' for t in texts)
    row = P.jsonld_reviews(spark.createDataFrame([(1, html)], "id long, html string")).first()
    assert (row.title, row.reviewer) == ("n", "NaN")


@pytest.mark.parametrize(
    "text, depth",
    [("5", 1), ("{}", 1), ('["]]", {}, {"[": "{"}]', 2), ('{"a": [{"b": []}, {}]}', 4), ("[{}, [[{}]], {}]", 4)],
)
def test_depth_is_exact(spark, text, depth):
    row = spark.createDataFrame([(text,)], "t string").selectExpr(f"greatest({J.nesting('t')}, 1) AS d").first()
    assert row.d == depth


@pytest.mark.parametrize(
    "tag", ['<script type="application/ld+json">', "<SCRIPT id=a TYPE='application/ld&#43;json' >"]
)
@pytest.mark.parametrize("end", ["</script>", "</SCRIPT >", ""])
def test_script_text_in_any_spelling(spark, tag, end):
    html = f'<style>a</style>{tag} \n{{"a": "</script x"}}\t{end}'
    rows = spark.createDataFrame([(html,)], "html string").selectExpr(f"inline(array({P.P.struct(t=P.P.jsonld_texts('html'))}))")
    assert rows.first().t == ['{"a": "</script x"}']


def test_attributes_are_read_on_request(spark):
    found = P.elements(spark.createDataFrame([(1, "<p id=a>")], "id long, html string"))
    assert "map_from_entries" not in _plan(found.select("id", "tag", "node_id", "end_id", "parent_id"))
    assert [r.attrs for r in found.select("attrs").collect()] == [{"id": "a"}]


def test_large_pages_count_places_without_a_row_for_each(spark, tmp_path):
    """No expanded rows and no distinct places before the shuffle, and texts of one id count as one."""
    from checks import QUERIES

    texts = [(1, "a b " * 300), (1, "a b"), (None, "c"), (None, ""), (2, None), (3, "<>& A"), (4, "d " * 65)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["large_pages"](spark, str(tmp_path))
    assert "Expand" not in _plan(found)
    n = {1: 600, None: 1, 4: 65}
    # Ends of equal doc_id: those of the long text and of the short one differ.
    want = {(k, m + 2 * (k == 1), m + 2 * (k == 1), 1 + (k == 1), m) for k, m in n.items()}
    assert {tuple(r) for r in found.collect()} == want


def test_few_and_many_different_tags(spark):
    """Tags are read once for each different one or once for each token: the same elements."""
    names = [f"x{i}" for i in range(20)]
    part = "".join(f"<{n}>a</{n.upper()} ></p></{n}><br/><{n} /><a=x /> <1 <BR><!-- <p> -->" for n in names)
    other = "<style>p</style><td id=1>" * 3 + "<script>x</script></td>"
    rows = []
    for html in (part + other, part[: len(part) // 20] + other):
        frame = spark.createDataFrame([(html,)], "html string")
        steps = P.staged(frame, _toks=P.M.tokens("html"))
        few = P._with_spans(steps).selectExpr("size(_seen) AS n", f"{P.M.span()} AS found").first()
        each = steps.selectExpr(f"{P.M.spans(P.M.tags('_toks'), 'size(_toks)')} AS found").first()
        assert few.found == each.found and few.found
        rows.append(few.n > P.M._FEW_TAGS)
    assert rows == [True, False]
