"""Page operators: tree against the standard HTML parser, JSON-LD, blocks, products."""

import json
import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from sitefold.functions import jsonld as J
from sitefold.functions import markup as M
from sitefold.operators import parse_pages as P


class PlainTree(HTMLParser):
    """Elements with their text, by a stack of open tags."""

    def __init__(self):
        super().__init__()
        self.stack, self.found = [], []

    def add(self, tag, attrs):
        self.found.append({"tag": tag, "attrs": dict(attrs), "text": []})
        return self.found[-1]

    def handle_starttag(self, tag, attrs):
        element = self.add(tag, attrs)
        if tag not in M.VOID_TAGS:
            self.stack.append(element)

    def handle_startendtag(self, tag, attrs):
        self.add(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in M.VOID_TAGS and any(e["tag"] == tag for e in self.stack):
            while self.stack.pop()["tag"] != tag:
                pass

    def handle_data(self, data):
        if not (self.stack and self.stack[-1]["tag"] in M.RAW_TAGS):
            for element in self.stack:
                element["text"].append(data)


TAGS = [
    "<div>", "</div>", "<div class='a b'>", "<DIV class=a>", "<p>", "</p>", "<br>", "<br/>",
    "</br>", '<span id="x>y" id=\'z\'>', "</span>", "text ", "a < b ", "&amp; ", "&#39;", "&#x41;",
    "<!-- <div> -->", "<script>var t='</p><div>';</script>", "<style>p{}</style>",
    "<img src=x/>", "<a href='/p/1' title=\"href=q\">", "</a>", "é", "<h1/>",
]


def squeezed(parts):
    return "".join("".join(parts).split())


def test_elements_against_standard_parser(spark):
    rng = random.Random(5)
    pages = ["".join(rng.choice(TAGS) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    # Long enough for several folding steps.
    pages.append("".join(rng.choice(TAGS) for _ in range(2000)))
    frame = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    found = P.elements(frame).orderBy("i", "node_id").collect()
    runs = frame.selectExpr("i", f"{M.tokens('html')} AS t").selectExpr(
        "i", f"{M.text_runs('t')} AS runs"
    )
    texts = {r.i: r.runs for r in runs.collect()}
    got = {i: [] for i in range(len(pages))}
    for r in found:
        text = [t for t in texts[r.i][r.node_id + 1 : r.end_id] if t is not None]
        got[r.i].append((r.tag, r.attrs, squeezed(text)))
    for i, page in enumerate(pages):
        tree = PlainTree()
        tree.feed(page)
        tree.close()
        want = [
            (e["tag"], {k: v or "" for k, v in e["attrs"].items()}, squeezed(e["text"]))
            for e in tree.found
        ]
        assert got[i] == want, page


def test_entities(one):
    text = "a &amp;lt; &#38;lt; &rsquo;&eacute;&nbsp;&hellip; AT&T &copy 1 &#x1F600; &#0; &no; &"
    want = "a &lt; &lt; ’é\xa0… AT&T © 1 😀 � &no; &"
    assert one(F.expr(M.unescape("s")), text) == want


def test_parents(spark):
    frame = spark.createDataFrame([("<ul><li>a<li>b</ul><p>",)], "html string")
    rows = P.elements(frame).select("tag", "parent_id", "node_id").orderBy("node_id").collect()
    assert [(r.tag, r.parent_id) for r in rows] == [("ul", -1), ("li", 0), ("li", 1), ("p", -1)]


REVIEW = {
    "@type": "Review", "name": None, "reviewBody": "b \n c", "author": {"name": "Al"},
    "reviewRating": {"ratingValue": 4.5}, "sku": True, "datePublished": 14999.0,
    "interactionStatistic": {"userInteractionCount": "1,234 people"},
}
SECOND = {
    "@type": ["Thing", "Review"], "author": "Bob", "name": "second",
    "interactionStatistic": [{"userInteractionCount": 3}], "reviewRating": 5,
    "review": [{"@type": "Review", "name": "inner"}],
}


def script(text):
    return f'<script type="application/ld+json"> {text} </script>'


def reviews_of(spark, html):
    frame = spark.createDataFrame([(html,)], "html string")
    return [tuple(r)[1:] for r in P.page_reviews(frame).orderBy("pos").collect()]


def test_json_reviews_at_any_depth_in_source_order(spark):
    html = (
        "<!-- " + script('{"@type":"Review"}') + " -->"
        + script(json.dumps({"zz": {"@graph": [[REVIEW]]}, "aa": SECOND}))
        + script("{bad}") + script('{"@type":"Review"} x') + script("5")
        + '<script data-type="application/ld+json">{"@type":"Review","name":"no"}</script>'
        + '<script type=application/ld+json>{"@type":"X","@type":"Review","name":"last"}</script>'
        + script('{"@type":"Re\\u0076iew","name":"escaped"}')
    )
    assert reviews_of(spark, html) == [
        (4, "None", "b c", "Al", "14999.0", "True", 1234),
        (None, "second", "", "Bob", "", "", None),
        (None, "inner", "", "", "", "", None),
        (None, "last", "", "", "", "", None),
        (None, "escaped", "", "", "", "", None),
    ]


def test_deep_json_is_not_cut(spark):
    depth = 60
    text = '{"a":[' * depth + json.dumps({"@type": "Review", "name": "deep"}) + "]}" * depth
    assert [r[1] for r in reviews_of(spark, script(text))] == ["deep"]


def test_number_texts(spark):
    values = [0.1, 4.5, 14999.0, 1e5, 12345678.5, 1e7, 1e15, 1e16, 1.5e22, 1e-4, 1e-5, 2.5e-7, -3.0, 7]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string")
    rows = rows.withColumn("v", F.expr("parse_json(t)"))
    got = rows.selectExpr("i", f"{J.text_of('v')} AS s").orderBy("i").collect()
    assert [r.s for r in got] == [str(v) for v in values]


def test_numbers_beyond_the_json_standard(spark):
    text = """{"@type": "Review", "name": NaN, "reviewBody": "NaN, -Infinity and \\"Infinity\\"",
        "author": {"name": -Infinity}, "datePublished":Infinity, "sku":[1,NaN], "reviewRating": {"ratingValue": NaN}}"""
    review = json.loads(text)
    read = tuple(str(review[k]) for k in ("name", "reviewBody")) + (str(review["author"]["name"]),)
    for bad in ("NaNs", "xNaN", "1NaN", "-NaN", "--Infinity", "NaN NaN"):
        assert reviews_of(spark, script(text.replace('"name": NaN', f'"name": {bad}'))) == []
    got = reviews_of(spark, script(text))
    assert [(r[0], *r[1:5]) for r in got] == [(None, *read, str(review["datePublished"]))]


def block(title, extra=""):
    return (
        f'<div class="_27M-vq"><div class="XQDdHH _x">4<img></div><p class="z9E0IG">{title}</p>'
        '<div class="ZmyHeo"><div>Good phone &amp; battery <b>really</b></div></div>'
        '<p class="_2sc7ZR">Ravi</p><span class="_2sc7ZR">x</span><span>12 Jan, 2024</span>'
        f" Color: Red, Certified Buyer 12 people found this helpful{extra}</div>"
    )


def test_html_reviews(spark):
    html = block("A") + block("A") + block("B") + '<div class="col EPCmJX">rating</div>'
    row = (4, "{}", "Good phone & battery really", "Ravi", "12 Jan, 2024", "Red", 12)
    assert reviews_of(spark, html) == [
        tuple(x.format(t) if isinstance(x, str) else x for x in row) for t in "AB"
    ]


def test_html_review_from_text_only(spark):
    text = "Fine thing, 3 stars, says Ann Lee, 5 March 2023 in a long enough review, read more"
    html = f'<div class="_16PBlm"><p>{text}</p></div>'
    assert reviews_of(spark, html) == [(3, "", text, "says Ann Lee", "5 March 2023", "", None)]


def test_json_wins_over_markup(spark):
    html = script(json.dumps(SECOND)) + block("A")
    assert [r[1] for r in reviews_of(spark, html)] == ["second", "inner"]


def product_of(spark, html, url="https://h.com/s"):
    frame = spark.createDataFrame([(url, html)], "request_url string, html string")
    return P.products(frame).first().asDict()


def test_product_from_json(spark):
    html = (
        '<title>T x</title><link rel="alternate canonical" href="http://WWW.h.com/hi/a/p/itm9/?pid=Z">'
        + script('{"@graph":[{"@type":"Product","name":"no"}]}')
        + script('[{"@type":["Product"],"name":"no"},{"@type":"Product","name":"Moto 5g",'
                 '"offers":{"price":14999.00,"priceCurrency":"INR"},"aggregateRating":{"ratingValue":4.30}}]')
        + '<div class=_3LWZlK>4</div><span class="_2_R_DZ">1,234 Ratings & 5 Reviews</span>'
        + '{"category":"null","category":"Mobiles","superCategory":"S"}'
    )
    row = product_of(spark, html)
    assert row.pop("is_mobile") is True
    assert {k: row[k] for k in ("product_id", "product_url", "title", "price", "currency")} == {
        "product_id": "itm9", "product_url": "https://www.h.com/a/p/itm9", "title": "Moto 5g",
        "price": "14999.0", "currency": "INR",
    }
    assert (row["rating"], row["review_count"]) == ("4.3", "1234")
    assert (row["category"], row["super_category"], row["sub_category"]) == ("Mobiles", "S", "")


def test_product_fallbacks(spark):
    row = product_of(spark, '<title>Page</title>{"productId":"P7"}')
    assert (row["title"], row["product_id"], row["product_url"]) == ("Page", "P7", "https://h.com/s")
    row = product_of(spark, '<h1>First</h1><span class="B_NuCI">Second</span>')
    assert row["title"] == "First" and len(row["product_id"]) == 20
    assert product_of(spark, "")["title"] == ""


def test_links(spark):
    html = (
        '<a href="/x/p/2?y">a</a><a HREF=../p/1>b</a><a href="../p/1#z">b</a>'
        '<a href="https://z.com/p/1">c</a><!-- <a href="/p/9"> --><a title="/p/8" href="/q">d</a>'
        '<b title="<a href=\'/p/7\'>">e</b><a href="mailto:x@h.com/p/3">f</a>'
    )
    frame = spark.createDataFrame([(html, "https://www.h.com/a/b/c")], "html string, final_url string")
    links = P.product_links(frame, "h.com").orderBy("link").collect()
    assert [r.link for r in links] == ["https://www.h.com/a/p/1", "https://www.h.com/x/p/2"]


@pytest.mark.parametrize("operator", [P.page_reviews, P.products, P.elements])
def test_no_shuffle_and_no_python_in_parsing(spark, operator):
    frame = spark.createDataFrame([("u", "<p>")], "request_url string, html string")
    plan = operator(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "Python" not in plan.replace("PythonRDD", "")


def test_no_page_ends_the_job(spark):
    """Tags with very many attributes, unclosed quotes, and large pages."""
    words = "word " * 100_000
    rough = [
        f'<a {words} href="/mobile-phone/p/itm1">x</a>',
        f"<a {'x=1 ' * 100_000} href='/mobile-phone/p/itm1'>x</a>",
        f'<a title="{words} <a href="/mobile-phone/p/itm1">x</a>',
        "<p>" + "text, no markup. " * 600_000 + '<a href="/mobile-phone/p/itm1">x</a>',
        f'<script {words} type="application/ld+json">{{"@type": "Review", "name": "n"}}</script>',
    ]
    pages = spark.createDataFrame([(i, "https://www.h.com/", h) for i, h in enumerate(rough)], "i int, final_url string, html string")
    found = {r.i for r in P.product_links(pages, "h.com").collect()}
    assert {0, 1, 3} <= found
    assert [r.i for r in P.jsonld_reviews(pages).collect()] == [4]
    assert P.html_reviews(pages).count() == 0


def test_last_of_equal_attributes(one):
    tag = '<a HREF="1" data-href="no" href = \'2\' rel=x href>'
    assert one(F.expr(M.raw_attribute("s", "href")), tag) == "2"
    assert one(F.expr(M.raw_attribute("s", "rel")), tag) == "x"
    assert one(F.expr(M.raw_attribute("s", "class")), tag) == ""


def test_windows_1252_and_html_5_references(one):
    text = "&#146;a&#150; &check;&half; &#x80; &#129; &bogus; &amp"
    assert one(F.expr(M.unescape("s")), text) == "’a– ✓½ € \x81 &bogus; &"


def paired(tags, end):
    """Elements by a plain stack of open tags."""
    stack, out = [], []
    for pos, kind, tag in tags:
        parent = stack[-1][0] if stack else -1
        if kind == 1:
            stack.append((pos, tag, parent))
        elif kind == 0:
            out.append((pos, pos, parent, tag))
        else:
            at = max((i for i, entry in enumerate(stack) if entry[1] == tag), default=None)
            if at is not None:
                out += [(p, pos, parent, name) for p, name, parent in stack[at:]]
                del stack[at:]
    return sorted(out + [(p, end, parent, name) for p, name, parent in stack])


def test_tag_pairing_of_random_tags(spark):
    rng = random.Random(1)
    pages = []
    for page in range(16):
        names, opening = "abcdefg"[: rng.randint(1, 7)], rng.choice([0.35, 0.5, 0.65])
        tags, pos = [], 0
        # Beyond 8,192 tags the fold has more than one run.
        for _ in range(9000 if page < 2 else rng.choice([0, 1, 3, 130, 900])):
            pos, draw = pos + rng.randint(1, 3), rng.random()
            kind = 0 if draw < 0.05 else 1 if draw < 0.05 + opening else -1
            tags.append((pos, kind, rng.choice(names)))
        pages.append((page, tags))
    df = spark.createDataFrame(pages, "page int, tags array<struct<pos:int,kind:int,tag:string>>")
    for row in df.selectExpr("tags", M.spans("tags", "99999") + " AS found").collect():
        want = paired([tuple(t) for t in row.tags], 99999)
        assert [tuple(e) for e in row.found] == want


@pytest.mark.parametrize("part, n", [("<b>x</b>", 200_000), ("<li><a>x", 50_000)])
def test_a_very_large_page(spark, part, n):
    pages = spark.createDataFrame([(1, "<ul>" + part * n + "</ul>")], "page_id int, html string")
    found = P.elements(pages).groupBy("tag").agg(F.count("*").alias("n"), F.max("end_id").alias("end"))
    counts = {r.tag: (r.n, r.end) for r in found.collect()}
    names = ["b"] if "b" in part else ["li", "a"]
    assert {k: v[0] for k, v in counts.items()} == {"ul": 1, **dict.fromkeys(names, n)}
    assert counts[names[-1]][1] == counts["ul"][1] - ("b" in part)


def test_start_tags_cost_no_fold_step(spark):
    """Pages of 20,000 list items that nothing closes: their elements, in bounded time."""
    n, pages = 20_000, 32
    tags = (
        f"concat(array(named_struct('pos', 0, 'kind', 1, 'tag', 'ul')), flatten(transform(sequence(0, {n - 1}), w ->"
        " array(named_struct('pos', 4 * w + 1, 'kind', 1, 'tag', 'li'), named_struct('pos', 4 * w + 2, 'kind', -1, 'tag', 'i'),"
        " named_struct('pos', 4 * w + 3, 'kind', 1, 'tag', 'b'), named_struct('pos', 4 * w + 4, 'kind', -1, 'tag', 'b')))),"
        f" array(named_struct('pos', {4 * n + 1}, 'kind', -1, 'tag', 'ul')))"
    )
    given = spark.range(0, pages, 1, 4).selectExpr(f"{tags} AS tags").localCheckpoint()
    found = given.selectExpr(f"{M.spans('tags', '99999')} AS found")
    found.selectExpr("sum(size(found))").first()
    start = time.monotonic()
    sizes = found.selectExpr(
        "size(found) AS n",
        "size(filter(found, e -> e.tag = 'li' AND e.end = 80001)) AS items",
        "size(filter(found, e -> e.tag = 'b' AND e.end = e.pos + 1 AND e.parent = e.pos - 2)) AS words",
    ).collect()
    took = time.monotonic() - start
    assert {tuple(row) for row in sizes} == {(2 * n + 1, n, n)}
    # As a fold step each, start tags took 104 us a list item and core here, so some 17 s in all; 22 us since.
    assert took < 10, took
