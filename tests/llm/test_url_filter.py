import random
import re

from sitefold.llm.query_filters import URL_RULES
from sitefold.llm.url_filter import GlobSet, Rule, filter_urls


def as_regex(glob):
    out = ""
    for part in re.findall(r"\*\*|\*|\?|.", glob, re.S):
        out += {"**": "(?s:.)*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return re.compile(out)


def test_globs_against_regular_expressions():
    draw = random.Random(1)
    globs = ["".join(draw.choice(["a", "b", "/", "*", "**", "?", "ab"]) for _ in range(draw.randrange(9))) for _ in range(150)]
    texts = ["".join(draw.choice("ab/") for _ in range(draw.randrange(12))) for _ in range(400)]
    found = GlobSet([g.encode() for g in globs]).run([t.encode() for t in texts])
    for i, text in enumerate(texts):
        for j, glob in enumerate(globs):
            assert found[i, j] == bool(as_regex(glob).fullmatch(text)), (glob, text)


def judged(spark, urls, rules=URL_RULES):
    rows = [(i, u, "h") for i, u in enumerate(urls)]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string")
    return [(r.host, r.path, r.rule, r.verdict) for r in filter_urls(frame, rules).orderBy("page_id").collect()]


def test_rules_and_rough_urls(spark):
    urls = [
        "http://Example.COM/en/1", "https://www.example.com/en/2?x#y", "http://a.net/es/", "http://a.net/ES/",
        "http://net/fr/x", "http://example.com", "http://notexample.com/en/", None, "", "no scheme", "://", "x://?q",
        "http://a.org/x.net/es/", "http://a.com/http://b.net/es/", "ftp://É.net/es/" + "a" * 50_000, "http://a.com/1\n2",
        "http://a.com/1\n2",
    ]
    got = judged(spark, urls)
    assert [(g[2], g[3]) for g in got] == [
        ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), (None, "allow"),
        ("net/fr/", "block"), (None, "allow"), ("com/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"),
        (None, "allow"), (None, "allow"), (None, "allow"), ("com/", "allow"), ("net/es/", "block"), ("com/", "allow"),
        ("com/", "allow"),
    ]
    assert got[0][:2] == ("example.com", "/en/1") and got[1][:2] == ("www.example.com", "/en/2")
    assert got[7][:2] == got[10][:2] == got[11][:2] == ("", "") and got[15][1] == "/1\n2"
    assert judged(spark, []) == [] and judged(spark, ["http://a.com/"], [])[0][2:] == (None, "allow")


def test_many_rules_span_words(spark):
    rules = [Rule("block", f"host{i}.org", f"/p{i}/") for i in range(200)]
    got = judged(spark, [f"http://www.host{i}.org/p{i}/x" for i in range(200)], rules)
    assert [g[2] for g in got] == [r.name for r in rules]


def test_of_equal_rules_the_first_wins(spark):
    rules = [Rule("allow", "a.com"), Rule("block", "a.com"), Rule("block", "b.com"), Rule("allow", "b.com")]
    got = judged(spark, ["http://a.com/x", "http://b.com/x"], rules)
    assert [g[3] for g in got] == ["allow", "block"]
