import pytest

from sitefold.llm.mixing import mix_report, mix_sources


def test_marginals_are_reached(docs):
    rows = []
    for i in range(3000):
        source, lang = ("hot" if i % 3 == 0 else f"s{i % 5}"), ("en" if i % 4 else "de")
        text = "word " * (5 + i % 40) + ("| cell" if i % 7 == 0 else "")
        rows.append((i, text, lang, source))
    targets = {"lang": {"en": 0.5, "de": 0.5, "xx": 3.0}, "source": {"hot": 1, "s0": 1, "s1": 1, "s2": 1, "s3": 1, "s4": 1}}
    mixed = mix_sources(docs(rows), targets=targets, sweeps=12).collect()
    assert len(mixed) == 3000 and max(r.probability for r in mixed) == pytest.approx(1)
    weight = sum(r.tokens * r.probability for r in mixed)
    share = lambda f: sum(r.tokens * r.probability for r in mixed if f(r)) / weight
    assert share(lambda r: r.m_lang == "en") == pytest.approx(0.5, abs=1e-4)
    assert share(lambda r: r.m_source == "hot") == pytest.approx(1 / 6, abs=1e-4)
    tokens = sum(r.tokens for r in mixed)
    tables = sum(r.tokens for r in mixed if r.m_topic == "table") ** 0.7
    prose = sum(r.tokens for r in mixed if r.m_topic == "prose") ** 0.7
    assert share(lambda r: r.m_topic == "table") == pytest.approx(tables / (tables + prose), abs=1e-4)
    kept = sum(r.tokens for r in mixed if r.kept)
    assert kept == pytest.approx(weight, rel=0.05) and kept < tokens


def mixture():
    return [(i, "word " * (4 + i % 40), "en" if i % 5 else "de", f"s{i % 3}") for i in range(3000)]


def test_kept_share_does_not_hang_on_the_rarest_cell(docs):
    odd = (9999, "word " * 20, "qq", "stray")
    for rows in (mixture(), [*mixture(), odd]):
        mixed = mix_sources(docs(rows), keep=0.7).collect()
        tokens = sum(r.tokens for r in mixed)
        assert sum(r.tokens * r.probability for r in mixed) == pytest.approx(0.7 * tokens, rel=1e-6)
        assert max(r.probability for r in mixed) <= 1
        assert sum(r.tokens for r in mixed if r.kept) == pytest.approx(0.7 * tokens, rel=0.05)
    assert [r.probability for r in mixed if r.doc.doc_id == 9999] == [pytest.approx(1, abs=0.05)]


def test_bounded_targets_and_report(docs):
    frame = docs([*mixture(), (9999, "word " * 20, "qq", "stray")])
    targets = {"lang": {"en": 0.6, "de": 0.4}, "source": {"s0": 1, "s1": 1, "s2": 2}}
    mixed = mix_sources(frame, targets=targets, keep=0.7).collect()
    weight = sum(r.tokens * r.probability for r in mixed)
    assert weight == pytest.approx(0.7 * sum(r.tokens for r in mixed), rel=1e-6)
    report = {r.value: r for r in mix_report(frame, 0.7, targets=targets).collect()}
    for name, row in report.items():
        share = sum(r.tokens * r.probability for r in mixed if name in r[2:5]) / weight
        assert row.share == pytest.approx(share, abs=1e-9)
    assert {n for n, r in report.items() if r.unmet} == {"de", "s2"}
    assert {r.probability for r in mixed if r.m_lang == "qq"} == {0}
    assert min(r.probability for r in mixed if r.m_lang == "de") > 0.95
    for wrong in (0, 1.5):
        with pytest.raises(ValueError):
            mix_sources(frame, keep=wrong)


def test_rough_rows(docs):
    rows = [(1, None, None, None), (2, "", "en", "e"), (3, "a b", "en", "s"), (3, "a b", "en", "s"), (None, "c\nd", "fr", None), (5, "x " * 50_000, "fr", "s")]
    frame = docs(rows)
    mixed = mix_sources(frame)
    assert mixed.select("doc.*").columns == frame.columns
    got = mixed.collect()
    assert len(got) == 6
    by = [(r.doc.doc_id, r.tokens, r.m_source, r.m_topic) for r in got]
    assert (1, 0, "(none)", "(none)") in by and (2, 0, "e", "prose") in by and (None, 2, "(none)", "prose") in by
    assert all(r.kept for r in got if r.tokens == 0)
    twins = [r.kept for r in got if r.doc.doc_id == 3]
    assert twins[0] == twins[1]
    assert mix_sources(docs([])).count() == 0
    assert all(r.kept for r in mix_sources(docs([(1, None), (2, "")])).collect())
    gone = mix_sources(frame, targets={"lang": {"fr": 1.0}}).collect()
    assert {r.kept for r in gone if r.m_lang == "en" and r.tokens} == {False}


def test_no_python_in_the_plan(docs):
    plan = mix_sources(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
