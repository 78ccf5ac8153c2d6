from collections import defaultdict

from sitefold.llm.line_dedup import dedup_lines


def brute(rows, min_docs=3):
    key = lambda line: "".join(
        c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r")
    )
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(doc_id)
    low = lambda d: float("-inf") if d is None else d
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [
            x for x in lines
            if len(holders.get(key(x), ())) < min_docs or doc_id == max(holders[key(x)], key=low)
        ]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def check(docs, rows):
    got = dedup_lines(docs(rows)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=str) == brute(rows)


def test_given_documents(spark, sf, docs):
    check(docs, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_rough_rows(docs):
    a, b = "a line that is long enough", "ÄÖÜ line that is long enough"
    many = "\n".join([a, *[f"line {i} of a long text, all its own" for i in range(5000)], a.upper()] * 2)
    check(docs, [
        (1, None), (2, ""), (3, f"{a}\n{b}\n\n{a}"), (4, f" {a.upper()}\t\nx\n{b.lower()}"), (5, f"{b}\n{a}"),
        (5, f"{b}\n{a}"), (5, f"other\n{a}"), (None, f"{a}\n{b}\n"), (6, "short\nshort"), (7, "short"), (8, "short"),
        (9, many), (-1, f"{a}\r\n{a}\x85"), (10, "x" * 200_000),
    ])


def test_bitmap_and_empty_table(docs):
    line = "a line that is long enough"
    rows = [(1, "\n".join(["x"] * 40 + [line])), (2, line), (3, line)]
    got = {r.doc_id: r.words for r in dedup_lines(docs(rows)).collect()}
    assert got[3] is None
    assert [(w.word, w.kept) for w in got[1]] == [(1, 2**32 - 1 - (1 << 8))]
    assert dedup_lines(docs([])).count() == 0


def test_no_python_in_the_plan(docs):
    plan = dedup_lines(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_very_long_text(spark, docs):
    """A million lines in one text, some of them lost, within seconds."""
    common = [f"line number {i} that all documents hold" for i in range(5)]
    n = 1_000_000
    body = "\n".join(common[i // 1000 % 5] if i % 1000 == 0 else f"own {i}" for i in range(n))
    out = dedup_lines(docs([(1, body), (2, "\n".join(common)), (3, "\n".join(common))])).collect()
    found = {r.doc_id: r for r in out}
    assert found[1].n_lines == n
    lost = sum(i % 1000 == 0 for i in range(n))
    assert found[1].n_dropped == lost and found[3].n_dropped == 0 and found[2].n_dropped == 5
    assert found[1].kept_text.split("\n") == [f"own {i}" for i in range(n) if i % 1000]
