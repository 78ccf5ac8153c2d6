"""The manifest against trees built by hand."""

import hashlib

from pyspark.sql import functions as F

from sitefold.llm import merkle
from sitefold.llm.merkle import Manifest, document_leaves, proof_digest, verify_claims
from sitefold.session import Workspace


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    parts = []
    for value in (doc_id, source, lang, n_chars, text):
        parts.append("-" if value is None else f"{len(str(value).encode())}:{value}")
    return sha(*parts)


def tree(digests):
    """Levels of a tree from the leaves up."""
    levels = [digests]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([sha(*row[i : i + 2]) for i in range(0, len(row), 2)])
    return levels


def path(levels, at):
    """(left, right) siblings from a leaf up."""
    out = []
    for row in levels[:-1]:
        first = at // 2 * 2
        out.append(("".join(row[first:at]), "".join(row[at + 1 : first + 2])))
        at //= 2
    return out


def expected(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> multiset of (doc_id, leaf, subroot, root, path)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(*row), row[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([r[2] for r in sorted(groups[g], key=lambda r: r[:3])]) for g in names}
    forest = tree([trees[g][-1][0] for g in names])
    out = []
    for i, g in enumerate(names):
        for at, row in enumerate(sorted(groups[g], key=lambda r: r[:3])):
            whole = path(trees[g], at) + path(forest, i)
            out.append((row[3], row[2], trees[g][-1][0], forest[-1][0], whole))
    return out


def as_rows(df):
    return [(r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in df.collect()]


def order(rows):
    return sorted(rows, key=repr)


def test_deep_trees_and_rough_rows(spark, docs):
    # 600 leaves need two bands; languages of 1, 2, 3 and 5 leaves have ragged levels.
    rows = [(i, f"text {i}", "en", "s") for i in range(600)]
    rows += [(i, "t", f"l{n}", None) for n in (1, 2, 3, 5) for i in range(n)]
    rows += [(7, None, None, "s"), (None, "", None, None), (None, "x" * 100000, "é", "ü\n")]
    rows += [(3, "same", "dup", "s")] * 3
    frame = docs(rows)
    tampered = F.col("doc_id") % 5 == 0
    altered = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    out = verify_claims(frame, altered)
    full = [(i, source, lang, len(text or ""), text) for i, text, lang, source in rows]
    want = expected(full)
    assert order(as_rows(out)) == order(want)
    root = want[0][3]
    for r in out.collect():
        assert r.verified == (r.doc_id is None or r.doc_id % 5 != 0)
        assert (r.folded_root == root) == r.verified and r.root == root


def test_nodes_carry_nested_intervals(spark, docs):
    n = merkle.BLOCK + 37
    work = Workspace(spark, "merkle_nodes")
    manifest = Manifest(document_leaves(docs([(i, f"t{i}", "en", "s") for i in range(n)])), work)
    levels = tree([leaf(i, "s", "en", len(f"t{i}"), f"t{i}") for i in range(n)])
    want = []
    for level, row in enumerate(levels):
        for at, digest in enumerate(row):
            want.append((level, at << level, min((at + 1) << level, n) - 1, digest))
    found = manifest.nodes().select("level", "lo", "hi", "digest").collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_one_row_and_no_row(spark, docs):
    only = verify_claims(docs([(1, "a", "en", "s")])).select(
        "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof"), "verified"
    )
    row = only.first()
    assert row.leaf == row.subroot == row.root == leaf(1, "s", "en", 1, "a")
    assert row.proof == sha() and row.verified
    assert verify_claims(docs([])).count() == 0
