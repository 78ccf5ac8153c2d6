"""SimHash against brute force."""

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from sitefold.llm import simhash
from sitefold.llm.query_dedup import op13_simhash
from sitefold.llm.simhash import Part, allot, fingerprint, fingerprint_links, group_bits, near_components, plan_parts
from sitefold.session import Workspace


def plain_fingerprint(text):
    words = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    if not words:
        return 0
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, max_bits=3):
    """Smallest index of the component of each fingerprint."""
    fps = np.array(fps, np.uint64)
    comp = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits
    while True:
        new = np.array([comp[row].min() for row in near])
        if (new == comp).all():
            return comp.tolist()
        comp = new


def signed(fps):
    return [int(x) for x in np.array(fps, np.uint64).view(np.int64)]


def linked(spark, fps, **options):
    """Component of each fingerprint by the links found, and the number of links."""
    work = Workspace(spark, "simhash_test")
    nodes = work.settle(
        spark.createDataFrame([(f, 1) for f in signed(fps)], "fp long, copies long"), "nodes"
    )
    links = fingerprint_links(nodes, work, **options).collect()
    root = {f: f for f in signed(fps)}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for u, v in links:
        root[find(u)] = find(v)
    return [find(f) for f in signed(fps)], len(links)


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.fixture(scope="module")
def clustered():
    """Distinct fingerprints: lone ones, chains, and a dense group around one centre."""
    rng = np.random.default_rng(5)
    fps = list(rng.integers(0, 2**63, 400, dtype=np.uint64))
    for start in fps[:20]:
        at = int(start)
        for _ in range(6):
            for bit in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                at ^= 1 << int(bit)
            fps.append(np.uint64(at))
    centre = int(fps[30])
    for _ in range(300):
        at = centre
        for bit in rng.choice(64, int(rng.integers(1, 6)), replace=False):
            at ^= 1 << int(bit)
        fps.append(np.uint64(at))
    return sorted({int(f) for f in fps})


@pytest.mark.parametrize(
    "widths, thresholds, hot",
    [((16, 16, 16, 16), (0, 0, 0, 0), 3), ((24, 20, 20), (1, 0, 0), 3), ((16, 16, 32), (-1, 0, 2), 100)],
)
def test_every_allotment_finds_all_links(spark, clustered, widths, thresholds, hot):
    order = np.random.default_rng(1).permutation(64).tolist()
    parts = []
    for width, threshold in zip(widths, thresholds):
        bits, order = order[:width], order[width:]
        parts.append(Part(simhash._mask(bits), threshold))
    found, _ = linked(spark, clustered, parts=parts, hot=hot)
    assert same_partition(found, plain_components(clustered))


def test_dense_bucket_emits_few_links(spark):
    rng = np.random.default_rng(3)
    fps = set()
    while len(fps) < 2000:
        at = 0x123456789ABCDEF
        for bit in rng.choice(48, int(rng.integers(1, 4)), replace=False):
            at ^= 1 << int(bit)
        fps.add(at)
    fps = sorted(fps)
    parts = [Part(simhash._mask(list(range(a, a + 16))), 0) for a in (0, 16, 32, 48)]
    found, n_links = linked(spark, fps, parts=parts)
    assert len(set(found)) == 1
    near = np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)[None, :]) <= 3
    assert n_links < near.sum() / 4


def test_allot_is_optimal():
    from itertools import product

    rng = np.random.default_rng(2)
    for parts in (2, 3, 4):
        costs = rng.random((parts, 5))
        costs[:, 0] = 0
        best, chosen = allot([list(c) for c in costs], 4)
        assert sum(t + 1 for t in chosen) == 4
        every = [
            sum(costs[i][s] for i, s in enumerate(sizes))
            for sizes in product(range(5), repeat=parts)
            if sum(sizes) == 4
        ]
        assert best == pytest.approx(min(every))


def test_grouping_keeps_correlated_bits_together(spark):
    rng = np.random.default_rng(4)
    low = rng.integers(0, 2, (2000, 16))
    order = rng.permutation(64)
    columns = np.concatenate([np.repeat(low[:, :8], 2, axis=1), rng.integers(0, 2, (2000, 48))], axis=1)
    fps = {sum(1 << int(order[j]) for j in np.flatnonzero(row)) for row in columns}
    work = Workspace(spark, "simhash_group")
    nodes = work.settle(spark.createDataFrame([(f,) for f in signed(sorted(fps))], "fp long"), "nodes")
    n, both = simhash.bit_counts(nodes)
    assert n == len(fps)
    groups = group_bits(simhash.correlations(n, both), 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    place = {b: i for i, g in enumerate(groups) for b in g}
    assert all(place[order[2 * i]] == place[order[2 * i + 1]] for i in range(8))
    parts = plan_parts(nodes, 3)
    assert sum(p.threshold + 1 for p in parts) == 4


ROWS = [
    (1, "one two three four five"), (2, "One TWO three\tfour\nfive"), (3, None), (4, ""), (5, " \n "),
    (6, "single"), (7, "two words"), (8, "two words"), (8, "two words"), (None, "single"), (9, "Äpfel ÄPFEL x y"),
    (10, "ä  b c d e f g " * 50), (11, "word " * 5000),
]


def test_fingerprints_and_rough_rows(spark, docs):
    out = near_components(docs(ROWS), Workspace(spark, "simhash_rows")).collect()
    assert len(out) == len(ROWS)
    plain = [plain_fingerprint(t) for _, t in ROWS]
    comp = plain_components(plain)
    smallest = {}
    for (doc_id, _), c in zip(ROWS, comp):
        if doc_id is not None:
            smallest[c] = min(doc_id, smallest.get(c, doc_id))
    want = sorted((-1 if i is None else i, signed([f])[0], smallest.get(c)) for (i, _), f, c in zip(ROWS, plain, comp))
    assert sorted((-1 if r.k_id is None else r.k_id, r.fp, r.component_id) for r in out) == want
    empty = near_components(docs([]), Workspace(spark, "simhash_empty"))
    assert empty.count() == 0 and empty.columns == ["k_id", "fp", "component_id"]


def test_pieces_of_a_long_text(monkeypatch):
    text = " ".join(f"Word{i % 97}" for i in range(5000))
    whole = fingerprint(text.encode())
    monkeypatch.setattr(simhash, "PIECE_BYTES", 64)
    assert fingerprint(text.encode()) == whole == plain_fingerprint(text)


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    plain = [plain_fingerprint(r.text) for r in rows]
    comp = plain_components(plain)
    smallest = {}
    for r, c in zip(rows, comp):
        smallest[c] = min(r.doc_id, smallest.get(c, r.doc_id))
    out = op13_simhash(spark, sf)
    assert [t for _, t in out.dtypes] == ["bigint", "string", "bigint"]
    assert sorted(map(tuple, out.collect())) == sorted(
        (r.doc_id, f"{f:016x}", smallest[c]) for r, f, c in zip(rows, plain, comp)
    )
    # The engine's own hash of a string is the one of the contract.
    own = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first().h
    assert own == signed([xxhash.xxh64_intdigest(b"a b c", 42)])[0]
