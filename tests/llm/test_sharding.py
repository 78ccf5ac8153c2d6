import zlib
from collections import Counter

from sitefold.llm.sharding import shard_documents, shard_manifest


def test_law_and_mixture(docs):
    rows = [(i, "x" * (i % 50), "en", "hot" if i % 3 else f"s{i % 9}") for i in range(2003)]
    got = shard_manifest(docs(rows), n_shards=40).collect()
    assert sorted(r.k_id for r in got) == list(range(2003))
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in range(40):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sizes[shard]))
    source = {row[0]: row[3] for row in rows}
    whole = Counter(source.values())
    held = Counter((r.shard, source[r.k_id]) for r in got)
    for shard in range(40):
        for name, n in whole.items():
            assert abs(held[(shard, name)] - n / 40) < 2
    for r in got:
        text = rows[r.k_id][1].encode()
        assert (r.size, r.text_crc32) == (len(text) + 16, zlib.crc32(text))
    again = shard_manifest(docs(rows[::-1]), n_shards=40).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in got}


def test_rough_rows(docs):
    rows = [(1, None), (1, None), (None, "é"), (2, ""), (2, "", "en", None), (3, "x" * 300_000)] + [(9, "same")] * 20
    frame = docs(rows)
    placed = shard_documents(frame, n_shards=4)
    got = placed.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert sorted(Counter(r.shard for r in got).values()) == [6, 6, 7, 7]
    assert len({(r.shard, r.slot) for r in got}) == len(rows)
    assert set(placed.columns) == set(frame.columns)
    manifest = {(r.k_id, r.size, r.text_crc32) for r in shard_manifest(frame, 4).collect()}
    assert (1, 16, 0) in manifest and (None, 18, zlib.crc32("é".encode())) in manifest
    assert shard_manifest(docs([])).count() == 0 and shard_documents(docs([])).count() == 0
    few = shard_manifest(docs([(1, "a"), (2, "b")]), 40).collect()
    assert {r.slot for r in few} == {0} and len({r.shard for r in few}) == 2
