"""Removal of word sequences that occur more than once in a corpus.

Method: each window of k words is an edge of the corpus' De Bruijn graph, from its first k-1
words to its last k-1. The edges along a text are compacted before anything is shuffled: a
window's minimiser is its smallest m-word hash, and a maximal run of windows with one minimiser
position is a path piece of up to k-m+1 edges, a single row. Equal windows have equal
minimisers, so the pieces of one minimiser hold all occurrences of their edges:

1. A minimiser seen once: its edges are unique; the piece goes.
2. Pieces of one minimiser that all spell the same words: a repeated path that does not branch.
   All its edges repeat, without looking at them one by one.
3. Pieces that differ (the path branches there): only these are expanded into edges, which are
   counted and joined back.

The source coordinates of the repeated pieces and edges are gathered by document, merged into
long spans, and cut from the text they came from. Pieces and edges are matched by 128 bits
(minimiser and words), so that no two different sequences meet.

Counts are partial aggregates and joins may be split by adaptive execution, so a passage that a
third of all documents share is never gathered in one task. Rows are linear in the input.

Defined results
- text null, empty or shorter than k words: nothing is removed.
- Windows are judged on the input: all copies of a sequence go, overlapping ones too.
- Rows that repeat doc_id and text repeat each other's windows and get equal results.
- An empty table gives no rows; further columns are passed over. A very long text is one row
  with memory in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.llm.frames import join_counted, join_key, keyed
from sitefold.llm.words import Runs, U64, Words, mix, starts_of_runs, text_slices
from sitefold.operators.prefilter import key_bits, may_hold, surely_without
from sitefold.session import Workspace

POSITION_BITS = 22
PIECES = "mini long, spelled long, k_id long, k_hash long, start int, n_windows int"
EDGES = "h1 long, h2 long, k_id long, k_hash long, start int"
KEPT = "k_id long, n_words long, n_removed long, kept_text string"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of ``width`` values."""
    done, size = x, 1
    while size * 2 <= width:
        done = np.minimum(done[: len(done) - size], done[size:])
        size *= 2
    rest = width - size
    return np.minimum(done[: len(done) - rest], done[rest:]) if rest else done


def path_pieces(hashes: np.ndarray, offsets: np.ndarray, k: int, m: int) -> tuple[np.ndarray, ...]:
    """(text, start, n, minimiser, spelling) of the path pieces of some texts."""
    starts, text = starts_of_runs(offsets, k)
    found = []
    step = (1 << POSITION_BITS) - k
    for low in range(0, len(hashes) - k + 1, step):
        part = hashes[low : low + step + k - 1]
        take = slice(*np.searchsorted(starts, [low, low + step]))
        at, of = starts[take] - low, text[take]
        if not len(at):
            continue
        runs = Runs(part)
        small = runs.every(m)
        bits = U64(POSITION_BITS)
        ranked = (small >> bits << bits) | np.arange(len(small), dtype=U64)
        where = (sliding_min(ranked, k - m + 1)[at] & U64((1 << POSITION_BITS) - 1)).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (where[1:] != where[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(at)))
        s, w = at[first], where[first]
        second = Runs(mix(part ^ U64(0x5851F42D4C957F2D)))
        spelled = mix(second.hash(s, s + n + k - 1) + (n * 64 + (w - s)).astype(U64))
        found.append((of[first], s + low, n, small[w], spelled))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U64), none.astype(U64)
    return tuple(np.concatenate(c) for c in zip(*found))


def _pieces(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("k_id"), batch.column("k_hash")
            for first, _, data, offsets in text_slices(batch.column("text")):
                words = Words(data, offsets)
                text, start, n, mini, spelled = path_pieces(words.hash, words.offsets, k, m)
                rows = pa.array(text + first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(mini.view(np.int64)),
                        pa.array(spelled.view(np.int64)),
                        ids.take(rows),
                        keys.take(rows),
                        pa.array((start - words.offsets[text]).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                    ],
                    names=["mini", "spelled", "k_id", "k_hash", "start", "n_windows"],
                )

    return run


def _ranges(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, n) of a list<struct<start, n>> column; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = np.asarray(column.value_lengths().fill_null(0))
    inner = column.flatten()
    start = np.asarray(inner.field("start")).astype(np.int64)
    n = np.asarray(inner.field("n")).astype(np.int64)
    return np.repeat(np.arange(len(counts)), counts), start, n


def _spread(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, and the range of each."""
    of = np.repeat(np.arange(len(n)), n)
    before = np.cumsum(n) - n
    return np.arange(len(of)) - before[of] + start[of], of


def _edges(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("k_id"), batch.column("k_hash")
            row, start, n = _ranges(batch.column("pieces"))
            for first, end, data, offsets in text_slices(batch.column("text")):
                words = Words(data, offsets)
                own = slice(*np.searchsorted(row, [first, end]))
                at, of = _spread(start[own], n[own])
                text = row[own][of]
                s = at + words.offsets[text - first]
                one, two = Runs(words.hash), Runs(mix(words.hash ^ U64(0x5851F42D4C957F2D)))
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one.hash(s, s + k).view(np.int64)),
                        pa.array(two.hash(s, s + k).view(np.int64)),
                        ids.take(rows),
                        keys.take(rows),
                        pa.array(at.astype(np.int32)),
                    ],
                    names=["h1", "h2", "k_id", "k_hash", "start"],
                )

    return run


def _cut(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("k_id")
            row, start, n = _ranges(batch.column("spans"))
            for first, end, data, offsets in text_slices(batch.column("text")):
                own = slice(*np.searchsorted(row, [first, end]))
                counts, removed, kept = [], [], []
                low = own.start
                for i in range(first, end):
                    high = low + int(np.searchsorted(row[low : own.stop], i, "right"))
                    words = data[offsets[i - first] : offsets[i - first + 1]].tobytes().split()
                    lost = 0
                    if high > low:
                        depth = np.zeros(len(words) + 1, np.int64)
                        np.add.at(depth, start[low:high], 1)
                        np.add.at(depth, start[low:high] + n[low:high] + k - 1, -1)
                        stay = np.cumsum(depth[:-1]) == 0
                        lost = len(words) - int(stay.sum())
                        counts.append(len(words))
                        words = [words[j] for j in np.flatnonzero(stay)]
                    else:
                        counts.append(len(words))
                    removed.append(lost)
                    kept.append(b" ".join(words))
                    low = high
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, end - first),
                        pa.array(counts, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    names=["k_id", "n_words", "n_removed", "kept_text"],
                )

    return run


def document_key() -> Column:
    return F.struct("k_id", "k_hash")


def repeated_spans(docs: DataFrame, work: Workspace, k: int = 35, m: int = 12) -> DataFrame:
    """k_id, k_hash, spans: word positions (start, n) at which repeated windows start (settled)."""
    rows = keyed(docs)
    pieces = rows.mapInArrow(_pieces(k, m), PIECES)
    repeated = work.settle(
        pieces.groupBy("mini")
        .agg(
            F.count(F.lit(1)).alias("n"),
            (F.min("spelled") == F.max("spelled")).alias("one_path"),
        )
        .where("n > 1"),
        "repeated",
    )
    # Most minimisers are unique: their pieces leave before the second shuffle.
    bits = work.settle(key_bits(repeated, F.col("mini")), "mini_bits")
    again = may_hold(pieces, F.col("mini"), bits)
    n_again = repeated.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    found = work.settle(
        join_counted(again.drop("spelled"), repeated, ["mini"], n_again).select(
            "k_id", "k_hash", "start", F.col("n_windows").alias("n"), "one_path"
        ),
        "found",
    )
    work.drop("repeated", "mini_bits")
    span = F.struct("start", "n")
    branching = work.settle(
        found.where(~F.col("one_path"))
        .groupBy("k_id", "k_hash")
        .agg(F.collect_list(span).alias("pieces"), F.sum("n").alias("n_edges")),
        "branching",
    )
    n_edges = branching.agg(F.coalesce(F.sum("n_edges"), F.lit(0)).alias("n")).first()["n"]
    # Texts without a branching piece stay where they are.
    bits = work.settle(key_bits(branching, document_key()), "branching_bits")
    texts = may_hold(rows, document_key(), bits)
    # Expanded twice, for the counts and for the join: cheaper than keeping the edges on disk.
    edges = join_key(texts, branching.drop("n_edges"), "inner").mapInArrow(_edges(k), EDGES)
    twins = work.settle(
        edges.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "twins"
    )
    single = join_counted(edges, twins, ["h1", "h2"], n_edges).select(
        "k_id", "k_hash", "start", F.lit(1).alias("n")
    )
    spans = work.settle(
        found.where("one_path")
        .select("k_id", "k_hash", "start", "n")
        .unionByName(single)
        .groupBy("k_id", "k_hash")
        .agg(F.collect_list(span).alias("spans")),
        "spans",
    )
    work.drop("found", "branching", "branching_bits", "twins")
    return spans


def dedup_substrings(docs: DataFrame, k: int = 35, m: int = 12) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: texts without windows of k words that occur twice."""
    work = Workspace(docs.sparkSession, "substring_dedup")
    spans = repeated_spans(docs, work, k, m)
    bits = work.settle(key_bits(spans, document_key()), "span_bits")
    rows = keyed(docs)
    joined = join_key(may_hold(rows, document_key(), bits), spans, "left")
    # Texts that lose nothing do not shuffle.
    whole = surely_without(rows, document_key(), bits).withColumn(
        "spans", F.lit(None).cast(joined.schema["spans"].dataType)
    )
    kept = joined.unionByName(whole).mapInArrow(_cut(k), KEPT)
    return kept.withColumnRenamed("k_id", "doc_id")
