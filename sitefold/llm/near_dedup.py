"""Near-duplicate documents by ProbMinHash signatures, banding and verification.

Method: a document is a probability distribution over its shingles of five words (lower-cased;
weight: how often it occurs). Each shingle is a Poisson process with its weight as rate whose
points fall on random registers; a register keeps the shingle that arrives first. Two documents
agree in a register with probability J_P, the probability Jaccard similarity. Points come
lazily in rounds; a shingle stops as soon as its next arrival is later than the latest register
of its document, so a document needs about two points a shingle, not one for each register.

Bands of 5 of the registers are bucket keys. 25 bands find a pair with J_P = 0.8 with
probability 0.99995. Candidates are verified by the exact J_P of their whole texts.

Groups may be large, so a bucket never emits all its pairs. Equal texts (same lower-cased words)
are first joined into one node. Then each bucket compares its members with one leader, the
member that meets most others in all its buckets (in a group of edited copies: the original);
members that verified links join are one part of the bucket. Where a bucket still has several
parts, its members outside the largest one are compared with all its members, in blocks of bounded
size: a block indexes its shingles, counts the overlaps inside the task, and emits no more links
than it takes to join its parts. Classes are the components of all links, so they are those of all
candidate pairs.

Defined results
- One row for each input row: its class is the smallest doc_id of its component.
- Null texts and texts without words belong to no group (class: the own doc_id).
- Fewer than five words: the whole text is one shingle.
- Rows that repeat doc_id and text are copies like others; one of them stays.
- Null doc_ids come after all others when a group's document is chosen.
- An empty table gives no rows; further columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm.components import components
from sitefold.llm.frames import join_key, keyed
from sitefold.llm.words import Runs, U64, Words, mix, starts_of_runs, text_slices
from sitefold.session import Workspace

REGISTERS, BANDS, ROWS = 128, 25, 5
ELEMENT_BITS = 48
PROBE_BLOCK, BASE_BLOCK = 512, 1024
SLICE = 2 << 20
SECOND = U64(0x5851F42D4C957F2D)
SIGNED = "k_id long, k_hash long, w1 long, w2 long, bands array<long>"


def shingles(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, count) of the distinct shingles, sorted by text and element."""
    starts, text = starts_of_runs(offsets, size)
    runs = Runs(words)
    counts = np.diff(offsets)
    short = np.flatnonzero((counts > 0) & (counts < size))
    found = np.concatenate([runs.hash(starts, starts + size), runs.hash(offsets[short], offsets[short + 1])])
    text = np.concatenate([text, short])
    bits = U64(ELEMENT_BITS)
    both = np.sort((text.astype(U64) << bits) | (found >> U64(64 - ELEMENT_BITS)))
    if not len(both):
        return np.zeros(0, np.int64), both, np.zeros(0, np.int64)
    new = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    times = np.diff(np.append(new, len(both)))
    both = both[new]
    return (both >> bits).astype(np.int64), both & U64((1 << ELEMENT_BITS) - 1), times


def prob_minhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int) -> np.ndarray:
    """Signatures (n_texts, REGISTERS): in each register the element that arrives first."""
    first = np.full(n_texts * REGISTERS, np.inf)
    sign = np.zeros(n_texts * REGISTERS, U64)
    element, text = mix(element), text.astype(np.int64)
    rate = weight.astype(np.float64)
    time = np.zeros(len(element))
    latest = np.full(n_texts, np.inf)
    turn = 0
    while len(element):
        turn += 1
        drawn = mix(element + U64(turn * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        time = time - np.log(((drawn >> U64(11)).astype(np.float64) + 1) * 2.0**-53) / rate
        live = time < latest[text]
        slot = text[live] * REGISTERS + (drawn[live] & U64(REGISTERS - 1)).astype(np.int64)
        arrival = time[live]
        np.minimum.at(first, slot, arrival)
        won = first[slot] == arrival
        sign[slot[won]] = element[live][won]
        touched = np.unique(text[live])
        latest[touched] = first.reshape(-1, REGISTERS)[touched].max(axis=1)
        live &= time < latest[text]
        element, text, rate, time = element[live], text[live], rate[live], time[live]
    return sign.reshape(-1, REGISTERS)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    part = signatures[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    odd = mix(np.arange(1, ROWS + 1, dtype=U64)) | U64(1)
    return mix((mix(part) * odd).sum(axis=2, dtype=U64) + np.arange(BANDS, dtype=U64))


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P = sum over common i of 1 / sum_j max(a_j / a_i, b_j / b_i), in O(n log n)."""
    common, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1] / a[1].sum(), b[1] / b[1].sum()
    xc, yc = x[at_a], y[at_b]
    # max(x_j/x_i, y_j/y_i) is the first where y_j/x_j <= y_i/x_i: prefix sums in that order.
    order = np.argsort(yc / xc, kind="stable")
    xc, yc = xc[order], yc[order]
    ratio = yc / xc
    upto = np.searchsorted(ratio, ratio, "right")
    low = np.concatenate([[0], np.cumsum(xc)])[upto] + (1 - xc.sum())
    high = yc.sum() - np.concatenate([[0], np.cumsum(yc)])[upto] + (1 - yc.sum())
    return float((1 / (low / xc + high / yc)).sum())


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column("text"), SLICE):
                words = Words(data, offsets, lower=True)
                signs = []
                for low in range(0, end - first, 1 << 15):
                    part = words.offsets[low : low + (1 << 15) + 1]
                    found = shingles(words.hash[part[0] : part[-1]], part - part[0], size)
                    signs.append(band_keys(prob_minhash(*found, len(part) - 1)))
                keys = np.concatenate(signs).view(np.int64)
                some = words.counts > 0
                one, two = Runs(words.hash), Runs(mix(words.hash ^ SECOND))
                at, to = words.offsets[:-1], words.offsets[1:]
                where = pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("k_id").slice(first, end - first),
                        batch.column("k_hash").slice(first, end - first),
                        pa.array(one.hash(at, to).view(np.int64)),
                        pa.array(two.hash(at, to).view(np.int64)),
                        pa.ListArray.from_arrays(where, pa.array(keys[some].ravel())),
                    ],
                    names=["k_id", "k_hash", "w1", "w2", "bands"],
                )

    return run


def _compare(size: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(8)
        def profile(text: str) -> tuple[np.ndarray, np.ndarray]:
            raw = np.frombuffer(text.encode(), np.uint8)
            words = Words(raw, np.array([0, len(raw)]), lower=True)
            _, element, times = shingles(words.hash, words.offsets, size)
            return element, times.astype(np.float64)

        for batch in batches:
            near = [
                probability_jaccard(profile(a.as_py()), profile(b.as_py())) >= threshold - 1e-9
                for a, b in zip(batch.column("text_u"), batch.column("text_v"))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("u"), batch.column("v"), batch.column("met"), pa.array(near, pa.bool_())],
                names=["u", "v", "met", "near"],
            )

    return run


def _crossing_links(here: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links between components that share a bucket; ``here``: bucket, node, comp."""
    sizes = here.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    split = (
        sizes.groupBy("bucket")
        .agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"))
        # Two members: the star has compared them.
        .where("n > 2 and top.n < n")
        .select(
            "bucket",
            F.col("top.comp").alias("main"),
            F.ceil((F.col("n") - F.col("top.n")) / PROBE_BLOCK).cast("int").alias("probes"),
            F.ceil(F.col("n") / BASE_BLOCK).cast("int").alias("bases"),
        )
    )
    rows = here.join(split, "bucket").withColumn("outside", F.col("comp") != F.col("main"))
    spot = F.xxhash64(F.lit("block"), "node")
    as_base = rows.select(
        "bucket", "node", "comp", F.lit(False).alias("probe"),
        F.explode(F.sequence(F.lit(0), F.col("probes") - 1)).alias("pb"),
        F.pmod(spot, "bases").cast("int").alias("bb"),
    )
    as_probe = rows.where("outside").select(
        "bucket", "node", "comp", F.lit(True).alias("probe"),
        F.pmod(spot, "probes").cast("int").alias("pb"),
        F.explode(F.sequence(F.lit(0), F.col("bases") - 1)).alias("bb"),
    )
    blocks = as_base.unionByName(as_probe).join(texts, "node")
    links = blocks.groupBy("bucket", "pb", "bb").applyInPandas(
        _join_block(size, threshold), "u long, v long"
    )
    return links.distinct()


def _join_block(size: int, threshold: float):
    """Links between probes and base members of a block that join different components."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["probe", "node"])
        base = block[~block.probe].drop_duplicates("node")
        probe = block[block.probe]
        both = pd.concat([base, probe])
        raw = [t.encode() for t in both.text]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        words = Words(np.frombuffer(b"".join(raw), np.uint8), offsets, lower=True)
        text, element, times = shingles(words.hash, words.offsets, size)
        first = np.searchsorted(text, np.arange(len(both) + 1))
        count = np.diff(first)
        even = np.array([bool((times[a:b] == 1).all()) for a, b in zip(first[:-1], first[1:])])
        # Postings of the base: members of each element.
        n_base, held = len(base), first[len(base)]
        order = np.argsort(element[:held], kind="stable")
        keys, member = element[:held][order], text[:held][order]
        root = {c: c for c in both.comp}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        node, comp = both.node.to_numpy(), both.comp.to_numpy()
        links = []
        for i in range(n_base, len(both)):
            mine = element[first[i] : first[i + 1]]
            low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            n = high - low
            of = np.repeat(np.arange(len(n)), n)
            shared = np.bincount(
                member[np.arange(len(of)) - (np.cumsum(n) - n)[of] + low[of]], minlength=n_base
            )
            jaccard = shared / (count[i] + count[:n_base] - shared)
            # With equal weights both measures are the same; else the exact one decides.
            sure = even[:n_base] & even[i]
            for j in np.flatnonzero(np.where(sure, jaccard >= threshold - 1e-9, shared > 0)):
                if find(comp[i]) == find(comp[j]):
                    continue
                if not sure[j]:
                    a, b = slice(first[i], first[i + 1]), slice(first[j], first[j + 1])
                    near = probability_jaccard(
                        (element[a], times[a].astype(float)), (element[b], times[b].astype(float))
                    )
                    if near < threshold - 1e-9:
                        continue
                links.append((node[i], node[j]))
                root[find(comp[i])] = find(comp[j])
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return run


def near_classes(
    docs: DataFrame, work: Workspace, size: int = 5, threshold: float = 0.8
) -> DataFrame:
    """k_id, k_hash, class_id, chosen (settled): one row for each input row.

    ``chosen`` marks the one document of its group that stays; rows repeating its doc_id and
    text are marked too.
    """
    rows = keyed(docs)
    signed = work.settle(rows.mapInArrow(_sign(size), SIGNED), "signed")
    worded = signed.where(F.size("bands") > 0)
    # Null ids sort last: the flag comes first in the order.
    rank = F.struct(F.col("k_id").isNull().alias("none"), "k_id", "k_hash", "bands")
    nodes = work.settle(
        worded.groupBy("w1", "w2")
        .agg(F.min(rank).alias("top"))
        .select("w1", "w2", "top.k_id", "top.k_hash", "top.bands")
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    buckets = nodes.select("node", F.explode("bands").alias("bucket")).distinct()
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = work.settle(buckets.join(shared, "bucket"), "members")

    candidates = work.settle(
        members.select("node").distinct().join(nodes.select("node", "k_id", "k_hash"), "node"),
        "candidates",
    )
    texts = work.settle(
        join_key(rows, candidates, "inner", 32).select("node", "text").dropDuplicates(["node"]),
        "texts",
    )

    # The leader of a bucket meets most documents over all its buckets.
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    met = members.join(sizes, "bucket").groupBy("node").agg(F.sum("n").alias("met"))
    leader = F.max(F.struct("met", "node")).alias("head")
    heads = members.join(met, "node").groupBy("bucket").agg(leader)
    star = members.join(heads, "bucket").select(
        F.col("head.node").alias("u"), F.col("node").alias("v"), F.col("head.met").alias("met")
    )
    pairs = work.settle(star.where("u <> v").distinct(), "pairs")
    with_v = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
    both = with_v.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u")
    compared = both.select("u", "v", "met", "text_u", "text_v").mapInArrow(
        _compare(size, threshold), "u long, v long, met long, near boolean"
    )
    links = work.settle(compared.where("near").drop("near"), "links_star")
    # Two steps up to the most met leader: enough to tell who is joined already. Leaders rise in
    # (met, node), so steps cannot go round; what they miss is only compared once more.
    up = links.groupBy("v").agg(F.max(F.struct("met", "u")).alias("top"))
    up = work.settle(up.select("v", F.col("top.u").alias("u")), "up")
    higher = up.select(F.col("v").alias("u"), F.col("u").alias("uu"))
    up = up.join(higher, "u", "left").select(
        F.col("v").alias("node"), F.coalesce("uu", "u").alias("comp")
    )
    here = members.join(up, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    crossing = _crossing_links(here.select("bucket", "node", "comp"), texts, size, threshold)
    crossing = work.settle(crossing, "links_crossing")
    labels = components(links.select("u", "v").unionByName(crossing), work, "labels")

    classes = nodes.select("w1", "w2", "node", "k_id", "k_hash").join(labels, "node", "left")
    classes = classes.withColumn("comp", F.coalesce("comp", "node")).drop("node")
    top = F.min(
        F.struct(F.col("k_id").isNull().alias("none"), "k_id", "k_hash")
    ).alias("top")
    tops = classes.groupBy("comp").agg(top)
    classes = classes.drop("k_id", "k_hash").join(tops, "comp").select("w1", "w2", "top")
    out = worded.join(classes, ["w1", "w2"]).select(
        "k_id",
        "k_hash",
        F.col("top.k_id").alias("class_id"),
        (F.col("k_id").eqNullSafe(F.col("top.k_id")) & (F.col("k_hash") == F.col("top.k_hash"))).alias("chosen"),
    )
    alone = signed.where(F.size("bands") == 0).select(
        "k_id", "k_hash", F.col("k_id").alias("class_id"), F.lit(True).alias("chosen")
    )
    result = work.settle(out.unionByName(alone), "classes")
    work.close(keep=("classes",))
    return result


def drop_near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each near-duplicate group; columns as they are."""
    work = Workspace(docs.sparkSession, "near_dedup")
    classes = near_classes(docs, work, size, threshold)
    # Only decisions that change something travel: keys to drop, and keys held more than once.
    decided = work.settle(
        classes.groupBy("k_id", "k_hash")
        .agg(F.bool_and("chosen").alias("chosen"), F.count(F.lit(1)).alias("rows"))
        .where("not chosen or rows > 1")
        .select("k_id", "k_hash", "chosen"),
        "decided",
    )
    work.drop("classes")
    text = F.col("text").cast("string")
    keys = [F.col("doc_id").cast("long").alias("k_id"), F.xxhash64(text).alias("k_hash")]
    wordless = F.coalesce(text.rlike(r"^[ \t\n\x0B\f\r]*$"), F.lit(True))
    rows = docs.select(*[F.col(c).alias(f"c_{c}") for c in docs.columns], *keys, wordless.alias("k_free"))
    joined = join_key(rows, decided, "left", 32)
    names = [F.col(f"c_{c}").alias(c) for c in docs.columns]
    once = joined.where("chosen is null or k_free").select(*names)
    copies = joined.where("chosen and not k_free").dropDuplicates(["k_id", "k_hash"]).select(*names)
    return once.unionByName(copies)
