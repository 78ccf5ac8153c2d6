"""SimHash near-duplicates: 64-bit fingerprints linked at a few differing bits.

Method (generalised pigeonhole): the 64 bits are dealt into parts, and part i gets a threshold
t_i with sum(t_i + 1) = max_bits + 1; t_i = -1 leaves a part out. Two fingerprints that differ
in at most max_bits bits then differ in at most t_i bits within some part i.

1. Each text becomes its fingerprint; equal fingerprints become one node, so that copies cost
   nothing from here on.
2. Bits that agree or disagree together go into one part: a greedy grouping by the correlations
   of all fingerprints. For 2 to max_bits + 1 parts the colliding pairs of every part are
   counted, and dynamic programming allots the thresholds that cost the least probes and pairs.
3. Every node is filed under its own value of each part and probes all values within t_i bits.
   Buckets of at most ``HOT`` nodes are joined and verified by bit count on the spot.
4. A larger bucket links its members with its most frequent node first (one row each). What
   these links leave in different components is compared in blocks, which emit only links that
   join components: a bucket's rows never become all its pairs.
5. Links become connected components by star contraction.

Counts and minima are partial aggregates. A node or component with more than a thousandth of all
rows, of which there are at most a thousand, is joined by a broadcast, the others by shuffle.

Defined results
- A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r, A-Z lower-cased.
  Shingles are ``size`` consecutive words, each occurrence counts; fewer words: the whole sequence.
- text null, empty or blank: fingerprint 0, linked like any other. A tie of a bit gives 0.
- Repeated rows and rows sharing a doc_id each keep a row; component_id is the smallest doc_id
  of the component, null if it holds only null ids.
- An empty table gives no rows; further columns are passed over. A very long text is read in
  pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.llm.components import components
from sitefold.llm.frames import join_counted, keyed, maybe_broadcast
from sitefold.llm.words import U64, text_slices
from sitefold.session import Workspace

BITS = 64
SEED = 42
PIECE_BYTES = 1 << 20
# Nodes of a bucket that are joined without further care.
HOT = 100
PROBE_BLOCK, BASE_BLOCK = 1024, 2048
# Cost of comparing a pair, as a multiple of the cost of filing or probing one row.
PAIR_COST = 0.02
_SPACES = b" \t\n\x0b\x0c\r"


# --- fingerprints -----------------------------------------------------------------


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text cut at white space into pieces of about ``PIECE_BYTES``."""
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        while end < len(text) and text[end] not in _SPACES:
            end += 1
        yield text[at:end]
        at = end


def _shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())]
    return np.array(found, U64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first."""
    total = np.zeros(BITS, np.int64)
    for low in range(0, len(hashes), 1 << 16):
        part = hashes[low : low + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes, size: int = 3) -> int:
    ones, total, held = np.zeros(BITS, np.int64), 0, []
    for piece in _pieces(text):
        words = held + piece.lower().split()
        n = len(words) - size + 1
        if n > 0:
            ones += _ones(_shingle_hashes(words, size))
            total += n
        held = words[max(n, 0) :]
    if not total and held:
        ones, total = _ones(_shingle_hashes(held, len(held))), 1
    return sum(1 << int(bit) for bit in np.flatnonzero(2 * ones > total))


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column("text")):
                found = [
                    fingerprint(data[a:b].tobytes(), size)
                    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("k_id").slice(first, end - first),
                        pa.array(np.array(found, U64).view(np.int64)),
                    ],
                    names=["k_id", "fp"],
                )

    return run


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """k_id, fp (the 64 bits as a long): one row for each document."""
    return keyed(docs).select("k_id", "text").mapInArrow(_sign(size), "k_id long, fp long")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- parts and thresholds -----------------------------------------------------------


@dataclass(frozen=True)
class Part:
    """Bits of a part as a signed mask, and how many of them may differ (-1: not used)."""

    mask: int
    threshold: int

    @property
    def flips(self) -> list[int]:
        """Every change of up to ``threshold`` bits, as a signed mask."""
        bits = [b for b in range(BITS) if self.mask >> b & 1]
        return [
            _signed(sum(1 << b for b in chosen))
            for size in range(self.threshold + 1)
            for chosen in combinations(bits, size)
        ]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) & 1 else mask


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def _both_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bit of a task: nodes seen, and how many have it and each other bit set."""
    total, seen = np.zeros((BITS, BITS)), 0
    for batch in batches:
        fps = np.asarray(batch.column("fp")).astype("<i8")
        for low in range(0, len(fps), 1 << 14):
            part = np.ascontiguousarray(fps[low : low + (1 << 14)]).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(part, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            seen += len(part)
    rows = [pa.array(row.astype(np.int64)) for row in total]
    yield pa.RecordBatch.from_pydict(
        {
            "bit": pa.array(range(BITS), pa.int32()),
            "seen": pa.array([seen] * BITS, pa.int64()),
            "both": pa.array([r.to_pylist() for r in rows], pa.list_(pa.int64())),
        }
    )


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of nodes, and for each pair of bits the nodes that have both set."""
    sums = [F.sum(F.get("both", F.lit(j))).alias(f"b{j}") for j in range(BITS)]
    rows = (
        nodes.select("fp")
        .mapInArrow(_both_set, "bit int, seen long, both array<long>")
        .groupBy("bit")
        .agg(F.sum("seen").alias("seen"), *sums)
        .collect()
    )
    both = np.zeros((BITS, BITS))
    for row in rows:
        both[row["bit"]] = [row[f"b{j}"] for j in range(BITS)]
    return (rows[0]["seen"] if rows else 0), both


def correlations(n: int, both: np.ndarray) -> np.ndarray:
    """Absolute correlation of each pair of bits; 0 for bits that never change."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(share * (1 - share))
    covariance = both / max(n, 1) - np.outer(share, share)
    scale = np.outer(spread, spread)
    found = np.abs(np.divide(covariance, scale, out=np.zeros_like(covariance), where=scale > 0))
    np.fill_diagonal(found, 0)
    return found


def group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt into parts of nearly equal width, correlated ones together."""
    left, groups = list(range(BITS)), []
    for at in range(parts):
        width = BITS // parts + (at < BITS % parts)
        group = [max(left, key=lambda b: (correlation[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < width:
            group.append(max(left, key=lambda b: (correlation[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def _close_chance(disagree: np.ndarray, most: int) -> np.ndarray:
    """Chance that at most 0, 1, … most bits of a pair differ, for independent bits."""
    chance = np.zeros(most + 2)
    chance[0] = 1
    for p in disagree:
        chance[1:] = chance[1:] * (1 - p) + chance[:-1] * p
        chance[0] *= 1 - p
    return np.maximum(np.cumsum(chance[: most + 1]), 1e-30)


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds with sum(t + 1) = total of least cost; costs[i][t + 1] is that of part i."""
    best = {0: (0.0, [])}
    for part in costs:
        step = {}
        for used, (cost, chosen) in best.items():
            for size, more in enumerate(part[: total - used + 1]):
                offer = (cost + more, [*chosen, size - 1])
                if used + size not in step or offer < step[used + size]:
                    step[used + size] = offer
        best = step
    return best[total]


def plan_parts(nodes: DataFrame, max_bits: int) -> list[Part]:
    """The parts and thresholds that cost least over all nodes (settled, column fp)."""
    n, both = bit_counts(nodes)
    correlation = correlations(n, both)
    share = np.diag(both) / max(n, 1)
    layouts = [group_bits(correlation, m) for m in range(2, max_bits + 2)]
    parts = [(at, bits) for at, layout in enumerate(layouts) for bits in layout]
    masks = F.array(*[F.lit(_mask(bits)) for _, bits in parts])
    values = nodes.select(F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))))
    pairs = (
        values.groupBy("pos", "col")
        .count()
        .groupBy("pos")
        .agg(F.sum(F.col("count") * (F.col("count") - 1.0) / 2).alias("pairs"))
    )
    meeting = {row["pos"]: row["pairs"] for row in pairs.collect()}
    offers = []
    for at, layout in enumerate(layouts):
        costs = []
        for pos, (of, bits) in enumerate(parts):
            if of != at:
                continue
            p = share[bits]
            close = _close_chance(2 * p * (1 - p), max_bits)
            exact = max(meeting.get(pos, 0), n * (n - 1) / 2 * close[0])
            probes = np.cumsum([comb(len(bits), t) for t in range(max_bits + 1)])
            costs.append(
                [0.0]
                + [n * (1 + probes[t]) + PAIR_COST * exact * close[t] / close[0] for t in range(max_bits + 1)]
            )
        cost, thresholds = allot(costs, max_bits + 1)
        offers.append((cost, at, thresholds))
    _, at, thresholds = min(offers)
    return [Part(_mask(bits), t) for bits, t in zip(layouts[at], thresholds)]


# --- links ------------------------------------------------------------------------


def _filed(nodes: DataFrame, parts: list[Part], probing: bool) -> DataFrame:
    """part, value and the columns of the nodes: where a node is filed, or what it probes."""

    def places_of(at: int, part: Part) -> Column:
        flips = F.array(*[F.lit(f).cast("long") for f in (part.flips if probing else [0])])
        own = F.col("fp").bitwiseAND(part.mask)
        return F.transform(
            flips, lambda f: F.struct(F.lit(at).alias("part"), own.bitwiseXOR(f).alias("value"))
        )

    places = [places_of(at, part) for at, part in enumerate(parts) if part.threshold >= 0]
    return nodes.select("*", F.inline(F.concat(*places))).select("part", "value", *nodes.columns)


def _near(a: Column, b: Column, max_bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= max_bits


def _small_bucket_links(base: DataFrame, probes: DataFrame, hot: DataFrame, max_bits: int) -> DataFrame:
    spot = ["part", "value"]
    hot = maybe_broadcast(hot.select(*spot), 16)
    u = probes.join(hot, spot, "left_anti").withColumnRenamed("fp", "u")
    v = base.join(hot, spot, "left_anti").withColumnRenamed("fp", "v")
    # Both members of a pair probe, so each pair is met from its smaller side.
    near = _near(F.col("u"), F.col("v"), max_bits) & (F.col("u") < F.col("v"))
    return u.join(v, spot).where(near).select("u", "v")


def _hot_bucket_links(
    base: DataFrame, probes: DataFrame, hot: DataFrame, star: DataFrame, exact: list[int],
    max_bits: int, work: Workspace,
) -> DataFrame:
    """Links of large buckets that the ``star`` links leave in different components."""
    spot = ["part", "value"]
    comps = components(star, work, "star_comps")
    hot = maybe_broadcast(hot.select(*spot), 16)

    def members(rows: DataFrame) -> DataFrame:
        return (
            rows.join(hot, spot)
            .join(comps.withColumnRenamed("node", "fp"), "fp", "left")
            .select(*spot, "fp", F.coalesce("comp", "fp").alias("comp"))
        )

    base = work.settle(members(base), "hot_base")
    probes = work.settle(members(probes), "hot_probes")
    sizes = base.groupBy(*spot, "comp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy(*spot).agg(
        F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n_base")
    )
    probing = probes.groupBy(*spot, "comp").agg(F.count(F.lit(1)).alias("n"))
    plan = (
        probing.join(main, spot)
        .groupBy(*spot)
        .agg(
            F.first("top.comp").alias("main"),
            F.first("n_base").alias("n_base"),
            (F.first("n_base") - F.first("top.n")).alias("n_other"),
            F.sum(F.when(F.col("comp") != F.col("top.comp"), F.col("n")).otherwise(0)).alias("p_other"),
            F.sum(F.when(F.col("comp") == F.col("top.comp"), F.col("n")).otherwise(0)).alias("p_main"),
        )
    )
    # Pairs outside the main component: other probes with every node, and, where probing is not
    # mutual within the bucket, probes of the main component with the other nodes.
    families = work.settle(
        plan.select(
            *spot, "main",
            F.inline(F.array(
                F.struct(F.lit(False).alias("of_main"), F.col("p_other").alias("p"), F.col("n_base").alias("b")),
                F.struct(F.lit(True).alias("of_main"), F.col("p_main").alias("p"), F.col("n_other").alias("b")),
            )),
        )
        .where("p > 0 and b > 0")
        .where(~(F.col("of_main") & F.col("part").isin(exact)))
        .select(
            *spot, "main", "of_main",
            F.ceil(F.col("p") / PROBE_BLOCK).cast("int").alias("pbs"),
            F.ceil(F.col("b") / BASE_BLOCK).cast("int").alias("bbs"),
        ),
        "families",
    )
    families = maybe_broadcast(families, 40)
    own_main = F.col("comp") == F.col("main")
    deal = F.xxhash64(F.lit("block"), "fp")
    rows = ["part", "value", "of_main", "fp", "comp"]
    as_probe = probes.join(families, spot).where(own_main == F.col("of_main")).select(
        *rows, F.lit(True).alias("probe"),
        F.pmod(deal, "pbs").cast("int").alias("pb"),
        F.explode(F.sequence(F.lit(0), F.col("bbs") - 1)).alias("bb"),
    )
    as_base = base.join(families, spot).where(~F.col("of_main") | ~own_main).select(
        *rows, F.lit(False).alias("probe"),
        F.explode(F.sequence(F.lit(0), F.col("pbs") - 1)).alias("pb"),
        F.pmod(deal, "bbs").cast("int").alias("bb"),
    )
    blocks = as_probe.unionByName(as_base).groupBy("part", "value", "of_main", "pb", "bb")
    return blocks.applyInPandas(_join_block(max_bits), "u long, v long")


def _join_block(max_bits: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        probe, base = block[block.probe], block[~block.probe]
        fps, comps = base.fp.to_numpy(), base.comp.to_numpy()
        root = {c: c for c in block.comp}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        links = []
        for fp, comp in zip(probe.fp.to_numpy(), probe.comp.to_numpy()):
            for j in np.flatnonzero(np.bitwise_count((fps ^ fp).view(U64)) <= max_bits):
                if find(comp) != find(comps[j]):
                    links.append((fp, fps[j]))
                    root[find(comp)] = find(comps[j])
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return run


def fingerprint_links(
    nodes: DataFrame, work: Workspace, max_bits: int = 3, parts: list[Part] | None = None, hot: int = HOT
) -> DataFrame:
    """u, v: links that leave the same components as all pairs within ``max_bits`` bits.

    ``nodes`` (settled): fp, copies; one row for each fingerprint.
    """
    parts = parts or plan_parts(nodes, max_bits)
    base = _filed(nodes.select("fp"), parts, probing=False)
    probes = _filed(nodes.select("fp"), parts, probing=True)
    buckets = _filed(nodes.select("fp", "copies"), parts, probing=False).groupBy("part", "value")
    hot_ones = work.settle(
        buckets.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("copies", "fp")).alias("top"))
        .where(F.col("n") > hot)
        .select("part", "value", F.col("top.fp").alias("leader")),
        "hot",
    )
    links = _small_bucket_links(base, probes, hot_ones, max_bits)
    if hot_ones.isEmpty():
        return links
    side = maybe_broadcast(hot_ones, 24)
    led = base.join(side, ["part", "value"])
    star = work.settle(
        led.where((F.col("fp") != F.col("leader")) & _near(F.col("fp"), F.col("leader"), max_bits))
        .select(F.col("fp").alias("u"), F.col("leader").alias("v"))
        .distinct(),
        "star",
    )
    # In a part that only probes its own value, two members meet from both sides.
    exact = [at for at, part in enumerate(parts) if part.threshold == 0]
    crossing = _hot_bucket_links(base, probes, hot_ones, star, exact, max_bits, work)
    return links.unionByName(star).unionByName(crossing)


# --- components -----------------------------------------------------------------------


def near_components(
    docs: DataFrame, work: Workspace, size: int = 3, max_bits: int = 3
) -> DataFrame:
    """k_id, fp, component_id of every document."""
    signed = work.settle(fingerprints(docs, size), "fingerprints")
    nodes = work.settle(
        signed.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"), F.min("k_id").alias("smallest")),
        "nodes",
    )
    links = work.settle(fingerprint_links(nodes, work, max_bits), "links")
    labels = components(links, work, "components")
    linked = work.settle(
        nodes.join(labels, nodes["fp"] == labels["node"]).select("fp", "copies", "smallest", "comp"),
        "linked",
    )
    groups = work.settle(
        linked.groupBy("comp").agg(
            F.count(F.lit(1)).alias("n"), F.min("smallest").alias("component_id")
        ),
        "groups",
    )
    count = linked.count()
    grouped = join_counted(linked.select("fp", "copies", "comp"), groups, ["comp"], count)
    alone = nodes.join(labels, nodes["fp"] == labels["node"], "left_anti")
    found = work.settle(
        grouped.select("fp", F.col("copies").alias("n"), "component_id").unionByName(
            alone.select("fp", F.col("copies").alias("n"), F.col("smallest").alias("component_id"))
        ),
        "found",
    )
    return join_counted(signed, found, ["fp"], signed.count()).select("k_id", "fp", "component_id")
