"""Merkle manifest of a dataset: nested-interval labels, inclusion proofs and their check.

Method: every node carries the interval [lo, hi] of the leaf ranks it covers, so that "is an
ancestor of" is "covers". Levels are put into buckets (bands) of ``BAND`` levels; the nodes of
one band below one node of the next are a block, a single row of bounded size.

1. Leaves get their rank within their group from a range-partitioned sort.
2. Bands are built from the bottom: the nodes of a block are hashed level by level in its row,
   its top is a node of the next band. A band has fan ** BAND times fewer rows than the one below.
3. From the top down each block is joined with the node of the next band whose interval covers
   it, on (group, place of the interval), which attaches all ancestors above. Inside a block the
   siblings of a level are the interval difference: the nodes of the parent's interval that end
   before the rank, and those that begin after it.

The roots of the groups are the leaves of a last tree of the same kind. A proof is the list of
(left, right) sibling digests from the leaf to the root; folding a leaf through it gives the root.

No text is shuffled, only digests; a group of any size is split over range partitions and blocks.

Defined results
- Every input row is a leaf, repeated rows too; null columns are hashed as ``-``, so null and
  empty differ. Very long texts are hashed in the scan.
- Order in a group: doc_id ascending, null first, rows with one doc_id by leaf digest. Equal
  leaves are exchangeable: they have the same digest, each place its own proof.
- A null group is a group of its own and comes first. An empty table gives no rows and no nodes.
- Further columns of the input are passed over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.llm.frames import maybe_broadcast, positions
from sitefold.operators.parse_pages import staged
from sitefold.session import Workspace

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 2
# Levels of a band: a block holds up to FAN ** BAND base nodes.
BAND = 8
BLOCK = FAN**BAND

NO_PATH = "CAST(array() AS ARRAY<STRUCT<left: STRING, right: STRING>>)"
# Bound of a row of ``above``: a path of some 40 levels with (FAN - 1) digests each.
ABOVE_BYTES = 40 * 64 * (FAN - 1)


def leaf_digest(columns: dict[str, Column]) -> Column:
    """SHA-256 of the columns, each as its UTF-8 byte count, a colon and the value, or ``-``."""
    parts = []
    for value in columns.values():
        text = value.cast("string")
        framed = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(framed, F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _level(below: str, step: int) -> str:
    """Nodes above those of a level, as long as its group has several; else null."""
    run = f"slice({below}, i * {FAN} + 1, {FAN})"
    hashed = f"sha2(array_join(transform({run}, x -> x.digest), ''), 256)"
    node = (
        f"named_struct('lo', get({below}, i * {FAN}).lo,"
        f" 'hi', element_at({run}, -1).hi, 'digest', {hashed})"
    )
    places = f"sequence(0, CAST((size({below}) - 1) div {FAN} AS INT))"
    return f"if(n > {FAN**step}, transform({places}, i -> {node}), NULL)"


def _blocks(nodes: DataFrame, span: int) -> DataFrame:
    """k_group, block, n, base, levels, top of the blocks of a band.

    ``nodes``: k_group, rank, n (nodes of the group in this level), leaves (of the group),
    digest, item (what rides along). ``span`` is the number of leaf ranks a node covers.
    """
    blocks = nodes.groupBy("k_group", F.expr(f"rank div {BLOCK}").alias("block")).agg(
        F.max("n").alias("n"),
        F.max("leaves").alias("leaves"),
        F.sort_array(F.collect_list(F.struct("rank", "digest", "item"))).alias("base"),
    )
    first = (
        f"named_struct('lo', b.rank * {span}L, 'hi', least((b.rank + 1) * {span}L, leaves) - 1,"
        " 'digest', b.digest)"
    )
    df = staged(blocks, _l0=f"transform(base, b -> {first})")
    for step in range(BAND):
        df = staged(df, **{f"_l{step + 1}": _level(f"_l{step}", step)})
    every = ", ".join(f"_l{step}" for step in range(BAND + 1))
    df = staged(df, levels=f"filter(array({every}), l -> l IS NOT NULL)")
    return df.selectExpr(
        "k_group", "block", "n", "leaves", "base", "levels",
        "get(element_at(levels, -1), 0).digest AS top",
    )


def build_bands(nodes: DataFrame, work: Workspace, name: str) -> list[DataFrame]:
    """Settled blocks of each band, from the leaves up. ``nodes``: k_group, rank, n, digest, item."""
    bands, span = [], 1
    nodes = nodes.withColumn("leaves", F.col("n"))
    while True:
        blocks = work.settle(_blocks(nodes, span), f"{name}_band_{len(bands)}")
        bands.append(blocks)
        open_blocks = blocks.where(F.col("n") > BLOCK)
        if open_blocks.isEmpty():
            return bands
        nodes = open_blocks.select(
            "k_group",
            F.col("block").alias("rank"),
            F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"),
            "leaves",
            F.col("top").alias("digest"),
            F.lit(None).cast("string").alias("item"),
        )
        span *= BLOCK


def _group_tops(bands: list[DataFrame]) -> DataFrame:
    """k_group, top: the root of each group."""
    tops = [b.where(F.col("n") <= BLOCK).select("k_group", "top") for b in bands]
    return reduce(DataFrame.unionAll, tops)


def _paths(bands: list[DataFrame], above: DataFrame | None, work: Workspace, name: str) -> DataFrame:
    """k_group, rank, digest, item, subroot, root, path of the nodes the lowest band stands on.

    ``above``: k_group, path, root of the groups' roots within a further tree (settled).
    """
    upper = None
    for at in reversed(range(len(bands))):
        whole = bands[at].where(F.col("n") <= BLOCK)
        if above is None:
            whole = whole.selectExpr("*", "top AS subroot", "top AS root", f"{NO_PATH} AS beyond")
        else:
            side = maybe_broadcast(above, ABOVE_BYTES)
            whole = whole.join(side, whole["k_group"].eqNullSafe(side["k_group"])).select(
                *[whole[c] for c in bands[at].columns],
                whole["top"].alias("subroot"),
                side["root"],
                side["path"].alias("beyond"),
            )
        rows = whole
        if upper is not None:
            part = bands[at].where(F.col("n") > BLOCK)
            side = maybe_broadcast(upper, ABOVE_BYTES)
            covered = part["k_group"].eqNullSafe(side["k_group"]) & (part["block"] == side["rank"])
            rows = rows.unionByName(
                part.join(side, covered).select(
                    *[part[c] for c in bands[at].columns],
                    side["subroot"],
                    side["root"],
                    side["path"].alias("beyond"),
                )
            )
        upper = _unfold(rows)
        if at:
            upper = work.settle(upper, f"{name}_paths_{at}")
    return upper


def _unfold(blocks: DataFrame) -> DataFrame:
    """One row for each base node of the blocks, with its path."""
    run = f"slice(l, CAST(i div CAST(pow({FAN}, k + 1) AS BIGINT) AS INT) * {FAN} + 1, {FAN})"
    own = "get(get(levels, 0), i).lo"

    def side(condition: str) -> str:
        return f"array_join(transform(filter({run}, x -> {condition}), x -> x.digest), '')"

    # The last level is the block's top, which has no siblings here.
    siblings = (
        "transform(slice(levels, 1, size(levels) - 1), (l, k) -> named_struct("
        f"'left', {side(f'x.hi < {own}')}, 'right', {side(f'x.lo > {own}')}))"
    )
    node = f"named_struct('rank', b.rank, 'digest', b.digest, 'item', b.item, 'near', {siblings})"
    df = staged(blocks, _nodes=f"transform(base, (b, i) -> {node})")
    df = df.selectExpr("k_group", "subroot", "root", "beyond", "inline(_nodes)")
    return df.selectExpr(
        "k_group", "rank", "digest", "item", "subroot", "root", "concat(near, beyond) AS path"
    )


def _placed(df: DataFrame, work: Workspace, order: list[str], name: str) -> DataFrame:
    ranked = positions(work, df, ["k_group"], order, name, "rank")
    return ranked.withColumnRenamed("rank_n", "n")


class Manifest:
    """The trees of a table; frames are settled in ``work``.

    ``leaves``: k_group, k_id, leaf, claim (any column that rides along).
    """

    def __init__(self, leaves: DataFrame, work: Workspace):
        self.work = work
        # Settled first: the range sort samples its input, and text should be hashed once.
        settled = work.settle(leaves, "leaves")
        placed = _placed(settled, work, ["k_id", "leaf"], "ranked").select(
            "k_group", "rank", "n", F.col("leaf").alias("digest"),
            F.struct("k_id", "claim").alias("item"),
        )
        self.bands = build_bands(placed, work, "group")
        work.drop("leaves", "ranked", "ranked_parts")
        tops = _group_tops(self.bands).select(
            F.lit(0).alias("k_group"), F.col("k_group").alias("member"), "top"
        )
        forest = _placed(tops, work, ["member"], "members")
        self.forest = build_bands(
            forest.select("k_group", "rank", "n", F.col("top").alias("digest"), F.col("member").alias("item")),
            work,
            "forest",
        )
        work.drop("members", "members_parts")

    def proofs(self) -> DataFrame:
        """k_group, k_id, claim, rank, leaf, subroot, root, path: one row for each leaf."""
        members = _paths(self.forest, None, self.work, "forest")
        above = self.work.settle(
            members.select(F.col("item").alias("k_group"), "path", "root"), "above"
        )
        rows = _paths(self.bands, above, self.work, "group")
        return rows.select(
            "k_group", "item.k_id", "item.claim", "rank", F.col("digest").alias("leaf"),
            "subroot", "root", "path",
        )

    def nodes(self) -> DataFrame:
        """k_group, level, lo, hi, digest: every node of the groups' trees with its interval."""
        parts = []
        for at, band in enumerate(self.bands):
            rows = band.selectExpr("k_group", "posexplode(levels) AS (step, _nodes)")
            # The base of a higher band is the top level of the band below.
            rows = rows.where(f"step > 0 OR {at} = 0")
            parts.append(rows.selectExpr("k_group", f"step + {at * BAND} AS level", "inline(_nodes)"))
        return reduce(DataFrame.unionAll, parts)


def document_leaves(docs: DataFrame, group: str = "lang", altered: dict[str, Column] | None = None) -> DataFrame:
    """k_group, k_id, leaf, claim of the documents.

    ``claim`` is the digest of the row with the ``altered`` columns in place of its own, where
    it differs from the leaf; null elsewhere.
    """
    own = {c: F.col(c) for c in COLUMNS}
    leaf = leaf_digest(own)
    claim = F.lit(None).cast("string")
    if altered:
        changed = reduce(Column.__or__, [~own[c].eqNullSafe(v) for c, v in altered.items()])
        claim = F.when(changed, leaf_digest({**own, **altered}))
    return docs.select(
        F.col(group).cast("string").alias("k_group"),
        F.col("doc_id").cast("long").alias("k_id"),
        leaf.alias("leaf"),
        claim.alias("claim"),
    )


def fold(digest: Column, path: Column) -> Column:
    """Root that a digest leads to along a path."""
    return F.aggregate(
        path, digest, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256)
    )


def proof_digest(path: Column) -> Column:
    siblings = F.transform(path, lambda s: F.concat(s["left"], s["right"]))
    return F.sha2(F.array_join(siblings, ""), 256)


def verify_claims(docs: DataFrame, altered: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path, folded_root, verified of every document."""
    manifest = Manifest(document_leaves(docs, altered=altered), Workspace(docs.sparkSession, "merkle"))
    folded = fold(F.coalesce("claim", "leaf"), F.col("path"))
    return manifest.proofs().select(
        F.col("k_id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        "path",
        folded.alias("folded_root"),
        (folded == F.col("root")).alias("verified"),
    )
