"""Mixing sources to target weights by iterative proportional fitting, with built-in functions only.

Method: documents are counted into cells (source, language, topic) with their tokens. Token
weights start as the tokens there are and are raked: one sweep scales them to the target share
of each source, then of each language, then of each topic. After some sweeps all three
marginals hold at once. A document's probability is its cell's weight over its cell's tokens,
scaled; a document stays if a number drawn from its id is below that. So no document is taken twice.

The scale is set by ``keep``, the share of all tokens that is expected to stay.
- A number: probabilities are bounded at 1. Cells that reach 1 are held full and the others are
  raked to what is left, so a rare cell neither sets the scale nor the size of the result. Values
  whose tokens fall short of their target stay whole as far as their other values let them, and the
  others share the rest; ``mix_report`` lists every value with its target and its expected share.
- None: the largest probability is 1. Expected tokens have exactly the raked shares, but the rarest
  cell alone then sets how much stays. ``op9_mixing`` has this law, as its SQL states it.

Targets are given as shares, or default to tempered ones: tokens to the power ``temper``,
which lifts small sources and holds back large ones.

Cells are pre-aggregated before any shuffle, so a source with a third of all rows is a few
hundred rows here. Cells reach the documents by a join (broadcast after a size check); text is
never shuffled. Each sweep works on the cells in windows, and sweeps are settled.

Defined results
- Tokens of a text: its spaces and newlines plus one; 0 for null and empty texts.
- A null source, language or topic counts as the value "(none)".
- Cells without tokens have no weight to rake; their documents stay (probability 1).
- Values with a target but no documents are ignored, the other shares of that dimension are
  scaled to 1; values without a given target get share 0 and their documents go.
- Repeated rows have one id, draw one number and stay or go together; a null id draws as "null".
- With ``keep``, at most the tokens of cells without a target of 0 can stay; if they are fewer, they
  all do.
- An empty table gives no rows; columns with clashing names are kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitefold.llm.frames import maybe_broadcast
from sitefold.session import Workspace

NONE = "(none)"
SWEEPS_PER_STEP = 2
DIMS = ("m_source", "m_lang", "m_topic")

#: Marks of a text, looked for in this order, and the topic they stand for. Fixed values.
TOPIC_MARKS = (("License", "legal"), ("@", "contact"), ("|", "table"))
OTHER_TOPIC = "prose"


def topic_of(text: Column) -> Column:
    topic = F.lit(OTHER_TOPIC)
    for mark, name in reversed(TOPIC_MARKS):
        topic = F.when(F.contains(text, F.lit(mark)), name).otherwise(topic)
    return F.when(text.isNotNull(), topic)


def token_count(text: Column) -> Column:
    bare = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    blanks = F.octet_length(text) - F.octet_length(bare)
    return F.when(F.octet_length(text) > 0, blanks + 1).otherwise(0).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from 48 bits of a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / 2.0**48


def _with_targets(
    cells: DataFrame, targets: dict[str, dict[str, float]], temper: float
) -> DataFrame:
    """Add t_<dim>, the target share of the cell's value in each dimension."""
    for dim in DIMS:
        given = targets.get(dim.removeprefix("m_"))
        values = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("n"))
        if given is None:
            share = F.pow(F.sum("tokens").over(W.partitionBy(dim)).cast("double"), F.lit(temper))
            values = values.select(F.when(F.col("n") > 0, F.pow("n", F.lit(temper))).alias("t"))
        else:
            pairs = [F.lit(x) for pair in given.items() for x in pair]
            known = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")
            share = F.coalesce(F.try_element_at(known, F.col(dim)), F.lit(0.0))
            values = values.where("n > 0").select(
                F.coalesce(F.try_element_at(known, F.col(dim)), F.lit(0.0)).alias("t")
            )
        whole = values.agg(F.sum("t")).first()[0] or 1.0
        cells = cells.withColumn(f"t_{dim}", share / F.lit(float(whole)))
    return cells


def rake(
    cells: DataFrame,
    work: Workspace,
    targets: dict[str, dict[str, float]] | None = None,
    temper: float = 0.7,
    sweeps: int = 6,
) -> DataFrame:
    """Cells (settled) with column w, the raked share of all tokens."""
    start = _with_targets(cells, targets or {}, temper)
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    current = start.withColumn("w", F.col("tokens") / F.lit(float(total)))
    for sweep in range(sweeps):
        for dim in DIMS:
            held = F.sum("w").over(W.partitionBy(dim))
            current = current.withColumn(
                "w", F.when(held > 0, F.col("w") * F.col(f"t_{dim}") / held).otherwise(F.lit(0.0))
            )
        if sweep % SWEEPS_PER_STEP == SWEEPS_PER_STEP - 1 or sweep == sweeps - 1:
            current = work.settle(current, f"sweep_{sweep}")
    return current


def _level(cells: DataFrame, most: Column, weight: Column, amount: float) -> float:
    """The factor at which the sum of least(most, factor * weight) is ``amount``.

    Newton's steps from below: each holds what has reached its bound and spreads the rest over the
    others, until no further one reaches it. Beyond the sum of the bounds, all have reached theirs.
    """
    factor, before = 0.0, -1
    while True:
        full = weight * F.lit(factor) >= most
        held, count, free = (
            cells.where((weight > 0) & (most > 0))
            .agg(
                F.coalesce(F.sum(F.when(full, most)), F.lit(0)).cast("double"),
                F.count(F.when(full, 1)),
                F.coalesce(F.sum(F.when(~full, weight)), F.lit(0)).cast("double"),
            )
            .first()
        )
        if count == before or free <= 0:
            return factor
        factor, before = max(factor, (amount - held) / free), count


def rake_bounded(
    cells: DataFrame,
    work: Workspace,
    targets: dict[str, dict[str, float]] | None = None,
    temper: float = 0.7,
    sweeps: int = 6,
    keep: float = 1.0,
) -> DataFrame:
    """Cells (settled) with probability, at most 1, at which the share ``keep`` of tokens stays.

    The sweeps are those of ``rake``, but a cell counts with its tokens at most, and the goal of a
    value is its target as far as its tokens reach; values beyond theirs take up what is missing.
    Also g_<dim>, the tokens that the target asks for, and n_<dim>, those there are.
    """
    start = work.settle(_with_targets(cells, targets or {}, temper), "start")
    wanted = F.lit(True)
    for dim in DIMS:
        wanted &= F.col(f"t_{dim}") > 0
    n = F.when(wanted, F.col("tokens")).otherwise(0).cast("double")
    total, there = start.agg(F.sum("tokens"), F.sum(n)).first()
    amount = min(keep * (total or 0), there or 0.0)
    current = start.withColumn("n", n).withColumn("y", F.col("n"))
    for dim in DIMS:
        values = start.groupBy(dim).agg(F.sum(n).alias("n"), F.first(f"t_{dim}").alias("t"))
        level = _level(work.settle(values, f"values_{dim}"), F.col("n"), F.col("t"), amount)
        supply = F.sum("n").over(W.partitionBy(dim))
        current = (
            current.withColumn(f"n_{dim}", supply)
            .withColumn(f"g_{dim}", F.col(f"t_{dim}") * F.lit(keep * float(total or 0)))
            .withColumn(f"goal_{dim}", F.least(supply, F.col(f"t_{dim}") * F.lit(level)))
        )
    for sweep in range(sweeps):
        for dim in DIMS:
            full, goal = F.col("y") >= F.col("n"), F.col(f"goal_{dim}")
            over = W.partitionBy(dim)
            held = F.sum(F.when(full, F.col("n")).otherwise(0.0)).over(over)
            free = F.sum(F.when(~full, F.col("y")).otherwise(0.0)).over(over)
            # Short of the goal, the free cells get what the full ones leave; beyond it, all give way.
            factor = (
                F.when((held + free < goal) & (free > 0), (goal - held) / free)
                .when(held + free > 0, goal / (held + free))
                .otherwise(F.lit(0.0))
            )
            current = current.withColumn("y", F.least("y", "n") * factor)
        if sweep % SWEEPS_PER_STEP == SWEEPS_PER_STEP - 1 or sweep == sweeps - 1:
            current = work.settle(current, f"sweep_{sweep}")
    level = _level(current, F.col("n"), F.col("y"), amount)
    probability = F.when(
        F.col("tokens") > 0, F.least(F.lit(1.0), F.col("y") * F.lit(level) / F.col("tokens"))
    ).otherwise(F.lit(1.0))
    columns = [f"{x}_{d}" for d in DIMS for x in ("t", "g", "n")]
    return work.settle(
        current.select(*DIMS, "tokens", probability.alias("probability"), *columns), "chances"
    )


def _by_cell(docs: DataFrame, topic: Column | None, *more: Column) -> DataFrame:
    text = F.col("text").cast("string")
    dims = (F.col("source"), F.col("lang"), topic_of(text) if topic is None else topic)
    return docs.select(
        *more,
        token_count(text).alias("tokens"),
        *[F.coalesce(d.cast("string"), F.lit(NONE)).alias(n) for d, n in zip(dims, DIMS)],
    )


def _check_keep(keep: float | None) -> None:
    if keep is not None and not 0 < keep <= 1:
        raise ValueError("keep must be above 0 and at most 1")


def mix_report(
    docs: DataFrame,
    keep: float,
    targets: dict[str, dict[str, float]] | None = None,
    temper: float = 0.7,
    sweeps: int = 6,
    topic: Column | None = None,
) -> DataFrame:
    """(dimension, value, target, share, supply, unmet) of each value with tokens.

    ``target`` and ``share``, the expected one, are shares of what stays; ``supply`` is the value's
    tokens in cells that may stay. ``unmet``: the supply is less than the target asks for.
    """
    _check_keep(keep)
    work = Workspace(docs.sparkSession, "mix_report")
    rows = _by_cell(docs, topic)
    cells = work.settle(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), "cells")
    chances = rake_bounded(cells, work, targets, temper, sweeps, keep)
    stays = F.col("tokens") * F.col("probability")
    total = float(chances.agg(F.sum(stays)).first()[0] or 1.0) or 1.0
    parts = None
    for dim in DIMS:
        part = (
            chances.where("tokens > 0")
            .groupBy(F.lit(dim.removeprefix("m_")).alias("dimension"), F.col(dim).alias("value"))
            .agg(
                F.first(f"t_{dim}").alias("target"),
                (F.sum(stays) / F.lit(total)).alias("share"),
                F.first(f"n_{dim}").cast("long").alias("supply"),
                (F.first(f"n_{dim}") < F.first(f"g_{dim}")).alias("unmet"),
            )
        )
        parts = part if parts is None else parts.unionByName(part)
    report = work.settle(parts, "report")
    work.close(keep=("report",))
    return report


def mix_sources(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    temper: float = 0.7,
    sweeps: int = 6,
    seed: str = "mix",
    topic: Column | None = None,
    keep: float | None = None,
) -> DataFrame:
    """(doc: struct of the input row, tokens, probability, kept) for every document.

    ``targets`` may hold shares for "source", "lang" and "topic"; ``keep`` is the share of all
    tokens that is expected to stay, see above.
    """
    _check_keep(keep)
    work = Workspace(docs.sparkSession, "mixing")
    rows = _by_cell(docs, topic, F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))
    cells = work.settle(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), "cells")
    if keep is None:
        raked = rake(cells, work, targets, temper, sweeps)
        ratio = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens"))
        largest = raked.agg(F.max(ratio)).first()[0] or 1.0
        chances = work.settle(
            raked.select(
                *DIMS, F.coalesce(ratio / F.lit(float(largest)), F.lit(1.0)).alias("probability")
            ),
            "chances",
        )
    else:
        raked = rake_bounded(cells, work, targets, temper, sweeps, keep)
        chances = raked.select(*DIMS, "probability")
    work.close(keep=("chances",))
    size = sum((F.octet_length(d) for d in DIMS), F.lit(16))
    joined = rows.join(maybe_broadcast(chances, size), list(DIMS))
    return joined.select(
        "doc",
        "tokens",
        *[F.col(d) for d in DIMS],
        "probability",
        (draw(F.col("doc.doc_id"), seed) < F.col("probability")).alias("kept"),
    )
