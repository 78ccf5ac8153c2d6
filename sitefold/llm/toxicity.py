"""Toxicity by weak supervision: many noisy voters, a generative label model, a linear classifier.

Method
1. Voters. Each looks for one sign and votes "toxic" where it occurs, else abstains: words of a
   fixed lexicon, and patterns (whole words and word beginnings) that are over-represented in
   toxic training rows. The rows' own labels are one more voter, with errors of its own.
2. Label model. Votes are draws given a hidden label; EM estimates each voter's rates for toxic
   and clean rows. Votes that agree beyond what the hidden label explains are correlated: a
   voter's evidence is divided by one plus its positive residual correlations, so that ten
   spellings of one sign do not count as ten witnesses.
3. Classifier. A logistic regression on the voters' presence is fitted to the posterior labels
   and scores every whole text, one row at a time.

Only the fit is bounded: ``max_toxic`` and ``max_clean`` training rows, drawn by a hash of the
id out of all labelled rows; pattern counts over them are Spark aggregates. Class weights undo
the drawing, so scores keep the prior of the labels.

Defined results
- Null or empty texts get the score of a text without any sign.
- Labels other than 0 and 1, null ids and rows without a label teach nothing.
- Repeated rows score alike; several labels of one doc_id each count as a training row.
- Without labelled rows of both kinds, the lexicon alone scores: 0.9 with a sign, 0.1 without.
- An empty table gives no rows; further columns of the input stay.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitefold.session import Workspace

WORD = re.compile(r"\w+")
SHORTEST, LONGEST = 4, 8  # lengths of word beginnings

#: Insults of the four languages that the lexicon voters look for. Fixed values.
LEXICON = (
    "asshole", "bastard", "bitch", "clown", "crap", "creep", "damn", "degenerate", "despicable",
    "disgrace", "disgusting", "dumb", "filth", "fool", "freak", "garbage", "hate", "idiot",
    "idiotic", "imbecile", "jerk", "kill", "loser", "lunatic", "moron", "moronic", "pathetic",
    "pig", "psycho", "rat", "repulsive", "scum", "shit", "slut", "stupid", "sucker", "trash",
    "ugly", "vermin", "vile", "whore", "worthless",
    "abruti", "connard", "crétin", "débile", "ordure", "pourriture", "salaud", "salope",
    "arschloch", "abschaum", "dreck", "dummkopf", "idioten", "trottel", "versager",
    "basura", "cabrón", "escoria", "estúpido", "idiota", "imbécil", "perdedor", "puta",
)


@dataclass(frozen=True)
class Settings:
    max_toxic: int = 3000
    max_clean: int = 6000
    max_patterns: int = 500
    min_rows: int = 4  # toxic training rows with a pattern
    min_lift: float = 4.0
    em_turns: int = 30
    ridge: float = 1.0


def signs(text: str | None) -> set[str]:
    """Words ("=word") and word beginnings ("begin*") of a text."""
    out = set()
    for word in set(WORD.findall((text or "").lower())):
        out.add("=" + word)
        for n in range(SHORTEST, min(LONGEST, len(word) - 1) + 1):
            out.add(word[:n])
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def signs_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: sorted(signs(t)))


@dataclass
class Model:
    voters: list[str]
    weights: np.ndarray
    bias: float

    def scorer(self) -> Callable[[str | None], float]:
        whole = {v[1:]: w for v, w in zip(self.voters, self.weights) if v[0] == "="}
        begin = {v: w for v, w in zip(self.voters, self.weights) if v[0] != "="}
        bias = float(self.bias)

        def score(text: str | None) -> float:
            total, seen = bias, set()
            for word in set(WORD.findall((text or "").lower())):
                if word in whole:
                    total += whole[word]
                for n in range(SHORTEST, min(LONGEST, len(word) - 1) + 1):
                    head = word[:n]
                    if head in begin and head not in seen:
                        seen.add(head)
                        total += begin[head]
            return float(1 / (1 + np.exp(-np.clip(total, -50, 50))))

        return score


def label_model(votes: np.ndarray, gold: np.ndarray, weight: np.ndarray, turns: int) -> np.ndarray:
    """Posterior of the hidden label of each row, from 0/1 votes and the noisy given labels."""
    all_votes = np.column_stack([votes, gold]).astype(np.float64)
    m = all_votes.shape[1]
    post = np.clip(gold.astype(np.float64), 0.1, 0.9)
    discount = np.ones(m)
    for turn in range(turns):
        rates = []
        for side in (post * weight, (1 - post) * weight):
            mass = side.sum()
            rates.append((side @ all_votes + 0.5 * all_votes.mean(axis=0) + 0.01) / (mass + 0.5 + 0.02))
        toxic, clean = (np.clip(r, 1e-6, 1 - 1e-6) for r in rates)
        # No sign speaks for cleanness; the given label stays informative but fallible.
        toxic[:-1] = np.maximum(toxic[:-1], clean[:-1])
        toxic[-1], clean[-1] = min(toxic[-1], 0.98), max(clean[-1], 0.002)
        if turn % 5 == 0:
            discount = 1 / (1 + _extra_correlation(all_votes, post, toxic, clean))
        prior = np.clip((post * weight).sum() / weight.sum(), 1e-4, 1 - 1e-4)
        on = discount * np.log(toxic / clean)
        off = discount * np.log((1 - toxic) / (1 - clean))
        logit = np.log(prior / (1 - prior)) + all_votes @ on + (1 - all_votes) @ off
        new = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post


def _extra_correlation(
    votes: np.ndarray, post: np.ndarray, toxic: np.ndarray, clean: np.ndarray
) -> np.ndarray:
    """For each voter the sum of its positive correlations left after the hidden label."""
    rest = votes - np.outer(post, toxic) - np.outer(1 - post, clean)
    scale = np.sqrt((rest**2).sum(axis=0)) + 1e-9
    corr = (rest.T @ rest) / np.outer(scale, scale)
    np.fill_diagonal(corr, 0)
    corr[-1, :] = corr[:, -1] = 0  # the given labels are kept as they are
    return np.where(corr > 0.1, corr, 0).sum(axis=1)


def fit_linear(
    votes: np.ndarray, post: np.ndarray, weight: np.ndarray, ridge: float
) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps; signs may only speak for toxicity."""
    x = np.column_stack([votes.astype(np.float64), np.ones(len(votes))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    beta = np.zeros(x.shape[1])
    prior = np.clip((post * weight).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    beta[-1] = np.log(prior / (1 - prior))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        slope = x.T @ (weight * (post - p)) - penalty * beta
        curve = (x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        beta += step * min(1.0, 3.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return np.maximum(beta[:-1], 0), float(beta[-1])


def _lexicon_model() -> Model:
    odds = np.log(0.9 / 0.1)
    return Model(["=" + w for w in LEXICON], np.full(len(LEXICON), 2 * odds), -odds)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings()) -> Model:
    """Fit on the labelled rows for which ``learn`` (over doc_id) holds."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("k_id"), F.col("toxic").cast("int").alias("y"))
        .where("k_id is not null and y in (0, 1)")
        .where(learn)
    )
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return _lexicon_model()
    share = {y: min(1.0, most / counts[y]) for y, most in ((1, settings.max_toxic), (0, settings.max_clean))}
    # A number in [0, 1) from the id decides who is drawn: the same rows at every run.
    luck = F.pmod(F.xxhash64(F.lit("toxicity"), "k_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.where(luck < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    texts = docs.select(F.col("doc_id").cast("long").alias("k_id"), F.col("text").cast("string").alias("text"))
    # At most about max_toxic + max_clean ids: a bounded side.
    rows = texts.join(F.broadcast(drawn), "k_id").select("y", signs_of("text").alias("signs"))
    work = Workspace(docs.sparkSession, "toxicity")
    rows = work.settle(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return _lexicon_model()
    toxic, clean = F.sum("y"), F.sum(1 - F.col("y"))
    rate_t, rate_c = (F.col("t") + 0.5) / (sizes[1] + 1), (F.col("c") + 0.5) / (sizes[0] + 1)
    listed = F.col("sign").isin(["=" + w for w in LEXICON])
    found = (
        rows.select("y", F.explode("signs").alias("sign"))
        .groupBy("sign")
        .agg(toxic.alias("t"), clean.alias("c"))
        .where((F.col("t") >= settings.min_rows) | listed)
        .withColumn("lift", rate_t / rate_c)
        .where((F.col("lift") >= settings.min_lift) | listed)
        .withColumn("gain", F.col("t") * F.log("lift"))
        .orderBy(F.desc(listed), F.desc("gain"), "sign")
        .limit(settings.max_patterns)
        .collect()
    )
    voters = [r.sign for r in found]
    voters += ["=" + w for w in LEXICON if "=" + w not in set(voters)]
    votes_of = F.array_intersect("signs", F.array(*[F.lit(v) for v in voters]))
    seen = rows.select("row", "y", votes_of.alias("signs")).orderBy("row").collect()
    work.close()
    at = {v: i for i, v in enumerate(voters)}
    votes = np.zeros((len(seen), len(voters)), np.uint8)
    for i, r in enumerate(seen):
        votes[i, [at[s] for s in r.signs]] = 1
    gold = np.array([r.y for r in seen])
    weight = np.where(gold == 1, counts[1] / sizes[1], counts[0] / sizes[0])
    weight = weight / weight.mean()
    post = label_model(votes, gold, weight, settings.em_turns)
    # A lexicon word never met in training speaks as the weaker half of those that were.
    weights, bias = fit_linear(votes, post, weight, settings.ridge)
    unmet = votes.sum(axis=0) == 0
    met = weights[~unmet & (weights > 0)]
    weights[unmet] = np.median(met) if len(met) else 2.0
    return Model(voters, weights, bias)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with columns score (0 to 1) and predicted (1 if score >= 0.5)."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = model.scorer()
        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    scored = docs.withColumn("score", score(F.col("text").cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
