"""Language identification by unigram piece models, summed over all segmentations.

Method: a fixed public sub-word vocabulary is shared by all languages; each language has its own
probabilities of the pieces. A word's probability in a language is the sum over all ways to cut
it into pieces, found by a forward pass over its characters; a text's score is the product over
its words. Probabilities come from expectation-maximisation: expected piece counts under all
segmentations (forward-backward) of training words, a few rounds, then smoothing.

Words are runs of letters, lower-cased, with the vocabulary's word mark in front. A character
outside the vocabulary is one unknown piece with a probability of its own. Forward passes run
over all distinct words of a batch at once, grouped by length; word scores are cached. Pieces
carry a constant factor for each of their characters, which is the same for all segmentations of
a word and is taken out at the end: no sum leaves the range of a double while a character costs
less than a factor of 10^12, and no word has more than 40.

Only the fit is bounded: ``max_texts`` training texts of each language, drawn by a hash of the
id and text; everything else covers whole texts of all documents, row by row, without a shuffle.

Defined results
- Null texts and texts without a letter: language "und", score 1 / (number of languages).
- The score is the posterior of the predicted language with equal priors; ties go to the
  alphabetically first language.
- Words of more than 40 characters are cut into runs of 40 before scoring.
- Rows without a language or text teach nothing. Without any training row all texts are "und"
  with score 0. Repeated rows score alike. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.session import Workspace

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
LONGEST_WORD, LONGEST_PIECE = 40, 16
TABLE_BITS = 18
CACHE_WORDS = 200_000
CHARACTER_SCALE = 1e5
UND = "und"
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Pieces:
    """Piece ids of substrings, through an open-addressed table of 64-bit hashes."""

    def __init__(self, path: str = VOCABULARY):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        texts = [
            model.id_to_piece(i)
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        ]
        texts = sorted({t for t in texts if t == t.lower() and len(t) <= LONGEST_PIECE})
        self.unknown = len(texts)
        self.size = len(texts) + 1
        self.scale = CHARACTER_SCALE ** np.array([*map(len, texts), 1], np.float64)
        hashes = np.array([self._hash_text(t) for t in texts], np.uint64)
        self.keys = np.zeros(1 << TABLE_BITS, np.uint64)
        self.ids = np.full(1 << TABLE_BITS, -1, np.int32)
        self.reach = 1
        for i, h in enumerate(hashes.tolist()):
            slot, steps = h >> (64 - TABLE_BITS), 1
            while self.ids[slot] >= 0:
                slot, steps = (slot + 1) & ((1 << TABLE_BITS) - 1), steps + 1
            self.keys[slot], self.ids[slot] = h, i
            self.reach = max(self.reach, steps)

    @staticmethod
    def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        h = (h ^ (code + np.uint64(1))) * BASE
        return h ^ (h >> np.uint64(32))

    def _hash_text(self, text: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in text:
            h = self._step(h, np.array([ord(c)], np.uint64))
        return int((h * BASE)[0])

    def lookup(self, h: np.ndarray) -> np.ndarray:
        h = h * BASE
        slot = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        out = np.where(self.keys[slot] == h, self.ids[slot], -1)
        for k in range(1, self.reach):
            left = np.flatnonzero(out < 0)
            if not len(left):
                break
            at = (slot[left] + k) & ((1 << TABLE_BITS) - 1)
            out[left] = np.where(self.keys[at] == h[left], self.ids[at], -1)
        return out

    def edges(self, codes: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, ids) of the pieces in words of one length (rows x length).

        Ordered by start; single characters outside the vocabulary give the unknown piece.
        """
        n = codes.shape[1]
        out = []
        for start in range(n):
            h = np.zeros(len(codes), np.uint64)
            for end in range(start + 1, min(n, start + LONGEST_PIECE) + 1):
                h = self._step(h, codes[:, end - 1])
                ids = self.lookup(h)
                if end == start + 1:
                    ids = np.where(ids < 0, self.unknown, ids)
                rows = np.flatnonzero(ids >= 0)
                if len(rows):
                    out.append((start, end, rows, ids[rows]))
        return out


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the words, matrix of their code points) for each length."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        text = "".join([words[i] for i in rows])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        yield rows, codes.reshape(len(rows), n).astype(np.uint64)


@dataclass
class Model:
    languages: list[str]
    probabilities: np.ndarray  # pieces x languages
    path: str


def forward(pieces: Pieces, prob: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word in each language, summed over all segmentations."""
    out = np.zeros((len(words), prob.shape[1]))
    prob = prob * pieces.scale[:, None]
    for rows, codes in by_length(words):
        n = codes.shape[1]
        alpha = np.zeros((n + 1, len(rows), prob.shape[1]))
        alpha[0] = 1
        for start, end, at, ids in pieces.edges(codes):
            alpha[end][at] += alpha[start][at] * prob[ids]
        out[rows] = np.log(alpha[n]) - n * np.log(CHARACTER_SCALE)
    return out


def expected_counts(
    pieces: Pieces, prob: np.ndarray, words: list[str], times: np.ndarray
) -> np.ndarray:
    """Expected uses of each piece in one language (prob: vector) over weighted words."""
    total = np.zeros(pieces.size)
    prob = prob * pieces.scale
    for rows, codes in by_length(words):
        n = codes.shape[1]
        edges = pieces.edges(codes)
        alpha, beta = np.zeros((n + 1, len(rows))), np.zeros((n + 1, len(rows)))
        alpha[0], beta[n] = 1, 1
        for start, end, at, ids in edges:
            alpha[end][at] += alpha[start][at] * prob[ids]
        for start, end, at, ids in reversed(edges):
            beta[start][at] += beta[end][at] * prob[ids]
        share = times[rows] / alpha[n]
        for start, end, at, ids in edges:
            np.add.at(total, ids, alpha[start][at] * prob[ids] * beta[end][at] * share[at])
    return total


def words_of(text: str | None) -> list[str]:
    words = LETTERS.findall((text or "").lower())
    if not all(map(str.isalpha, words)):  # numerals such as ² count as word characters there
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    out = []
    for word in words:
        word = MARK + word
        if len(word) <= LONGEST_WORD:
            out.append(word)
        else:
            out += [word[i : i + LONGEST_WORD] for i in range(0, len(word), LONGEST_WORD)]
    return out


def train(
    texts: Iterable[tuple[str, str]], path: str = VOCABULARY, rounds: int = 4, smooth: float = 0.05
) -> Model:
    """Fit piece probabilities to (language, text) pairs."""
    counts: dict[str, Counter[str]] = {}
    for lang, text in texts:
        counts.setdefault(lang, Counter()).update(words_of(text))
    languages = sorted(counts)
    pieces = Pieces(path)
    columns = []
    for lang in languages:
        words = sorted(counts[lang])
        times = np.array([counts[lang][w] for w in words], np.float64)
        prob = np.full(pieces.size, 1 / pieces.size)
        for _ in range(rounds if words else 0):
            used = expected_counts(pieces, prob, words, times) + smooth
            prob = used / used.sum()
        columns.append(prob)
    probabilities = np.column_stack(columns) if columns else np.zeros((pieces.size, 0))
    return Model(languages, probabilities, path)


class Scorer:
    """Log scores of texts, with a bounded cache of word scores."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, Pieces(model.path)
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each text in each language, number of words)."""
        lists = [words_of(t) for t in texts]
        if len(self.index) > CACHE_WORDS:
            self.index, self.scores = {}, self.scores[:0]
        new = list({w for words in lists for w in words if w not in self.index})
        if new:
            at = len(self.index)
            self.index.update(zip(new, range(at, at + len(new))))
            found = forward(self.pieces, self.model.probabilities, new)
            self.scores = np.concatenate([self.scores, found])
        counts = np.array([len(words) for words in lists], np.int64)
        flat = np.fromiter(
            (self.index[w] for words in lists for w in words), np.int64, int(counts.sum())
        )
        total = np.zeros((len(texts), len(self.model.languages)))
        np.add.at(total, np.repeat(np.arange(len(texts)), counts), self.scores[flat])
        return total, counts


def fit(
    docs: DataFrame,
    learn: Column,
    max_texts: int = 300,
    path: str = VOCABULARY,
) -> Model:
    """Fit on documents with a language for which ``learn`` (over k_id) holds."""
    work = Workspace(docs.sparkSession, "language_id")
    known = docs.select(
        F.col("doc_id").cast("long").alias("k_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"),
    ).where("lang is not null and text is not null").where(learn)
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    rate = F.least(F.lit(1.0), F.lit(float(max_texts)) / F.col("n"))
    luck = F.pmod(F.xxhash64(F.lit("language"), "k_id", F.length("text")), F.lit(1 << 30))
    rates = work.settle(counts.select("lang", rate.alias("rate")), "rates")
    drawn = known.join(F.broadcast(rates), "lang").where(luck / float(1 << 30) < F.col("rate"))
    # About max_texts rows of each language reach the driver, whatever the size of the table.
    texts = [(r.lang, r.text) for r in drawn.select("lang", "text").toLocalIterator()]
    work.close()
    return train(sorted(texts), path)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with columns lang_pred and score."""
    block = 256

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        names = np.array([*model.languages, UND], dtype=object)
        for texts in batches:
            picked, sure = [], []
            for low in range(0, len(texts), block):
                total, counts = scorer(list(texts.iloc[low : low + block]))
                if not model.languages:
                    picked += [UND] * len(counts)
                    sure += [0.0] * len(counts)
                    continue
                best = total.argmax(axis=1)
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                score = 1 / odds.sum(axis=1)
                picked += list(names[np.where(counts > 0, best, len(model.languages))])
                sure += list(score)
            yield pd.DataFrame({"lang_pred": picked, "score": sure})

    text = F.col("text").cast("string")
    told = docs.drop("lang_pred", "score").withColumn("_told", predict(text))
    return told.select(
        *[c for c in docs.columns if c not in ("lang_pred", "score")],
        F.col("_told.lang_pred").alias("lang_pred"),
        F.col("_told.score").alias("score"),
    )
