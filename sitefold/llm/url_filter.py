"""URL rules by a bit-parallel wildcard automaton.

Method: each glob is a chain of states, one bit each; the bits of all globs are packed into
64-bit words. One Shift-And step per byte of a URL moves all globs at once:
``D = (D << 1) & B[byte] | D & S[byte]``, where B holds the states that the byte enters and S
those that it may stay in (wildcards). Steps run over many URLs at a time.

Globs: ``*`` any bytes but ``/``, ``**`` any bytes, ``?`` one byte but ``/``. A rule (host,
path) becomes ``*.host`` + path + ``**`` over the canonical text ``.host`` + path of a URL, so
it fits the host and all its subdomains, and ``*`` cannot run from the host into the path.

Defined results
- url null or without ``://``: host and path are empty, no rule fits, the default verdict.
- Of several rules that fit, the longest wins; of equally long ones the first in the list.
- Rows are judged one by one: repeated rows get equal verdicts, an empty table gives no rows,
  further columns pass through unless they carry the names of the new columns.
- Very long URLs are walked to their end; memory stays proportional to the batch of URLs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLASH = ord("/")
BLOCK = 2048
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> bytes:
        return f"*.{self.host}{self.path}**".encode()


class GlobSet:
    """Transition masks of many globs, as numpy arrays of uint64 words."""

    def __init__(self, globs: list[bytes]):
        enter: list[np.ndarray] = []  # per state: bytes that lead into it
        stay: list[np.ndarray] = []  # per state: bytes it survives
        starts, ends = [], []
        for glob in globs:
            starts.append(len(enter))
            enter.append(np.zeros(256, bool))
            stay.append(np.zeros(256, bool))
            at = 0
            while at < len(glob):
                if glob[at : at + 2] == b"**":
                    stay[-1][:] = True
                    at += 2
                    continue
                if glob[at : at + 1] == b"*":
                    loop = stay[-1].copy()
                    stay[-1][:] = True
                    stay[-1][SLASH] = loop[SLASH]
                else:
                    accepts = np.zeros(256, bool)
                    if glob[at : at + 1] == b"?":
                        accepts[:] = True
                        accepts[SLASH] = False
                    else:
                        accepts[glob[at]] = True
                    enter.append(accepts)
                    stay.append(np.zeros(256, bool))
                at += 1
            ends.append(len(enter) - 1)
        self.words = max(1, -(-len(enter) // 64))
        self.enter = self._pack(enter)
        self.stay = self._pack(stay)
        self.start = self._bits(starts)
        self.ends = ends

    def _pack(self, states: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((256, self.words), np.uint64)
        for state, accepts in enumerate(states):
            out[accepts, state // 64] |= np.uint64(1 << state % 64)
        return out

    def _bits(self, states: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for state in states:
            out[state // 64] |= np.uint64(1 << state % 64)
        return out

    def run(self, texts: list[bytes]) -> np.ndarray:
        """Boolean matrix (text, glob): does the glob match the whole text."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        found = np.zeros((len(texts), len(self.ends)), bool)
        for low in range(0, len(texts), BLOCK):
            rows = order[low : low + BLOCK]
            found[rows] = self._run([texts[i] for i in rows], lengths[rows])
        return found

    def _run(self, texts: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """Texts come longest first, so the rows still being read are always a head."""
        data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        state = np.tile(self.start, (len(texts), 1))
        one, high = np.uint64(1), np.uint64(63)
        alive = len(texts)
        for at in range(int(lengths[0]) if len(texts) else 0):
            while alive and lengths[alive - 1] <= at:
                alive -= 1
            head = state[:alive]
            byte = data[first[:alive] + at]
            moved = head << one
            moved[:, 1:] |= head[:, :-1] >> high
            state[:alive] = (moved & self.enter[byte]) | (head & self.stay[byte])
        out = np.zeros((len(texts), len(self.ends)), bool)
        for i, end in enumerate(self.ends):
            out[:, i] = (state[:, end // 64] >> np.uint64(end % 64)) & one != 0
        return out


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER)


def url_path(url: Column) -> Column:
    rest = F.coalesce(after_scheme(url), F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """Add host, path, rule (null if none fits) and verdict to a table with a column url."""
    ranked = sorted(rules, key=lambda r: -len(r.name))
    names = [r.name for r in ranked]

    @F.pandas_udf("string")
    def best_rule(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        globs = GlobSet([r.glob for r in ranked])
        for texts in batches:
            found = globs.run([t.encode() for t in texts])
            some = found.any(axis=1) if names else np.zeros(len(texts), bool)
            best = found.argmax(axis=1) if names else np.zeros(len(texts), int)
            yield pd.Series([names[b] if s else None for s, b in zip(some, best)], dtype=object)

    url = F.col("url").cast("string")
    verdict = F.lit(default)
    for r in reversed(ranked):
        verdict = F.when(F.col("rule") == r.name, r.verdict).otherwise(verdict)
    return (
        pages.withColumn("host", url_host(url))
        .withColumn("path", url_path(url))
        .withColumn("rule", best_rule(F.concat(F.lit("."), F.col("host"), F.col("path"))))
        .withColumn("verdict", verdict)
    )
