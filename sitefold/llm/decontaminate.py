"""Documents that contain benchmark passages, exactly or with a few edits.

Method: the q-gram lemma. A passage of m characters and a text region within e edits of it share
at least m - q + 1 - q*e of their q-grams, on diagonals (text position minus passage position)
at most e apart. So shared q-grams are counted in overlapping bands of diagonals; a band that
reaches the bound is a region to verify, all others are out. Verification is an alignment of the
passage with the region, limited to the band's diagonals.

Characters are code points of the lower-cased text with runs of ASCII white space as one blank.
The edit budget is a share of the passage length. Passages of more than ``piece`` characters are
cut into overlapping pieces, so a leak of a part of a long item is found too; an item counts as
found if one of its pieces is.

Items of fewer than ``least`` characters have no edits to spare: they are searched for exactly,
as whole words (no letter or digit next to a letter or digit of theirs), by the hashes of all runs
of their length.

The benchmark is read in blocks of bounded size (measured), one pass over the documents for each
block; the index of a block is broadcast, and its finds are written before the next is read, so
the driver holds one block at a time. Documents are judged row by row: no shuffle of text, no
group of any size in one task.

Defined results
- Null or empty texts and items (also those of white space alone) hold nothing and are found
  nowhere. Any other item is searched for, however short.
- Repeated documents get equal results; repeated items are found under each of their ids, and
  equal ids count as one. Items with a null id are searched for under the id -1.
- An empty table on either side gives no rows; further columns are passed over.
- A very long text is one row with memory in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm.frames import join_key, keyed
from sitefold.llm.words import U64, mix
from sitefold.session import Workspace

Q, EDIT_SHARE, PIECE, LEAST = 10, 0.08, 160, 32
BLOCK_BYTES = 4 * 1024 * 1024
SLICE_CHARS = 1 << 19
BAND = 32
TABLE_BITS = 22
OUTSIDE = np.uint32(0xFFFFFFFF)  # no code point
BASE = 0x9E3779B97F4A7C15 | 1
LEAKS = "k_id long, k_hash long, items array<long>, edits array<int>"
BLANKS = np.zeros(128, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True


def normal_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised texts, one after the other, and their offsets."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    blank = BLANKS[np.minimum(codes, 127)] & (codes < 128)
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    starts = offsets[:-1][offsets[:-1] < len(codes)]
    keep[starts] = ~blank[starts]
    before = np.concatenate([[0], np.cumsum(keep)])
    return np.where(blank, np.uint32(32), codes)[keep], before[offsets]


def qgram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of each run of q characters, by doubling: run of 2n = run of n and the next one."""
    if len(codes) < q:
        return np.zeros(0, U64)
    whole, size, used = None, 1, 0
    power = (codes.astype(U64) + U64(1)) * U64(BASE)
    power ^= power >> U64(29)
    n = len(codes) - q + 1
    rest = q
    while True:
        if rest & 1:
            part = power[used : used + n]
            whole = part if whole is None else whole * U64(BASE) + part
            used += size
        rest >>= 1
        if not rest:
            return mix(whole)
        power = power[: len(power) - size] * U64(0xD6E8FEB86659FD93) + power[size:]
        power ^= power >> U64(31)
        size *= 2


def wordlike(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters or digits."""
    kinds, which = np.unique(codes, return_inverse=True)
    return np.array([c != OUTSIDE and chr(c).isalnum() for c in kinds], bool)[which]


class ShortItems:
    """Items of one length, too short for edits: found exactly, as whole words."""

    def __init__(self, length: int, items: list[tuple[int, np.ndarray]]):
        self.length = length
        codes = np.array([c for _, c in items])
        hashes = qgram_hashes(codes.ravel(), length)[::length]
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.codes = hashes[order], codes[order]
        self.items = np.array([item for item, _ in items], np.int64)[order]

    def hits(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) of all finds, repeats among them."""
        runs = qgram_hashes(codes, self.length)
        low = np.searchsorted(self.hashes, runs)
        at = np.flatnonzero(self.hashes[np.minimum(low, len(self.hashes) - 1)] == runs)
        text = np.searchsorted(offsets, at, "right") - 1
        start, end = offsets[text], offsets[text + 1]
        inside = at + self.length <= end
        at, text, start, end = at[inside], text[inside], start[inside], end[inside]
        edge = np.append(codes, OUTSIDE)
        before = np.where(at > start, edge[at - 1], OUTSIDE)
        after = np.where(at + self.length < end, edge[at + self.length], OUTSIDE)
        whole = ~(wordlike(before) & wordlike(edge[at]))
        whole &= ~(wordlike(after) & wordlike(edge[at + self.length - 1]))
        at, text = at[whole], text[whole]
        first = np.searchsorted(self.hashes, runs[at])
        times = np.searchsorted(self.hashes, runs[at], "right") - first
        of = np.repeat(np.arange(len(at)), times)
        which = np.arange(len(of)) - (np.cumsum(times) - times)[of] + first[of]
        same = np.ones(len(of), bool)
        for i in range(self.length):
            same &= codes[at[of] + i] == self.codes[which, i]
        return text[of][same], self.items[which][same]


class Passages:
    """Pieces of benchmark items and the index of their q-grams."""

    def __init__(self, items: list[tuple[int, str]], q: int, share: float, piece: int, least: int):
        self.q = q
        self.codes: list[np.ndarray] = []
        self.item: list[int] = []
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, text in items:
            codes, _ = normal_codes([text.strip(" \t\n\v\f\r")])
            if len(codes) < max(least, q):
                if len(codes):
                    by_length.setdefault(len(codes), []).append((item, codes))
                continue
            last = max(0, len(codes) - piece)
            for at in [*range(0, last, piece // 2), last]:
                self.codes.append(codes[at : at + piece])
                self.item.append(item)
        lengths = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.floor(lengths * share).astype(np.int64)
        self.bound = np.maximum(1, lengths - q + 1 - q * self.edits)
        grams = [qgram_hashes(c, q) for c in self.codes]
        hashes = np.concatenate([*grams, np.zeros(0, U64)])
        piece_of = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*[np.arange(len(g)) for g in grams], np.zeros(0, np.int64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, first = np.unique(hashes[order], return_index=True)
        self.first = np.append(first, len(hashes))
        self.piece_of, self.place = piece_of[order], place[order].astype(np.int64)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.hashes >> U64(64 - TABLE_BITS)).astype(np.int64)] = True
        self.short = [ShortItems(length, some) for length, some in sorted(by_length.items())]

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text position, piece, piece position) of all shared q-grams."""
        grams = qgram_hashes(codes, self.q)
        at = np.flatnonzero(self.table[(grams >> U64(64 - TABLE_BITS)).astype(np.int64)])
        known = np.searchsorted(self.hashes, grams[at])
        known = np.minimum(known, max(0, len(self.hashes) - 1))
        same = self.hashes[known] == grams[at] if len(self.hashes) else np.zeros(0, bool)
        at, known = at[same], known[same]
        times = self.first[known + 1] - self.first[known]
        of = np.repeat(np.arange(len(at)), times)
        which = np.arange(len(of)) - (np.cumsum(times) - times)[of] + self.first[known][of]
        return at[of], self.piece_of[which], self.place[which]


def span(codes: np.ndarray, low: int, high: int) -> np.ndarray:
    """Positions low to high, with OUTSIDE where they lie before or after the text.

    A region keeps all diagonals of its band so, also at the ends of a text. To replace OUTSIDE
    costs what it costs to leave the passage's character out, so no distance changes.
    """
    inside = codes[max(0, low) : max(0, high)]
    return np.pad(
        inside,
        (max(0, -low), max(0, high - max(len(codes), low))),
        constant_values=OUTSIDE,
    )


def band_edits(piece: np.ndarray, region: np.ndarray, most: int) -> int:
    """Smallest number of edits between the piece and any part of the region, or most + 1.

    The region is the band: its start belongs to the band's lowest diagonal, so row i of the
    alignment covers region positions i to i + width, one cell for each diagonal.
    """
    width = len(region) - len(piece)
    step = np.arange(width + 1)
    row = np.zeros(width + 1, np.int64)
    for i in range(len(piece)):
        across = row + (region[i : i + width + 1] != piece[i])[: width + 1]
        down = np.append(row[1:] + 1, most + len(piece))
        row = np.minimum(across, down)
        row = np.minimum.accumulate(row - step) + step
        if row.min() > most:
            return most + 1
    return int(row.min())


def find_leaks(
    passages: Passages, codes: np.ndarray, offsets: np.ndarray
) -> dict[int, dict[int, int]]:
    """For each text with leaks: found item -> edits of its best piece."""
    found = _long_leaks(passages, codes, offsets)
    for short in passages.short:
        for one, item in set(zip(*(x.tolist() for x in short.hits(codes, offsets)))):
            found.setdefault(one, {})[item] = 0
    return found


def _long_leaks(
    passages: Passages, codes: np.ndarray, offsets: np.ndarray
) -> dict[int, dict[int, int]]:
    at, piece, place = passages.hits(codes)
    text = np.searchsorted(offsets, at, "right") - 1
    inside = at + passages.q <= offsets[text + 1]
    at, piece, place, text = at[inside], piece[inside], place[inside], text[inside]
    # Diagonals from the text's start, shifted to be positive; two bands that overlap by the budget.
    longest = max((len(c) for c in passages.codes), default=0)
    diagonal = at - offsets[text] - place + longest
    band = diagonal // BAND
    low = diagonal - band * BAND < passages.edits[piece]
    low &= band > 0
    n_pieces = len(passages.codes)
    bands = int(np.max(np.diff(offsets), initial=0)) // BAND + longest // BAND + 2
    if not len(at):
        return {}
    both = np.concatenate([band, band[low] - 1])
    owner = np.concatenate([text * n_pieces + piece, (text * n_pieces + piece)[low]])
    key, shared = np.unique(owner * bands + both, return_counts=True)
    piece = key // bands % n_pieces
    reach = shared >= passages.bound[piece]
    found: dict[int, dict[int, int]] = {}
    order = np.flatnonzero(reach)
    for i in order[np.argsort(-shared[order], kind="stable")]:
        one, p = divmod(int(key[i]) // bands, n_pieces)
        best = found.setdefault(one, {})
        item, most = passages.item[p], int(passages.edits[p])
        if best.get(item, most + 1) == 0:
            continue
        pattern = passages.codes[p]
        start = int(key[i]) % bands * BAND - longest
        low_end, high_end = start - most, start + BAND + 2 * most + len(pattern)
        of = codes[offsets[one] : offsets[one + 1]]
        region = span(of, low_end, high_end)
        exact = region.tobytes().find(pattern.tobytes())
        edits = 0 if exact >= 0 and exact % 4 == 0 else band_edits(pattern, region, most)
        if edits <= most:
            best[item] = min(edits, best.get(item, edits))
    return {one: best for one, best in found.items() if best}


def _leaks(items: list[tuple[int, str]], q: int, share: float, piece: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(items, q, share, piece, least)
        for batch in batches:
            texts = batch.column("text")
            sizes = np.asarray(pa.compute.utf8_length(texts.fill_null("")))
            cuts = np.cumsum(sizes) // SLICE_CHARS
            rows, found = [], []
            for first in np.flatnonzero(np.append(True, cuts[1:] != cuts[:-1])) if len(cuts) else []:
                end = int(np.searchsorted(cuts, cuts[first], "right"))
                leaks = find_leaks(passages, *normal_codes(texts.slice(first, end - first).to_pylist()))
                for one in sorted(leaks):
                    rows.append(first + one)
                    found.append(sorted(leaks[one].items()))
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k_id").take(rows),
                    batch.column("k_hash").take(rows),
                    pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int64())),
                    pa.array([[e for _, e in f] for f in found], pa.list_(pa.int32())),
                ],
                names=["k_id", "k_hash", "items", "edits"],
            )

    return run


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    work: Workspace,
    q: int = Q,
    share: float = EDIT_SHARE,
    piece: int = PIECE,
    least: int = LEAST,
) -> DataFrame:
    """k_id, k_hash, item_id, edits (settled): benchmark items found in documents."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"),
        F.col("text").cast("string").alias("item"),
    ).where("item is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("item")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    rows = keyed(docs)
    leaks, names = None, []
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == block
        held = [(r.item_id, r.item) for r in items.where(mine).collect()]
        part = rows.mapInArrow(_leaks(held, q, share, piece, least), LEAKS)
        names.append(f"leaks_{block}")
        part = work.settle(part, names[-1])
        leaks = part if leaks is None else leaks.unionByName(part)
    pairs = leaks.select("k_id", "k_hash", F.explode(F.arrays_zip("items", "edits")).alias("hit"))
    found = work.settle(
        pairs.groupBy("k_id", "k_hash", F.col("hit.items").alias("item_id")).agg(
            F.min("hit.edits").alias("edits")
        ),
        "leaks",
    )
    for name in names:
        work.drop(name)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark passage."""
    work = Workspace(docs.sparkSession, "decontaminate")
    leaks = find_contamination(docs, benchmark, work)
    keys = work.settle(leaks.select("k_id", "k_hash").distinct(), "keys")
    work.drop("leaks")
    text = F.col("text").cast("string")
    rows = docs.select(
        *[F.col(c).alias(f"c_{c}") for c in docs.columns],
        F.col("doc_id").cast("long").alias("k_id"),
        F.xxhash64(text).alias("k_hash"),
    )
    kept = join_key(rows, keys, "left_anti", 32)
    return kept.select(*[F.col(f"c_{c}").alias(c) for c in docs.columns])
