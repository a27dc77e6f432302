"""Document fingerprints by locally consistent parsing.

A text starts as a row of symbols, its code points. One level of parsing
1. joins a run of one symbol into a symbol named by the symbol and the run's length,
2. tosses deterministic coins: each symbol is replaced by the place and value of the lowest bit in which it differs
   from its left neighbour, again and again, until the labels are below 6 and neighbours still differ,
3. starts a phrase at each local maximum of the labels, and names each phrase by a hash of its symbols.
The names are the symbols of the next level. A boundary depends on a few neighbouring symbols alone, so equal
substrings are cut and named alike but for their margins, wherever they stand.

The fingerprint keeps, level by level, the `KEPT` least names in hex; a level's share of common names is a bottom-k
estimate of the Jaccard similarity of the two sets of phrases. The likeness of two fingerprints is the mean over the
levels from the second on at which both texts have at least `ENOUGH` phrases, or else that of the first level.

Cases: a null text is an empty one; an empty text has an empty fingerprint, which is like (1) another empty one and
unlike (0) all others; texts of any length are parsed whole; null doc_ids come first in the order of ids; rows that
share a doc_id are ordered by their texts' hash; a table's only document is its own next one; no rows give no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import in_small_batches, text_or_empty, with_neighbours
from evidentia.llm.words import RUN_CHARS, _powers, code_points, mix, runs

LEVELS = (1, 2, 3, 4)
KEPT = 24
#: Characters that are parsed in one go, so that the arrays stay in the processor's cache.
RUN = 50_000
ENOUGH = 6
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _low_bit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """2 * place + value of the lowest bit in which a and b differ."""
    x = a ^ b
    place = np.bitwise_count((x & (~x + x.dtype.type(1))) - x.dtype.type(1)).astype(np.uint8)
    return (place << np.uint8(1)) | ((a >> place.astype(a.dtype)) & a.dtype.type(1)).astype(np.uint8)


def parse_level(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrase names of rows of symbols that begin at `starts` (ascending, none empty), and where they begin now."""
    n = len(symbols)
    first = np.zeros(n, bool)
    first[starts] = True
    heads = np.flatnonzero(first | np.concatenate(([True], symbols[1:] != symbols[:-1])))
    lengths = np.diff(np.append(heads, n))
    symbols, first = symbols[heads], first[heads]
    runs = lengths > 1
    symbols[runs] = mix(symbols[runs] + lengths[runs].astype(np.uint64) * _STEP)
    n = len(symbols)

    at, labels = np.flatnonzero(first), symbols
    for _ in range(4):
        own = (labels[at] & labels.dtype.type(1)).astype(np.uint8)  # a row's first symbol has no left neighbour
        labels = _low_bit(labels, np.concatenate((labels[:1], labels[:-1])))
        labels[at] = own
    left = np.concatenate((labels[:1], labels[:-1]))
    right = np.concatenate((labels[1:], labels[:1]))
    right[np.append(at[1:], n) - 1] = 0  # nothing follows a row's last symbol
    peak = (labels > left) & (labels >= right)
    peak[1:] &= ~first[:-1]  # no phrase of a row's first symbol alone
    begin = np.flatnonzero(peak | first)
    ends = np.append(begin[1:], n)
    up, down = _powers(1 << max(n, 2).bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(symbols) * up[:n], out=sums[1:])
    names = mix((sums[ends] - sums[begin]) * down[begin] + (ends - begin).astype(np.uint64))
    return names, np.flatnonzero(first[begin])


def phrase_levels(texts: list[str], levels: int) -> list[list[np.ndarray]]:
    """For each level, the phrase names of each text in order."""
    some = [i for i, t in enumerate(texts) if t]
    out = [[np.zeros(0, np.uint64)] * len(texts) for _ in range(levels)]
    if not some:
        return out
    symbols = mix((code_points("".join(texts[i] for i in some)).astype(np.uint64) + np.uint64(1)) * _STEP)
    starts = np.cumsum([0, *[len(texts[i]) for i in some[:-1]]])
    for level in range(levels):
        symbols, starts = parse_level(symbols, starts)
        for i, (a, b) in zip(some, pairwise([*starts.tolist(), len(symbols)]), strict=True):
            out[level][i] = symbols[a:b]
    return out


def _kept(names: np.ndarray) -> np.ndarray:
    """The KEPT least distinct names, as 32-bit numbers."""
    names = (names >> np.uint64(32)).astype(np.uint32)
    if len(names) > 8 * KEPT:
        least = np.unique(np.partition(names, 4 * KEPT)[: 4 * KEPT])
        if len(least) >= KEPT:
            return least[:KEPT]
    return np.unique(names)[:KEPT]


def fingerprints(texts: list[str]) -> list[str]:
    """The least names of each text in hex, level by level, with a dot between levels."""
    out = []
    for a, b in runs(texts, RUN):
        parsed = phrase_levels(texts[a:b], LEVELS[-1])
        out += [".".join(_kept(parsed[level - 1][i]).astype(">u4").tobytes().hex() for level in LEVELS) if text else "" for i, text in enumerate(texts[a:b])]
    return out


def _least(shown: str) -> list[int]:
    return [int(shown[i : i + 8], 16) for i in range(0, len(shown), 8)]


def likeness(a: str, b: str) -> float:
    """The estimated share of phrases that two fingerprints' texts have in common, from 0 to 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    pairs = [(_least(x), _least(y)) for x, y in zip(a.split("."), b.split("."), strict=True)]
    good = [p for p in pairs[1:] if min(map(len, p)) >= ENOUGH] or pairs[:1]
    return sum(_share(set(x), set(y)) for x, y in good) / len(good)


def _share(x: set[int], y: set[int]) -> float:
    least = sorted(x | y)[: KEPT if max(len(x), len(y)) >= KEPT else None]
    return sum(v in x and v in y for v in least) / len(least)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first characters of the one that follows, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FINGERPRINTED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprinted(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and its likeness to this and to the next one's."""
    least = -(1 << 63)
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(least))).withColumn("tie", F.xxhash64("text"))

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, held, block, closed = [], 0, None, False
        for frame in frames:
            for doc, text, in_block, role in zip(frame["doc_id"], frame["text"], frame["__ev_block"], frame["__ev_role"], strict=True):
                if in_block != block:
                    if block is not None and not closed:
                        raise ValueError("a block has no row after its last one")
                    block, closed = in_block, False
                if closed:
                    continue
                waiting.append((doc, text, role))
                held, closed = held + len(text), role > 0
                if held > RUN_CHARS:
                    yield _measured(waiting)
                    waiting, held = waiting[-1:] if role == 0 else [], 0
        if len(waiting) > 1:
            yield _measured(waiting)

    return with_neighbours(rows, "key", F.octet_length("text"), measure, FINGERPRINTED, before=False, wrap=True, ties=["tie"])


def _measured(waiting: list[tuple]) -> pd.DataFrame:
    """Results of all rows but those that only follow another one; each is followed by the next in the list."""
    texts = [w[1] for w in waiting]
    of = [i for i in range(len(waiting) - 1) if waiting[i][2] == 0]
    changed = [edited(texts[i], texts[i + 1]) for i in of]
    shown, shown_changed = fingerprints(texts), fingerprints(changed)
    ids = pd.array([None if pd.isna(waiting[i][0]) else int(waiting[i][0]) for i in of], dtype="Int64")
    return pd.DataFrame(
        {
            "doc_id": ids,
            "n_chars": [len(texts[i]) for i in of],
            "edited_sha256": [hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed],
            "fingerprint": [shown[i] for i in of],
            "edited_fingerprint": shown_changed,
            "near_edited": [likeness(shown[i], c) for i, c in zip(of, shown_changed, strict=True)],
            "near_next": [likeness(shown[i], shown[i + 1]) for i in of],
        }
    )
