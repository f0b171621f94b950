"""Periodic runs in texts: stretches of words that repeat with a period, by bit-parallel lags.

The ids of a text's words are kept as bit planes, one large integer for each bit of an id. For a lag, each plane is XORed with itself
shifted by the lag and the results are ORed: zeros are places whose word comes again after the lag. Shift-doubling AND of the
zeros leaves the places where a long enough stretch of them begins, which are the runs of that period.

Lags up to SMALL_LAG are all tried. A longer lag q can only have a run where an aligned block of words (of a power of two, over q / 4) comes
again q words later, and not merely because both lie in a known run whose period divides q; block hashes find these lags in
n log n steps, so a long text without repeats costs no quadratic number of lags. False hits of the hashes are refuted by the planes.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import WORD, row_map

LEAST_WORDS = 12
SMALL_LAG = 32

_STEP = 0x9E3779B97F4A7C15
_WORDS = re.compile(WORD)


def _ids(words: Sequence[str]) -> tuple[np.ndarray, int]:
    """Words by the order of their first occurrence, and how many differ."""
    seen: dict[str, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64), len(seen)


def _planes(ids: np.ndarray, distinct: int) -> list[int]:
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range((distinct - 1).bit_length())]


def _stretches(planes: list[int], n: int, lag: int, least: int) -> list[tuple[int, int]]:
    """Start and length of each maximal stretch of at least `least` places whose word comes again after lag words."""
    size = n - lag
    if size < least:
        return []
    mask, differ = (1 << size) - 1, 0
    x = mask
    for at in range(0, max(1, len(planes)), 4):
        for plane in planes[at : at + 4]:
            differ |= plane ^ (plane >> lag)
        x = ~differ & mask
        have = 1
        while x and have < least:
            step = min(have, least - have)
            x &= x >> step
            have += step
        if not x:
            return []
    # an edge at i: bit i of x differs from bit i - 1
    edges = (x ^ (x << 1)).to_bytes(size // 8 + 1, "little")
    places = np.flatnonzero(np.unpackbits(np.frombuffer(edges, np.uint8), bitorder="little"))
    return [(int(a), int(b - a) + least - 1) for a, b in zip(places[::2], places[1::2], strict=True)]


def _explained(places: np.ndarray, lag: int, width: int, known: dict[int, list[tuple[int, int]]]) -> bool:
    """Whether every one of the blocks at places, and what stands lag words later, lies in one known run whose period divides the lag."""
    for period, stretches in known.items():
        if lag % period == 0:
            for lo, hi in stretches:
                places = places[(places < lo) | (places + lag + width > hi)]
                if not len(places):
                    return True
    return False


def find_runs(words: Sequence[str], least_words: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period.

    A run is a stretch of consecutive words with the smallest period q and a length of at least max(least_words, 2 q), which no
    neighbouring word extends with that period.
    """
    n = len(words)
    if n < max(2, least_words):
        return []
    ids, distinct = _ids(words)
    planes = _planes(ids, distinct)
    found: dict[tuple[int, int], int] = {}
    known: dict[int, list[tuple[int, int]]] = {}

    def look(lag: int) -> None:
        for start, same in _stretches(planes, n, lag, max(1, least_words - lag, lag)):
            # the same stretch with a smaller period: that one divides this lag
            if (start, same + lag) not in found:
                found[start, same + lag] = lag
                known.setdefault(lag, []).append((start, start + same + lag))

    for lag in range(1, min(SMALL_LAG, n // 2 + 1)):
        look(lag)
    h, width = ids.astype(np.uint64) * np.uint64(_STEP), 1
    h ^= h >> np.uint64(29)
    while 2 * width <= n // 2:
        if 4 * width > SMALL_LAG:
            # rows: aligned blocks; columns: lags from 2 to 4 widths
            first = np.arange(0, len(h) - 2 * width, width)
            later = np.concatenate([h, np.zeros(4 * width, np.uint64)])
            rows = np.lib.stride_tricks.sliding_window_view(later, 2 * width)[first + 2 * width]
            hits = rows == h[first][:, None]
            # places past the end are padding
            hits &= first[:, None] + np.arange(2 * width, 4 * width) < len(h)
            for column in np.flatnonzero(hits.any(axis=0)).tolist():
                lag = 2 * width + column
                if SMALL_LAG <= lag <= n // 2 and not _explained(first[hits[:, column]], lag, width, known):
                    look(lag)
        if len(h) <= width:
            break
        h = h[:-width] * np.uint64(pow(_STEP, width, 1 << 64)) + h[width:]
        width *= 2
    return sorted((start, length, period) for (start, length), period in found.items())


def collapsed(words: Sequence[str], runs: Sequence[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return list(words)
    out, at = [], 0
    for lo, hi in sorted((start + period, start + length) for start, length, period in runs):
        if lo > at:
            out += words[at:lo]
        at = max(at, hi)
    return out + list(words[at:])


def periodic_runs(df: DataFrame, keep: Sequence[Column], text: Column, least_words: int = LEAST_WORDS) -> DataFrame:
    """The columns `keep`, and runs array<struct<start,length,period>> (longs, by start, then period) and collapsed string
    (the kept words joined by one space): see find_runs.

    One row for each row of df, in one pass without a shuffle. A null text has no words; rows that repeat get the same runs. Texts
    are taken whole, whatever their length.
    """

    def one(value: str | None) -> tuple:
        words = _WORDS.findall(value or "")
        runs = find_runs(words, least_words)
        return [{"start": s, "length": n, "period": q} for s, n, q in runs], " ".join(collapsed(words, runs))

    return row_map(df, keep, text, lambda: one, "runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_period(words: Column, first: Column, period: Column) -> Column:
    """The words from number `first` on become repetitions of the `period` words there."""
    return F.transform(words, lambda w, i: F.when(i >= first, F.get(words, (first + (i - first) % period).cast("int"))).otherwise(w))
