"""Periodic runs of words, found lag by lag on bit planes.

A text's words become numbers, and the numbers big integers: plane b has at bit i the b-th bit
of word i. A plane XORed with itself, shifted by a lag, shows where words that far apart differ
in that bit; the planes' mismatches ORed show where they differ at all. A run of period q is a
stretch of agreements with lag q. ANDing the agreements with themselves, shifted by 1, 2, 4 and
so on, leaves the places where a stretch that is long enough begins.

Which lags can have a run is known beforehand for all but the small ones. A run of period q with
Q < q <= 2Q that is at least three times q long agrees with itself, q words on, over whole windows
of Q words that begin at a multiple of Q; so only lags with such a window are tried. What lies
inside a run of a smaller period is no sign of another one: two runs share fewer words than
their periods together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import text as tw

#: Lags up to this one are all tried.
SMALL = 64
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def planes(numbers: np.ndarray) -> list[int]:
    """Bit b of every number as one big integer, for each b; at least one plane."""
    width = max(1, int(numbers.max(initial=0)).bit_length())
    bits = (numbers[None, :] >> np.arange(width)[:, None] & 1).astype(np.uint8)
    return [int.from_bytes(row.tobytes(), "little") for row in np.packbits(bits, axis=1, bitorder="little")]


def stretches(bits: list[int], n: int, lag: int, least: int) -> list[tuple[int, int]]:
    """(start, length) of each maximal stretch of at least `least` places i with word i = word i + lag."""
    differ, within = 0, (1 << (n - lag)) - 1
    for k, plane in enumerate(bits):
        differ |= plane ^ (plane >> lag)
        # Most lags are over after a few planes: no stretch is left that the others could keep.
        if k == 1 and not long_ones(~differ & within, min(least, 32)):
            return []
    agree = ~differ & within
    begin = long_ones(agree, least)
    found = []
    while begin:
        start = (begin & -begin).bit_length() - 1
        rest = (agree >> start) + 1
        length = (rest & -rest).bit_length() - 1
        found.append((start, length))
        begin = begin >> (start + length) << (start + length)
    return found


def long_ones(ones: int, least: int) -> int:
    """Bits at which `least` ones or more begin, by ANDs with shifts that double."""
    have = 1
    while ones and have < least:
        step = min(have, least - have)
        ones &= ones >> step
        have += step
    return ones


def likely_lags(numbers: np.ndarray, most: int, exponent: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Lags over `SMALL` and up to `most` in rising order, each with the windows (start, end) that agree at it."""
    n, size = len(numbers), SMALL
    hashes = tw.mix(numbers.astype(np.uint64) + np.uint64(1))
    total = tw.prefix(hashes)
    while size < most and n >= exponent * (size + 1):
        at = np.arange(n - size + 1)
        window = tw.span(total, at, at + size)
        anchors = window[::size]
        later = window[size + 1 :]
        whole = len(later) // size
        rows = [later[: whole * size].reshape(whole, size) == anchors[:whole, None]]
        # The last anchors have fewer windows behind them.
        place, lag = np.nonzero(rows[0])
        rest = np.flatnonzero(later[whole * size :] == anchors[whole]) if whole < len(anchors) else np.zeros(0, np.int64)
        place, lag = np.append(place, np.full(len(rest), whole)), np.append(lag, rest) + size + 1
        order = np.lexsort((place, lag))
        cuts = np.flatnonzero(np.diff(lag[order], prepend=-1))
        for q, starts in zip(lag[order][cuts].tolist(), np.split(place[order] * size, cuts[1:]) if len(cuts) else [], strict=True):
            if q <= most:
                yield q, [(s, s + size + q) for s in starts.tolist()]
        size *= 2


def runs(numbers: np.ndarray, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run: the smallest period, at least `least` words and `exponent` periods, in order.

    `exponent` is 3 or more.
    """
    n = len(numbers)
    most = n // exponent
    if n < least or not most:
        return []
    bits = planes(numbers)
    period: dict[tuple[int, int], int] = {}
    found: list[tuple[int, int]] = []

    def look(lag: int) -> None:
        for start, length in stretches(bits, n, lag, max(least, exponent * lag) - lag):
            # A stretch of a multiple of a run's period is that run once more.
            if (start, length + lag) not in period:
                period[start, length + lag] = lag
                found.append((start, start + length + lag))

    for lag in range(1, min(most, SMALL) + 1):
        look(lag)
    if most > SMALL:
        for lag, windows in likely_lags(numbers, most, exponent):
            if any(not any(s <= a and b <= e for s, e in found) for a, b in windows):
                look(lag)
    return sorted((start, length, q) for (start, length), q in period.items())


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word as the number of its first place among distinct words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def dropped(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words a run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge)[:n] > 0


def periodic_runs(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4, texts: bool = True) -> DataFrame:
    """(id, n_words, runs, n_kept, collapsed_sha256, collapsed) of each row.

    `runs` are (start, length, period) by start, then period: stretches of words of which each
    equals the one `period` further, that no neighbour prolongs, with at least `least` words and
    `exponent` (3 or more) of their smallest period. `collapsed` is the text's words, joined by
    spaces, without those that a run holds after its first period; `texts=False` leaves it out.

    A null, empty or blank text has no words and no runs. Null ids and repeated rows have a row
    each; of runs that begin together the shorter period comes first; texts count whole, however
    long; an empty table gives no rows; other columns, of any name, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tw.slices(whole, "text"):
                counts, found, left = [], [], []
                for text in batch.column(1):
                    words = (text.as_py() or "").encode().split()  # of bytes: at ASCII white space only
                    own = runs(numbered(words), least, exponent)
                    kept = [w for w, gone in zip(words, dropped(len(words), own).tolist(), strict=True) if not gone] if own else words
                    counts.append((len(words), len(kept)))
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                    left.append(b" ".join(kept))
                columns = [batch.column(0), pa.array([n for n, _ in counts], pa.int64()), pa.array(found, RUNS), pa.array([n for _, n in counts], pa.int64())]
                columns += [pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()), *([pa.array(left, pa.binary()).cast(pa.string())] if texts else [])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "n_kept", "collapsed_sha256", "collapsed"][: len(columns)])

    rows = frame.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    declared = f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, n_kept long, collapsed_sha256 string"
    return rows.mapInArrow(run, declared + ", collapsed string" * texts)
