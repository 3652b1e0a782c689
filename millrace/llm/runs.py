"""Periodic runs of words, found from seeds on diagonals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import column, own_copy, packed, portions, unpacked

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"


def bands(longest: int, min_length: int, min_exponent: int) -> Iterator[tuple[int, int]]:
    """(smallest lag, k) for texts of up to ``longest`` words.

    A run of period q matches itself at lag q over at least
    ``max(min_length - q, (min_exponent - 1) * q)`` words. The k of a band is the
    smallest such overlap of its lags, so every run holds a k-gram that occurs again
    one period on; and since no lag of the band is above k, that is the k-gram's next
    occurrence in the text.
    """
    overlap = lambda q: max(min_length - q, (min_exponent - 1) * q)
    low, k = 1, min(overlap(q) for q in range(1, min_length + 1))
    while max(min_length, min_exponent * low) <= longest:
        yield low, k
        low = k + 1
        k = overlap(low)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(a * np.uint64(3) + b * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def _repeats(prints: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of neighbouring occurrences of one fingerprint. ``at`` ascends."""
    n = np.uint64(len(at))
    width = np.uint64(max(1, int(n).bit_length()))
    rank = np.arange(n, dtype=np.uint64)
    order = np.sort((prints << width) | rank)  # cut fingerprints with their ranks below
    index = (order & np.uint64((1 << int(width)) - 1)).astype(np.int64)
    same = (order[1:] ^ order[:-1]) >> width == 0
    if (prints[index[1:][same]] != prints[index[:-1][same]]).any():  # the cut ones clash
        index = np.lexsort((rank, prints))
        same = prints[index[1:]] == prints[index[:-1]]
    return at[index[:-1][same]], at[index[1:][same]]


def _reach(words: np.ndarray, i: int, j: int, room: int, step: int) -> int:
    """How many words from i and j on, forwards or backwards, agree, up to ``room``."""
    done, block = 0, 32
    while done < room:
        size = min(block, room - done)
        if step > 0:
            unlike = words[i + done : i + done + size] != words[j + done : j + done + size]
        else:
            unlike = (words[i - done - size + 1 : i - done + 1] != words[j - done - size + 1 : j - done + 1])[::-1]
        if unlike.any():
            return done + int(unlike.argmax())
        done, block = done + size, block * 2
    return room


def find_runs(
    words: np.ndarray, ends: np.ndarray, min_length: int = 6, min_exponent: int = 4
) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of all runs of several texts, sorted.

    ``words`` are the texts' word numbers one after the other, ``ends`` where each
    text ends. Starts count from the text's own first word.
    """
    lengths = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(ends)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(words))  # words to the end, own included
    whole = np.repeat(lengths, lengths)
    prints, size = _mixed(words.astype(np.uint64) + np.uint64(1)), 1
    found: list[tuple[int, int, int, int]] = []
    for low, k in bands(int(lengths.max(initial=0)), min_length, min_exponent):
        while size * 2 <= k:
            prints, size = _joined(prints[: max(0, len(prints) - size)], prints[size:]), size * 2
        at = np.flatnonzero((left >= k) & (whole >= max(min_length, min_exponent * low)))
        grams = _joined(_joined(prints[at], prints[at + k - size]), text[at].astype(np.uint64))
        first, again = _repeats(grams, at)
        lag = again - first
        near = (lag >= low) & (lag <= k)
        first, lag = first[near], lag[near]
        order = np.lexsort((first, lag, text[first]))
        first, lag = first[order], lag[order]
        # one seed stands for those that follow it on its diagonal without a gap
        fresh = np.ones(len(first), bool)
        fresh[1:] = (np.diff(first) != 1) | (np.diff(lag) != 0)
        covered: dict[tuple[int, int], int] = {}  # by text and lag: where the last extension ended
        for i, q in zip(first[fresh].tolist(), lag[fresh].tolist(), strict=True):
            own = int(text[i])
            if i < covered.get((own, q), -1):
                continue
            begin, end = int(ends[own] - lengths[own]), int(ends[own])
            start = i - _reach(words, i - 1, i - 1 + q, i - begin, -1)
            stop = i + _reach(words, i, i + q, end - i - q, 1)
            covered[own, q] = stop
            length = stop - start + q
            if length >= max(min_length, min_exponent * q):
                found.append((own, start - begin, length, q))
    return sorted(set(found), key=lambda r: (r[0], r[1], r[3]))


def _report(texts: pa.Array, min_length: int, min_exponent: int) -> pa.StructArray:
    """Word counts, runs and collapsed texts of a portion of texts."""
    split = pc.ascii_split_whitespace(pc.fill_null(own_copy(texts), "").cast(pa.large_string()))
    owner, flat = pc.list_parent_indices(split), pc.list_flatten(split)
    real = pc.not_equal(flat, "")  # white space at the ends gives empty words
    owner, flat = owner.filter(real).to_numpy(), flat.filter(real)
    lengths = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    ends = np.cumsum(lengths)
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    found = find_runs(codes, ends, min_length, min_exponent)
    dropped = np.zeros(len(flat) + 1, np.int64)
    for text, start, length, period in found:
        begin = ends[text] - lengths[text] + start
        dropped[begin + period] += 1
        dropped[begin + length] -= 1
    kept = np.cumsum(dropped[:-1]) == 0
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=len(texts)))])
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), flat.filter(pa.array(kept)))
    runs = [np.array(c, np.int64) for c in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 4
    counts = np.concatenate([[0], np.cumsum(np.bincount(runs[0], minlength=len(texts)))])
    each = pa.StructArray.from_arrays([pa.array(c) for c in runs[1:]], fields=list(_RUN))
    return pa.StructArray.from_arrays(
        [
            pa.array(lengths),
            pa.ListArray.from_arrays(pa.array(counts, pa.int32()), each),
            pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string()),
        ],
        ["n_words", "runs", "collapsed"],
    )


def periodic_runs(
    docs: DataFrame, text_col: str = "text", min_length: int = 6, min_exponent: int = 4
) -> DataFrame:
    """Find stretches of words that repeat with a period, and the text without the
    repeats.

    A run is a stretch with smallest period q of at least ``max(min_length,
    min_exponent * q)`` words that no neighbouring word extends (``min_exponent`` of
    3 or more). Returns the input columns and

    * ``n_words``: words, which are parted by space and ``\\x09-\\x0D``,
    * ``runs``: (start, length, period) by start, then period; starts count from 0,
    * ``collapsed``: the words, joined by one space, without those that lie in a run
      after its first period;

    input columns of these names are replaced. Every row stands alone: nothing is
    shuffled, and a text of n words costs about log n sorts of n numbers. The largest
    unit in memory is one text.

    * A null, empty or blank text has no words, no runs and an empty ``collapsed``.
    * Repeated rows, null or repeated ids are judged like any other; an empty table
      gives an empty result. Texts have no length limit, no lag is left out.
    """
    if min_exponent < 3 or min_length < 2:
        raise ValueError("runs need min_exponent >= 3 and min_length >= 2")

    @F.arrow_udf(_OUT)
    def report(texts: pa.Array) -> pa.Array:
        parts = [_report(texts[rows], min_length, min_exponent) for rows in portions(texts)]
        return pa.concat_arrays(parts) if parts else _report(texts, min_length, min_exponent)

    rows = packed(docs, found=report(column(text_col)))
    return unpacked(
        rows, n_words=F.col("found.n_words"), runs=F.col("found.runs"), collapsed=F.col("found.collapsed")
    )


def strongest(runs: str) -> Column:
    """The run with the greatest length/period, the first of equal ones; null if
    there is none. Fractions are compared exactly."""
    better = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.reduce(
        runs, F.get(runs, F.lit(0)), lambda best, r: F.when(better(best, r), r).otherwise(best)
    )


def runs_text(runs: str) -> Column:
    """``start,length,period`` and a line feed for every run."""
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    return F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")
