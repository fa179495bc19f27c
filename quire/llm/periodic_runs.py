"""Runs of words that repeat with a period, located by block convolution.

A stretch in which words ``q`` apart are equal is at least three times as long as ``q`` in any run sought, so that it holds
a whole aligned block of the largest power of two ``b`` with 2b - 1 <= 3q. At every such scale the text is cut into blocks,
and each block is held against all places a period of that scale away at once: the sum of squared differences is
two sums of squares less twice a convolution, taken through a number-theoretic transform in exact integers. Where it is
zero the block occurs again, and the distance is a seed, which is extended both ways by hashes of slices. Scales go
upwards: a seed inside a run of a smaller period is that run's multiple and is left out, so periods are the smallest.

The texts of a block lie end to end and are transformed together; a text is one row, and nothing is shuffled.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.llm import rolling
from quire.llm.common import map_batches

U64 = np.uint64
#: A prime 7 * 2**20 + 1 with a generator of its residues. 64 products of residues add up exactly in a double.
PRIME, GENERATOR = 7 * 2**20 + 1, 3
#: Points transformed by one matrix, the longest block, numbers handled in one go.
POINTS, LONGEST, TOGETHER = 64, 1 << 14, 1 << 20


def reduced(x: np.ndarray) -> np.ndarray:
    """Residues of whole doubles from 0 to 2**53."""
    x = x - np.floor(x * (1 / PRIME)) * PRIME
    x += (x < 0) * float(PRIME)
    x -= (x >= PRIME) * float(PRIME)
    return x


def _powers(root: int, exponents: np.ndarray) -> np.ndarray:
    n = int(exponents.max()) + 1
    out = [1] * n
    for i in range(1, n):
        out[i] = out[i - 1] * root % PRIME
    return np.array(out, np.float64)[exponents]


@cache
def _matrix(n: int, back: bool) -> np.ndarray:
    """The transform of ``n`` points as a matrix; backwards with its factor 1/n."""
    root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
    i = np.arange(n)
    out = _powers(pow(root, -1, PRIME) if back else root, np.outer(i, i) % n)
    return reduced(out * pow(n, -1, PRIME)) if back else out


@cache
def _twiddles(n: int, back: bool) -> np.ndarray:
    root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
    return _powers(pow(root, -1, PRIME) if back else root, np.outer(np.arange(POINTS), np.arange(n // POINTS)))


def transform(x: np.ndarray) -> np.ndarray:
    """Of every row; the results stand in the order that ``inverse`` takes."""
    rows, n = x.shape
    if n <= POINTS:
        return reduced(x @ _matrix(n, False))
    parts = reduced(np.matmul(_matrix(POINTS, False), x.reshape(rows, POINTS, n // POINTS)))
    return transform(reduced(parts * _twiddles(n, False)).reshape(rows * POINTS, n // POINTS)).reshape(rows, n)


def inverse(x: np.ndarray) -> np.ndarray:
    rows, n = x.shape
    if n <= POINTS:
        return reduced(x @ _matrix(n, True))
    parts = inverse(x.reshape(rows * POINTS, n // POINTS)).reshape(rows, POINTS, n // POINTS)
    return reduced(np.matmul(_matrix(POINTS, True), reduced(parts * _twiddles(n, True)))).reshape(rows, n)


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Per row, the sum of squared differences between the block and the window at each place it fits, as a residue."""
    rows, size = blocks.shape
    places = windows.shape[1] - size + 1
    n = 1 << (windows.shape[1] - 1).bit_length()
    turned, padded = np.zeros((rows, n)), np.zeros((rows, n))
    turned[:, -np.arange(size) % n] = blocks
    padded[:, :windows.shape[1]] = windows
    product = inverse(reduced(transform(turned) * transform(padded)))[:, :places]
    squares = np.zeros((rows, windows.shape[1] + 1))
    np.cumsum(windows * windows, axis=1, out=squares[:, 1:])
    both = (blocks * blocks).sum(axis=1)[:, None] + squares[:, size:] - squares[:, :places]
    return reduced(both + 2 * (PRIME - product))


def zeros(tokens: np.ndarray, stride: int, size: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the blocks of ``size`` tokens, one every ``stride``, that may occur again from ``first`` to ``last`` further on.

    Tokens become small numbers, so that sums stay below the prime; equal blocks are always found.
    """
    n = len(tokens)
    kinds = max(2, int((PRIME / size) ** 0.5))
    numbers = np.zeros(n + stride + last + size)
    numbers[:n] = tokens % U64(kinds)
    starts = np.arange(0, n - size + 1, stride)
    blocks, place, distance = sliding_window_view(numbers, size), [], []
    # Distances are taken a block's length at a time.
    for lo in range(first, last + 1, size):
        width = min(size, last + 1 - lo) + size - 1
        windows = sliding_window_view(numbers, width)
        step = max(1, TOGETHER // (2 * size))
        for at in range(0, len(starts), step):
            some = starts[at:at + step]
            row, shift = np.nonzero(mismatches(blocks[some], windows[some + lo]) == 0)
            place.append(some[row])
            distance.append(lo + shift)
    none = np.zeros(0, np.int64)
    return np.concatenate(place or [none]), np.concatenate(distance or [none])


def _reach(same, most: np.ndarray) -> np.ndarray:
    """Per seed, the largest length up to ``most`` of which ``same(which, length)`` holds; it holds for all shorter ones."""
    low, high = np.zeros_like(most), most.copy()
    while (todo := np.flatnonzero(low < high)).size:
        middle = (low[todo] + high[todo] + 1) >> 1
        fits = same(todo, middle)
        low[todo[fits]] = middle[fits]
        high[todo[~fits]] = middle[~fits] - 1
    return low


def _reached(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Per place, where the longest of the runs that begin at or before it ends."""
    ends = np.zeros(n, np.int64)
    np.maximum.at(ends, start, end)
    return np.maximum.accumulate(ends)


def runs(tokens: np.ndarray, bounds: np.ndarray, periods: int = 4, shortest: int = 6, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in texts laid end to end, ``bounds`` theirs, sorted by start and period.

    A run is a longest stretch with that smallest period, of at least ``periods`` (2 or more) periods and ``shortest`` tokens.
    """
    lengths = np.diff(bounds)
    n = len(tokens)
    none = np.zeros(0, np.int64)
    found = [none, none, none]
    if not n or periods < 2:
        return none, none, none
    least = lambda q: max(shortest, periods * q)
    slices = rolling.Slices(tokens)
    begin, end = np.repeat(bounds[:-1], lengths), np.repeat(bounds[1:], lengths)
    period = 1
    while (long := lengths >= least(period)).any():
        # The largest block that every run of this period holds whole, and the last period it serves.
        size = 1 << ((least(period) - period + 1) // 2).bit_length() - 1
        last = period
        while least(last + 1) - last - 1 < 4 * size - 1:
            last += 1
        place = rolling.ranges(bounds[:-1][long], lengths[long])
        edge = np.cumsum(lengths[long])
        some = tokens[place]
        block = min(size, longest)
        at, q = zeros(some, size, block, period, min(last, int(lengths[long].max()) // periods))
        owner = np.searchsorted(edge, at, side="right")
        inside = at + q + block <= edge[owner]
        at, q = place[at[inside]], q[inside]
        # Within a run of a period that the block holds whole, the seed's distance is a multiple of it.
        known = found[2] <= block
        fresh = _reached(n, found[0][known], found[1][known])[at] < at + q + block
        at, q = at[fresh], q[fresh]
        same = slices.at(at, at + block) == slices.at(at + q, at + q + block)
        at, q = at[same], q[same]
        right = _reach(lambda i, d: slices.at(at[i], at[i] + d) == slices.at(at[i] + q[i], at[i] + q[i] + d), end[at] - at - q)
        left = _reach(lambda i, d: slices.at(at[i] - d, at[i]) == slices.at(at[i] + q[i] - d, at[i] + q[i]), at - begin[at])
        start, stop = at - left, at + q + right
        enough = stop - start >= np.maximum(shortest, periods * q)
        if enough.any():
            new = np.unique(np.stack([q[enough], start[enough], stop[enough]]), axis=1)
            # Periods below twice the scale's first can't be multiples of each other and enter at once.
            for part in (new[:, new[0] < 2 * period], *(new[:, new[0] == q] for q in np.unique(new[0][new[0] >= 2 * period]))):
                part = part[:, _reached(n, *found[:2])[part[1]] < part[2]]
                found = [np.concatenate([a, b]) for a, b in zip(found, part[[1, 2, 0]])]
        period = last + 1
    order = np.lexsort((found[2], found[0]))
    return tuple(x[order] for x in found)


def collapse(docs: DataFrame, periods: int = 4, shortest: int = 6, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with every run of repeated words cut to its first period, and ``n_words`` and ``runs``.

    Words are ``[^\\x20\\x09-\\x0D]+``; kept ones are joined by one space. ``runs`` is an array of (start, length, period) by start,
    then period, words counted from 0; a run is a stretch of words with that smallest period, of at least ``periods``
    periods and ``shortest`` words, that no neighbouring word extends. A word goes if any run holds it after that run's
    first period. Both new columns take the place of columns of that name.

    A null or empty text has no words, no runs and becomes empty. Ids aren't looked at: null or repeated ids and repeated
    rows stay rows; an empty table gives an empty one. No text is too long; words are named by 64-bit hashes.
    """
    columns = [c for c in docs.columns if c not in ("n_words", "runs")]
    place = columns.index(text_col)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def rule(batch: pa.RecordBatch) -> dict:
        texts, n_words, offsets, parts = [], [], [np.zeros(1, np.int64)], [[], [], []]
        for block in rolling.texts(batch.column(place)):
            tokens, bounds = rolling.word_tokens(block)
            start, end, period = runs(tokens, bounds, periods, shortest)
            gone = rolling.covered(len(tokens), start + period, end)
            doc = np.searchsorted(bounds, start, side="right") - 1
            offsets.append(offsets[-1][-1] + np.searchsorted(doc, np.arange(1, len(bounds))))
            for out, values in zip(parts, (start - bounds[doc], end - start, period)):
                out.append(values)
            data = block.data.tobytes()
            for i in range(len(bounds) - 1):
                kept = data[block.bounds[i]:block.bounds[i + 1]].split()
                mask = gone[bounds[i]:bounds[i + 1]]
                n_words.append(len(mask))
                if mask.any():
                    kept = [kept[j] for j in np.flatnonzero(~mask)]
                texts.append(b" ".join(kept))
        values = pa.StructArray.from_arrays([pa.array(np.concatenate(p) if p else [], pa.int64()) for p in parts], names=["start", "length", "period"])
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate(offsets), pa.int32()), values).cast(kind)
        out = {c: batch.column(i) for i, c in enumerate(columns)}
        return out | {text_col: pa.array(texts, pa.binary()).cast(pa.string()), "n_words": n_words, "runs": listed}

    one = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    kinds = [f for f in docs.schema.fields if f.name in columns]
    schema = T.StructType([*kinds, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(one))])
    return map_batches(docs.select(*columns), rule, schema)
