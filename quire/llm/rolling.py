"""Hashes over slices of token sequences, computed for whole blocks of documents at once.

A block is a run of documents laid end to end: their tokens (as 64-bit values) and the bounds of each
document. A slice's hash follows from prefix sums of ``token * BASE**i`` modulo 2**64, so that any window
of any length costs one subtraction and one multiplication.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTES = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, 256, dtype=U64)
# Positions that share a word with the hash when a smallest k-gram is sought; documents stay below 2**31 tokens.
_LOW = U64(2**31 - 1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 … BASE**(n-1), or of its inverse; kept and doubled as longer blocks come."""
    name = "inverse" if inverse else "base"
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, _INVERSE if inverse else _BASE, U64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all of them."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Slices:
    """Hashes of slices of one token array."""

    def __init__(self, tokens: np.ndarray):
        self.sums = np.zeros(len(tokens) + 1, U64)
        np.cumsum(tokens * powers(len(tokens)), out=self.sums[1:])
        self.back = powers(len(tokens) + 1, inverse=True)

    def every(self, length: int) -> np.ndarray:
        """Of all slices of one length."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.back[:n])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


class Texts(NamedTuple):
    """Neighbouring rows of a batch: the first row's number, their bytes, and where each one begins and ends."""

    first: int
    data: np.ndarray
    bounds: np.ndarray


def texts(column: pa.Array, limit: int = 1 << 18) -> Iterator[Texts]:
    """The column's texts in blocks of about ``limit`` bytes; a longer text is a block of its own. Null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield Texts(row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row])
        row = end


def byte_tokens(block: Texts) -> np.ndarray:
    return _BYTES[block.data]


def word_spans(block: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (anything but ASCII white space), and each document's bounds among them."""
    space = (block.data == 0x20) | (block.data - np.uint8(9) < 5)
    n = len(space)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(block.bounds), np.int64)
    begins = ~space
    begins[1:] &= space[:-1]
    edges = block.bounds[(block.bounds > 0) & (block.bounds < n)]
    begins[edges] = ~space[edges]
    ends = ~space
    ends[:-1] &= space[1:]
    ends[edges - 1] = ~space[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, block.bounds)


def word_tokens(block: Texts) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value per word, and each document's bounds among the words."""
    start, end, bounds = word_spans(block)
    return Slices(byte_tokens(block)).at(start, end) if len(start) else np.zeros(0, U64), bounds


class Runs(NamedTuple):
    """Runs of neighbouring windows that share their smallest k-gram."""

    doc: np.ndarray
    lo: np.ndarray
    n: np.ndarray
    place: np.ndarray
    seed: np.ndarray
    span: np.ndarray


def window_runs(tokens: np.ndarray, bounds: np.ndarray, depth: int, k: int, slices: Slices | None = None) -> Runs:
    """Cuts every document's windows of ``depth`` tokens into runs by winnowing.

    Each window chooses its smallest k-gram (the leftmost of equals), so equal windows choose alike wherever
    they stand. A run is named by that k-gram's hash (``seed``) and by the hash of all it covers with the
    k-gram's place in it (``span``); ``lo`` is the first window's place in the block, ``n`` the number of windows, ``place`` the k-gram's place.
    """
    none = np.zeros(0, np.int64)
    if len(tokens) < depth:
        return Runs(none, none, none, none, none.astype(U64), none.astype(U64))
    slices = slices or Slices(tokens)
    grams = slices.every(k)
    place = np.arange(len(grams), dtype=U64)
    least = (grams & ~_LOW) | place
    width, wanted = 1, depth - k + 1
    while width * 2 <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wanted:
        least = np.minimum(least[:len(least) - (wanted - width)], least[wanted - width:])
    chosen = (least & _LOW).astype(np.int64)
    lengths = np.diff(bounds)
    whole = np.repeat(bounds[1:], lengths)[:len(chosen)] - np.arange(len(chosen)) >= depth
    at = np.flatnonzero(whole)
    if not len(at):
        return Runs(none, none, none, none, none.astype(U64), none.astype(U64))
    anchor = chosen[at]
    first = np.ones(len(at), bool)
    first[1:] = anchor[1:] != anchor[:-1]
    begin = np.flatnonzero(first)
    n = np.diff(np.append(begin, len(at)))
    lo, anchor = at[begin], anchor[begin]
    doc = np.searchsorted(bounds, lo, side="right") - 1
    shape = ((anchor - lo).astype(U64) << U64(32)) | n.astype(U64)
    span = mix(slices.at(lo, lo + n + depth - 1) + mix(shape))
    return Runs(doc, lo, n, anchor, grams[anchor], span)


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo+1, …, lo+n-1 of each pair, one after another."""
    total = int(n.sum())
    offsets = np.repeat(np.cumsum(n) - n, n)
    return np.arange(total) - offsets + np.repeat(lo, n)


def covered(length: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``length`` places lie in any of the ranges."""
    steps = np.zeros(length + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:-1]) > 0
