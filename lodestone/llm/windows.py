"""Runs of fixed-length windows over sequences of units (bytes or words), named by hashes.

Every window of ``length`` units holds ``length - anchor + 1`` runs of ``anchor`` units; the run with the smallest
hash (the leftmost of several) is the window's anchor.  The choice depends on the window's own units only, so equal windows
have equal anchors at equal places.  Neighbouring windows mostly share one, so a text is described by one row for each
stretch of windows with the same anchor, about ``2 / (length - anchor + 2)`` rows a unit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

#: Units whose hashes are held at once; a longer sequence is cut into overlapping pieces.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def byte_codes() -> np.ndarray:
    """A 64-bit code for each byte."""
    return mixed_bits(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Hashes:
    """Hashes of any stretch of one code sequence, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, codes: np.ndarray) -> None:
        size = 1 << max(10, int(len(codes)).bit_length())
        self.up, self.down = _powers(size)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.up[:len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed_bits((self.sums[stop] - self.sums[start]) * self.down[start])

    def runs(self, length: int) -> np.ndarray:
        """Of every run of ``length`` units, by its start."""
        n = len(self.sums) - length
        return mixed_bits((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


@dataclass
class Stretches:
    """One entry a stretch: its sequence, first and last window start, anchor start, and hashes of anchor and stretch.

    ``whole`` covers all units of the stretch and the place of the anchor in it.
    """
    sequence: np.ndarray
    low: np.ndarray
    high: np.ndarray
    at: np.ndarray
    anchor: np.ndarray
    whole: np.ndarray


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive keys, from running minima of blocks in both directions."""
    n = len(keys)
    blocks = -(-n // width) + 1
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = n - width + 1
    return np.minimum(back[:m], ahead[width - 1:width - 1 + m])


def stretches_of(codes: np.ndarray, ends: np.ndarray, length: int, anchor: int) -> Stretches:
    """Of sequences laid end to end in ``codes``; ``ends`` are their ends.  Positions are those within ``codes``."""
    none = np.zeros(0, np.int64)
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    counts = np.maximum(ends - begins - length + 1, 0)
    if not counts.sum():
        return Stretches(none, none, none, none, none.view(np.uint64), none.view(np.uint64))
    hashes = Hashes(codes)
    grams = hashes.runs(anchor)
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    chosen = (_least(keys, length - anchor + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    held = np.flatnonzero(counts)
    sequence = np.repeat(held, counts[held])
    starts = np.arange(len(sequence)) + np.repeat(begins[held] - np.concatenate(([0], np.cumsum(counts[held])[:-1])), counts[held])
    at = chosen[starts]
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (sequence[1:] != sequence[:-1]))))
    last = np.concatenate((first[1:], [len(at)])) - 1
    low, high, at = starts[first], starts[last], at[first]
    whole = hashes.of(low, high + length) ^ mixed_bits(((at - low) * 4099 + (high - low)).astype(np.uint64))
    return Stretches(sequence[first], low, high, at, grams[at], whole)


def gathered(sequences: Iterable[np.ndarray], length: int, piece: int = PIECE) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Groups of sequences of about ``piece`` units: their numbers, offsets in their sequence, codes end to end, ends.

    A longer sequence is cut into pieces that overlap by ``length - 1`` units, so every window is in one piece.
    """
    numbers, offsets, parts, size = [], [], [], 0
    for number, codes in enumerate(sequences):
        for offset in range(0, max(1, len(codes) - length + 1), piece):
            part = codes[offset:offset + piece + length - 1]
            if len(part) < length:
                continue
            numbers.append(number)
            offsets.append(offset)
            parts.append(part)
            size += len(part)
            if size >= piece:
                yield numbers, offsets, np.concatenate(parts), np.cumsum([len(p) for p in parts])
                numbers, offsets, parts, size = [], [], [], 0
    if parts:
        yield numbers, offsets, np.concatenate(parts), np.cumsum([len(p) for p in parts])


def word_codes(text: bytes) -> np.ndarray:
    """XXH64 of each word, cut at 0x20 and 0x09 to 0x0D."""
    import xxhash

    words = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def text_codes(text: bytes) -> np.ndarray:
    return byte_codes()[np.frombuffer(text, np.uint8)]


def covered(n: int, spans: Iterable[tuple[int, int]]) -> tuple[np.ndarray, int]:
    """Marks of the units 0 to n - 1 that lie in a span (end exclusive), and the number of maximal runs of them."""
    steps = np.zeros(n + 1, np.int64)
    for low, high in spans:
        steps[low] += 1
        steps[min(high, n)] -= 1
    marks = np.cumsum(steps[:n]) > 0
    return marks, int((np.diff(np.concatenate(([0], marks.astype(np.int8)))) == 1).sum())
