"""Bit sketches built per partition, merged by cell range, and small enough to hand to every task.

A sketch has a fixed number of rows and cells, whatever the size of the input: that bounds the broadcast.  Fuller
sketches let more through; they never lose a key that was seen twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.windows import mixed_bits

CHUNK = 1 << 20
BLOBS = "chunk int, salt int, ones binary, twos binary"


@dataclass(frozen=True)
class Shape:
    """``rows`` hash functions over ``1 << bits`` cells each; 8 MB a row to broadcast with 26 bits."""
    rows: int = 2
    bits: int = 26

    def cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        mixed = mixed_bits(keys ^ np.uint64((row + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64) + (row << self.bits)


def _packed(cells: np.ndarray) -> bytes:
    bits = np.zeros(CHUNK, np.uint8)
    bits[cells] = 1
    return pa.compress(np.packbits(bits, bitorder="little").tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, decompressed_size=CHUNK // 8, codec="zstd", asbytes=True), np.uint8)


def blobs_of(keys: np.ndarray, shape: Shape, salt: int) -> pa.RecordBatch:
    """Counts of the cells, as far as one and two: bit sets of the cells hit, and of those hit twice or more."""
    chunks, ones, twos = [], [], []
    for row in range(shape.rows):
        cells, counts = np.unique(shape.cells(keys, row), return_counts=True)
        edges = np.flatnonzero(np.diff(cells // CHUNK, prepend=-1))
        for lo, hi in zip(edges, [*edges[1:], len(cells)], strict=True):
            chunk = int(cells[lo]) // CHUNK
            inside = cells[lo:hi] - chunk * CHUNK
            chunks.append(chunk)
            ones.append(_packed(inside))
            twos.append(_packed(inside[counts[lo:hi] > 1]))
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array([salt] * len(chunks), pa.int32()), pa.array(ones, pa.binary()), pa.array(twos, pa.binary())], ["chunk", "salt", "ones", "twos"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of (chunk, salt); only the sums of the current one are held."""
    at, ones, twos = None, None, None

    def out():
        pack = lambda a: pa.array([pa.compress(a.tobytes(), codec="zstd", asbytes=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pack(ones), pack(twos)], ["chunk", "salt", "ones", "twos"])

    for batch in batches:
        for chunk, salt, one, two in zip(*(batch.column(c).to_pylist() for c in ("chunk", "salt", "ones", "twos")), strict=True):
            if (chunk, salt) != at:
                if at is not None:
                    yield out()
                at, ones, twos = (chunk, salt), np.zeros(CHUNK // 8, np.uint8), np.zeros(CHUNK // 8, np.uint8)
            one, two = _unpacked(one), _unpacked(two)
            twos |= two | (ones & one)
            ones |= one
    if at is not None:
        yield out()


def merged(blobs: DataFrame, rounds: tuple[int, ...] = (64, 1)) -> DataFrame:
    """The sum of all partition sketches by chunk; each round merges those of equal salt modulo its number."""
    for n in rounds:
        salted = blobs.withColumn("salt", F.pmod("salt", F.lit(n)).cast("int"))
        blobs = salted.repartition("chunk", "salt").sortWithinPartitions("chunk", "salt").mapInArrow(_merge, BLOBS)
    return blobs


def bit_sets(blobs: DataFrame, shape: Shape, which: str) -> np.ndarray:
    """One packed bit set of ``rows << bits`` cells on the driver: its size is fixed by ``shape``."""
    bits = np.zeros(-(-(shape.rows << shape.bits) // CHUNK) * (CHUNK // 8), np.uint8)
    for row in blobs.select("chunk", which).toLocalIterator():
        bits[row["chunk"] * (CHUNK // 8):(row["chunk"] + 1) * (CHUNK // 8)] = _unpacked(bytes(row[which]))
    return bits


def in_all_rows(bits: np.ndarray, keys: np.ndarray, shape: Shape) -> np.ndarray:
    """Keys whose cells are set in every row: the smallest count over the rows is what a count-min sketch estimates."""
    found = np.ones(len(keys), bool)
    for row in range(shape.rows):
        cells = shape.cells(keys[found], row)
        found[found] = (bits[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)
    return found
