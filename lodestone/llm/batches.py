"""Arrow batches in pieces of bounded bytes, so that Python never opens the values of a whole batch at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the leading column in a piece, unless one row alone has more.
PIECE_BYTES = 1 << 20


def _sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each value: of texts as they are, of lists with eight bytes an element."""
    lists = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
    sizes = pc.list_value_length(column) if lists else pc.binary_length(column)
    return sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) * (8 if lists else 1)


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = PIECE_BYTES, rows: int = 1 << 13) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, in order: ``most`` bytes of ``column`` and ``rows`` rows at most, or one row.

    What the Arrow pool holds free is given back at the end of a partition, since a worker lives on for other stages.
    """
    for batch in batches:
        ends, at = np.cumsum(_sizes(batch.column(column))), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = min(max(at + 1, int(np.searchsorted(ends, before + most, side="right"))), at + rows)
            yield batch.slice(at, stop - at)
            at = stop
    pa.default_memory_pool().release_unused()
