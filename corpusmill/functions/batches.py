"""Arrow batches in slices, so that what a worker makes of them at once is bounded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text of a slice, or one text where that has more.
SLICE = 1 << 20


def cut(batch: pa.RecordBatch, sizes: pa.Array, most: int, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """All rows in order, in slices whose sizes sum up to ``most`` at most, or one row; not more than ``rows`` rows."""
    sizes = sizes.fill_null(0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, "right")))
        end = min(end, at + rows) if rows else end
        yield batch.slice(at, end - at)
        at = end


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """All rows in order, in slices of at most ``SLICE`` bytes of the column ``text`` or one row."""
    for batch in batches:
        yield from cut(batch, pc.binary_length(batch.column(text)), SLICE)
