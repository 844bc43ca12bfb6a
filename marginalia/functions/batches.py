"""Arrow batches in pieces, so that what Python makes of long texts at once stays small."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is alone.
PIECE = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], *columns: str, most: int = PIECE, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of so many rows, and so many bytes of some columns, at most."""
    for batch in batches:
        size = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
        at = 0
        while at < batch.num_rows:
            before = int(size[at - 1]) if at else 0
            end = min(max(int(np.searchsorted(size, before + most, "right")), at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
