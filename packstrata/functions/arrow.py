"""Arrow batches cut to a bounded size of content, so that long values do not add up in memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of content that are worked on, and sent on, together.
BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, cut so that a text or binary ``column`` holds about ``most`` bytes, or one row."""
    for batch in batches:
        sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
        start, held = 0, 0.0
        for i, n in enumerate(sizes.tolist()):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0.0
            held += n
        yield batch.slice(start)
