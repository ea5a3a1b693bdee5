"""Arrow batches inside Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Texts that a worker holds as Python objects at one time, in bytes; a single longer text is taken alone.
SLICE_BYTES = 8 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a string or binary column holds at most ``most`` bytes in each, whatever the number of rows."""
    for b in batches:
        col = b.column(column)
        if not b.num_rows:
            continue
        if col.nbytes <= most:
            yield b
            continue
        kind = "int64" if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else "int32"
        ends = memoryview(col.buffers()[1]).cast("q" if kind == "int64" else "i")[col.offset : col.offset + len(col) + 1]
        start = 0
        for i in range(len(col)):
            if i > start and ends[i + 1] - ends[start] > most:
                yield b.slice(start, i - start)
                start = i
        yield b.slice(start)
