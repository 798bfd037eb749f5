"""Arrow batches cut small, so that what Python holds at once doesn't grow with the rows of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

MOST = 1 << 20  # bytes of text in a piece


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = MOST) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, in pieces of at most so many bytes of a text column; a longer text is a piece of its own."""
    for b in batches:
        first, held = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist()):
            if i > first and (held + n > most or i - first >= 1000):
                yield b.slice(first, i - first)
                first, held = i, 0
            held += n
        if first < b.num_rows:
            yield b.slice(first)


def table(rows: list[tuple], names: tuple[str, ...], types: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    """Rows as a batch."""
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))
