"""Arrow batches in bounded slices: what one Python worker holds does not grow with a partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES, SLICE_ROWS = 4 << 20, 1024


def slices(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """Row ranges of about SLICE_BYTES of text, one row at least."""
    col, i, n = batch.column(text_at), 0, batch.num_rows
    sizes = [0 if x is None else x for x in pc.binary_length(col).to_pylist()]
    while i < n:
        j, held = i, 0
        while j < n and j - i < SLICE_ROWS and (j == i or held + sizes[j] <= SLICE_BYTES):
            held += sizes[j]
            j += 1
        yield batch.slice(i, j - i)
        i = j


def over_slices(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], text_at: int):
    """A mapInArrow function: ``make`` runs once in a worker's task, its result on every slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch, text_at):
                if (out := step(part)) is not None:
                    yield out

    return run
