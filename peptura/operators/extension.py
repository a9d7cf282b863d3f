"""Growth along a protein by running masses, without a protein on any row.

Proteins become pieces of the letters that a growth may read: one piece for each CHUNK places in either direction, with the
running masses of its letters. A growth meets its piece by an equi-join on (protein, direction, chunk), and its end is found
by binary search in the running masses, so its cost does not depend on the protein's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dealing import FEW

CHUNK = 64
#: A letter that stops a growth weighs this much in units of mass, more than any precursor does.
STOP = 10**14


def running_masses(proteins: DataFrame, key: str, reach: DataFrame, units: dict[str, int], other: int = STOP) -> DataFrame:
    """key, ion_type, chunk, edge, letters, masses: the letters from a chunk's edge on (b: from its first place to the right;
    y: from its last place to the left, and edge is the place after it), and the sums of their units.

    A piece goes on past its chunk until letters that weigh something have been read ``reach`` times, or to the protein's end.
    reach: one row and column. Letters without units weigh ``other``. No more than FEW pieces are broadcast, so that what grows
    stays where it is.
    """
    table = np.array([units.get(chr(c), other) for c in range(256)], np.int64)

    def of(text: str, most: int) -> Iterator[tuple[str, int, int, str, np.ndarray]]:
        own = table[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
        for kind, letters, weights in (("b", text, own), ("y", text[::-1], own[::-1])):
            heavy = np.cumsum(weights > 0)
            for c in range(-(-len(text) // CHUNK)):
                # chunks are counted from the left in both directions
                at = c * CHUNK if kind == "b" else max(len(text) - (c + 1) * CHUNK, 0)
                ends = min((c + 1) * CHUNK if kind == "b" else len(text) - c * CHUNK, len(text))
                to = int(np.searchsorted(heavy, heavy[ends - 1] + most))
                # letters without weight go along with the letter before them
                yield kind, c, at if kind == "b" else len(text) - at, letters[at : to + 1], np.cumsum(weights[at : to + 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column(1).to_pylist()):
                if not text:
                    continue
                rows = list(of(text, max(1, b.column(2)[i].as_py() or 1)))
                name = pa.concat_arrays([b.column(0).slice(i, 1)] * len(rows))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()))
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([name, *columns], names=[key, "ion_type", "chunk", "edge", "letters", "masses"])

    df = proteins.select(key, "seq").crossJoin(F.broadcast(reach.toDF("__reach")))  # one row
    kind = df.schema[key].dataType.simpleString()
    made = df.select(key, "seq", F.col("__reach").cast("long")).mapInArrow(run, f"`{key}` {kind}, ion_type string, chunk int, edge int, letters string, masses array<long>")
    pieces = proteins.agg(F.sum(2 * F.ceil(F.length("seq") / CHUNK))).first()[0] or 0
    return F.broadcast(made) if pieces <= FEW else made


def chunk_of(ion_type: Column, place: Column) -> Column:
    """The chunk that a growth from a place reads: that of its first letter."""
    return F.floor((place - F.when(ion_type == "b", 0).otherwise(1)) / CHUNK).cast("int")


def offset_in(ion_type: Column, place: Column) -> Column:
    """Letters of a piece before a place."""
    return F.when(ion_type == "b", place - F.col("edge")).otherwise(F.col("edge") - place)


def mass_before(offset: Column) -> Column:
    return F.when(offset > 0, F.get("masses", offset - 1)).otherwise(F.lit(0)).cast("long")


def count_at_most(masses: Column, most: Column) -> Column:
    """How many of ascending numbers are at most a bound: binary search by steps that halve."""
    steps = F.array(*[F.lit(1 << s) for s in range(20, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= F.size(masses)) & (F.get(masses, n + s - 1) <= most), n + s).otherwise(n))
