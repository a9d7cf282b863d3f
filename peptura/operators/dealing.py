"""How many partitions rows are dealt to, where their number and not their bytes says how much is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spectra in a partition: a spectrum of a few hundred bytes meets thousands of k-mers and places.
ROWS = 256
#: Rows that are broadcast; more are shuffled.
FEW = 4096


def dealt(df: DataFrame, n: int, *keys: str, rows: int = ROWS) -> DataFrame:
    """df (n groups of rows by the keys) with about ``rows`` groups in a partition. The number stands, so that partitions of few
    bytes are not put together again; what is then grouped by the keys and more is in one place."""
    return df.repartition(max(1, -(-n // rows)), *keys)


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """To be broadcast, if there are no more than ``most`` rows; they are counted up to there."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
