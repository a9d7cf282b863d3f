"""Intermediate tables that a plan reads more than once."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """The rows, computed once: written to the session's checkpoint folder where it names one (spark.checkpoint.dir), so that
    lost executors cost nothing; otherwise kept in memory and on disk, to be made again from the lineage if lost."""
    if df.sparkSession.sparkContext.getCheckpointDir() is not None:
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)
