"""Folds that Spark lacks: a caller's function of a group's values, as an aggregate of DataFrames and SQL.

Values reach the function as one Arrow array, so it may be vectorised; a group's values are in one task, as a function
that may do anything needs them all. Folds that can be put together from parts are better written with Spark's own aggregates.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fold(function: Callable[[pa.Array], object], kind: str) -> Callable[..., Column]:
    """An aggregate of one column. The function gets the values that are not null; without any the result is null."""

    @F.arrow_udf(kind)
    def folded(values: pa.Array) -> object:
        own = values.drop_null()
        out = function(own) if len(own) else None
        return out.as_py() if isinstance(out, pa.Scalar) else out

    return folded


def register_fold(spark: SparkSession, name: str, function: Callable[[pa.Array], object], kind: str) -> None:
    """Makes the fold an aggregate of the session's SQL."""
    spark.udf.register(name, fold(function, kind))


def fold_of(rows: DataFrame, by: list[str], value: str, function: Callable[[pa.Array], object], kind: str = "double") -> DataFrame:
    """by, value: the fold of every group."""
    return rows.groupBy(*by).agg(fold(function, kind)(F.col(value)).alias(value))


def arg_fold_of(rows: DataFrame, by: list[str], value: str, function: Callable[[pa.Array], object], kind: str = "double") -> DataFrame:
    """The rows whose value equals the fold of their group, all of them if several do."""
    folded = fold_of(rows, by, value, function, kind).withColumnRenamed(value, "__fold")
    return rows.join(folded, by).where(F.col(value) == F.col("__fold")).drop("__fold")
