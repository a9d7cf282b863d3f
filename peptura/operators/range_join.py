"""Range join as an equi-join on bins.

A condition ``lo <= point <= hi`` alone plans as a nested-loop join. Here the point side gets the bin of its point, the
interval side one row for each bin that its interval touches, and the exact condition follows as a residual filter, so
the join is a hash or sort-merge join that Spark can broadcast, split when skewed, and spread over a cluster. A pair
meets in exactly one bin, that of the point, so nothing is repeated.

The outer join turns this around: an interval stays one row in the bin of its start, and a point stands in its own bin
and the one before. That meets every pair once as long as no interval is wider than a bin, so each interval without a
point is one row with nulls, and no row numbers or second join are needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = "__bin"


def range_join(points: DataFrame, intervals: DataFrame, point: str, lo: str, hi: str, width: float, on: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """points x intervals with lo <= point <= hi (and equal ``on`` columns).

    width: about the widest interval; wider ones touch more bins, narrower ones at most two. partitions: to how many both sides
    are dealt, where the session's number does not suit.
    """
    keys = [*(on or []), BIN]
    p = points.withColumn(BIN, F.floor(F.col(point) / width))
    bins = F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    within = (F.col(point) >= F.col(lo)) & (F.col(point) <= F.col(hi))
    i = intervals.where(F.col(lo) <= F.col(hi)).withColumn(BIN, bins)
    if partitions is not None:
        i, p = i.repartition(partitions, *keys), p.repartition(partitions, *keys)
    return i.join(p, keys).where(within).drop(BIN)


def outer_range_join(
    intervals: DataFrame, points: DataFrame, point: str, lo: str, hi: str, width: float, on: list[str] | None = None, scale: Callable[[Column], Column] = lambda c: c
) -> DataFrame:
    """As range_join, and intervals without a point stay with nulls. Bins are ``width`` wide on an increasing ``scale``
    (the logarithm suits relative tolerances); an interval wider than that is an error."""
    on = on or []
    at = lambda c: F.floor(scale(F.col(c)) / width)
    fits = at(hi) <= at(lo) + 1
    home = F.when(fits | F.col(lo).isNull() | F.col(hi).isNull(), at(lo)).otherwise(F.raise_error(F.lit("an interval is wider than the bins")).cast("long"))
    left = intervals.withColumn(BIN, home).alias("i")
    right = points.withColumn(BIN, F.explode(F.array(at(point), at(point) - 1))).alias("p")
    met = (F.col(f"p.{point}") >= F.col(f"i.{lo}")) & (F.col(f"p.{point}") <= F.col(f"i.{hi}"))
    for c in [*on, BIN]:
        met = met & (F.col(f"i.{c}") == F.col(f"p.{c}"))
    return left.join(right, met, "left_outer").select(*[F.col(f"i.{c}") for c in intervals.columns], *[F.col(f"p.{c}") for c in points.columns if c not in on])
