"""Peak filters and peak statistics per spectrum."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .keys import SPECTRUM


def top_n_peaks(peaks: DataFrame, n: int, by: list[str] = SPECTRUM) -> DataFrame:
    """The n most intense peaks of each spectrum, ties by peak id; n = 0 keeps all."""
    if n == 0:
        return peaks
    w = W.partitionBy(*by).orderBy(F.desc("intensity"), "peak_id")
    return peaks.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def legacy_top_n_peaks(peaks: DataFrame, n: int, by: list[str] = SPECTRUM) -> DataFrame:
    """The n most intense peaks with their place by m/z (1-based ``place``), the order in which the older engine lists them."""
    w = W.partitionBy(*by).orderBy("mz", "peak_id")
    return top_n_peaks(peaks, n, by).withColumn("place", F.row_number().over(w))


def relative_abundance(peaks: DataFrame, share: float, by: list[str] = SPECTRUM) -> DataFrame:
    """Peaks of at least a share of their spectrum's total intensity."""
    total = F.sum("intensity").over(W.partitionBy(*by))
    return peaks.withColumn("__t", total).where(F.col("intensity") >= share * F.col("__t")).drop("__t")


def total_intensity(peaks: DataFrame, by: list[str] = SPECTRUM) -> DataFrame:
    return peaks.groupBy(*by).agg(F.sum("intensity").alias("total_intensity"), F.count("*").alias("n_peaks"))


def peaks_near_mz(peaks: DataFrame, mz: float, ppm: float) -> DataFrame:
    """Relative to the peak's m/z."""
    return peaks.where(F.abs(F.col("mz") - mz) / F.col("mz") * 1e6 <= ppm)


def sparse_bins(peaks: DataFrame, width: float, by: list[str] = SPECTRUM, value: int = 50) -> DataFrame:
    return peaks.select(*by, F.floor(F.col("mz") / width).alias("bin"), F.lit(value).alias("value")).distinct()


def dense_bins(bins: DataFrame, by: list[str] = SPECTRUM) -> DataFrame:
    """sparse_bins with a zero for every bin below the last one of its group that has none: one array, ``values``."""
    last = bins.groupBy(*by).agg(F.max("bin").alias("last"), F.map_from_entries(F.collect_list(F.struct("bin", "value"))).alias("m"))
    values = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)))
    return last.select(*by, values.alias("values"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin (0-based), n over equal bins from the least to the largest value."""
    lim = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    at = F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(at, F.lit(bins - 1)))
    return df.crossJoin(F.broadcast(lim)).where(F.col(value).isNotNull()).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def best_fit_line(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def density(df: DataFrame, value: str, points: int = 200, bw_adjust: float = 2.0, bins: int = 1024) -> DataFrame:
    """x, density: a Gaussian density at evenly spaced points from the least to the largest value, by Scott's rule times
    bw_adjust, which may stand beside a histogram (times rows and bin width).

    Values are counted in ``bins`` fine bins first, so that a point adds up bins and not values; a value counts at the middle
    of its bin. With a bandwidth of h that is off by about (range / bins / h)^2 / 24 of the density. Fewer than two distinct
    values have no density.
    """
    v = F.col(value).cast("double")
    lim = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n"), F.stddev_samp(v).alias("sd")).where("hi > lo")
    wide = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((v - F.col("lo")) / wide), F.lit(bins - 1))
    counted = df.where(v.isNotNull()).crossJoin(F.broadcast(lim)).groupBy(at.alias("bin")).agg(F.count("*").alias("c"))  # lim is one row
    one = counted.agg(F.sort_array(F.collect_list(F.struct("bin", "c"))).alias("counts")).crossJoin(F.broadcast(lim))  # no more than ``bins``
    one = one.withColumn("h", F.pow(F.col("n").cast("double"), F.lit(-0.2)) * F.col("sd") * bw_adjust).withColumn("w", wide)
    df = one.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    z = lambda b: (F.col("x") - (F.col("lo") + (b["bin"] + 0.5) * F.col("w"))) / F.col("h")
    total = F.aggregate("counts", F.lit(0.0), lambda a, b: a + b["c"] * F.exp(-0.5 * z(b) * z(b)))
    return df.select("x", (total / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))
