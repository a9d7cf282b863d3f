"""Peptide-spectrum matches: filters, counts, rankings and q-values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.sequences import HYBRID_PREFIX, is_hybrid, prefixes
from .hybrids import possible_hybrids
from .keys import SPECTRUM
from .settle import settled


def high_confidence(psms: DataFrame, most: float = 0.01) -> DataFrame:
    return psms.where(F.col("q_value") <= most)


def hybrid_psms(psms: DataFrame) -> DataFrame:
    return psms.where(is_hybrid(F.col("proteins")))


def top_ranked(psms: DataFrame, n: int = 1) -> DataFrame:
    """The first n matches of every spectrum by the search's own rank."""
    return psms.where(F.col("num") <= n)


def for_sample_scan(psms: DataFrame, sample: str, scan: int) -> DataFrame:
    return psms.where((F.col("sample") == sample) & (F.col("scan") == scan))


def protein_counts(psms: DataFrame) -> DataFrame:
    """protein, n: how often each protein stands in a match's list."""
    return psms.select(F.explode("proteins").alias("protein")).groupBy("protein").agg(F.count("*").alias("n"))


def sort_counts(counts: DataFrame) -> DataFrame:
    """Counts from the largest down, ties by name: a global order for reports."""
    return counts.orderBy(F.desc("n"), "protein")


def top_n_proteins(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent; ties by name."""
    return sort_counts(counts).limit(n)


def prefix_counts_by_length(psms: DataFrame) -> DataFrame:
    df = psms.select(F.explode(prefixes(F.col("seq"))).alias("prefix"))
    return df.groupBy(F.length("prefix").alias("length"), "prefix").agg(F.count("*").alias("n"))


def psms_for_scans(psms: DataFrame, scans: DataFrame) -> DataFrame:
    return psms.join(scans.select("sample", "scan"), ["sample", "scan"], "left_semi")


def max_elements(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """All rows that attain their group's maximum, ties kept. The maximum is aggregated and joined, so a large group is
    not one sorted window."""
    top = df.groupBy(*by).agg(F.max(value).alias("__top"))
    return df.join(top, by).where(F.col(value) == F.col("__top")).drop("__top")


def _ranges(values: DataFrame, value: str, buckets: int) -> DataFrame:
    """Adds range: 0 to buckets - 1 by quantiles of the distinct values, in their order. The cuts are one row of bounded size."""
    at = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edges = values.agg(F.array_sort(F.array_distinct(F.percentile_approx(value, at, 10_000))).alias("edges"))
    return values.crossJoin(F.broadcast(edges)).withColumn("range", F.size(F.filter("edges", lambda x: x <= F.col(value)))).drop("edges")


def dense_rank_desc(df: DataFrame, value: str, buckets: int = 1024) -> DataFrame:
    """value -> rank among the distinct values, the largest first. In two levels, so that no task orders all values: how
    many values lie in higher ranges (a bounded table), and the place within the range."""
    ranged = settled(_ranges(df.select(value).where(F.col(value).isNotNull()).distinct(), value, buckets))
    counts = ranged.groupBy("range").agg(F.count("*").alias("c"))
    base = counts.select("range", F.coalesce(F.sum("c").over(W.orderBy(F.desc("range")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    place = F.row_number().over(W.partitionBy("range").orderBy(F.desc(value)))
    ranks = ranged.withColumn("place", place).join(F.broadcast(base), "range").select(value, (F.col("base") + F.col("place")).alias("rank"))
    return df.join(ranks, value)


def percentile_of_score(values: DataFrame, value: str, score: float) -> DataFrame:
    """Mean rank of a score among values in percent, ties counted half."""
    v = F.col(value)
    below, at_most = F.count_if(v < score), F.count_if(v <= score)
    tie = F.when(F.count_if(v == score) > 0, 1).otherwise(0)
    return values.agg((50.0 * (below + at_most + tie) / F.count(v)).alias("percentile"))


def tdc_q_value(psms: DataFrame, by: tuple[str, ...] | None = None, unique: str = "psm_id", buckets: int = 1024) -> DataFrame:
    """Target-decoy competition: psms (score, is_decoy, ...) to the winning targets with q_value.

    The best match of each spectrum and charge wins (``by``; without a column charge, of each spectrum); at equal scores the
    decoy does. FDR at a score is (decoys + 1) / targets over
    all winners of at least that score, at most 1; the q-value is the least FDR at that score or a lower one.

    The order is global, but only counts per distinct score are ordered, and those in two levels: score ranges by
    quantiles, whose totals are a bounded table, and running sums within each range. No task sorts all matches.
    """
    by = by or ("sample", "scan", *(["charge"] if "charge" in psms.columns else []))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), F.desc("is_decoy"), unique))
    won = psms.withColumn("__r", rank).where("__r = 1").drop("__r")
    per = won.groupBy("score").agg(F.count_if("is_decoy").alias("d"), F.count_if(~F.col("is_decoy")).alias("t"))
    per = settled(_ranges(settled(per), "score", buckets))  # a row per distinct score, read several times below
    sums = per.groupBy("range").agg(F.sum("d").alias("sd"), F.sum("t").alias("st"))  # at most ``buckets`` rows
    above = W.orderBy(F.desc("range")).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("range", F.coalesce(F.sum("sd").over(above), F.lit(0)).alias("d0"), F.coalesce(F.sum("st").over(above), F.lit(0)).alias("t0"))
    within = W.partitionBy("range").orderBy(F.desc("score"))
    per = per.join(F.broadcast(sums), "range")
    d, t = F.col("d0") + F.sum("d").over(within), F.col("t0") + F.sum("t").over(within)
    per = per.withColumn("fdr", F.least(F.lit(1.0), (d + 1) / F.greatest(t, F.lit(1))))
    low = per.groupBy("range").agg(F.min("fdr").alias("m"))
    below = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    low = low.select("range", F.min("m").over(below).alias("m0"))
    up = W.partitionBy("range").orderBy("score")
    q = per.join(F.broadcast(low), "range").select("score", F.least(F.min("fdr").over(up), F.coalesce("m0", F.lit(1.0))).alias("q_value"))
    return won.where("not is_decoy").join(q, "score")


def delta_cn(psms: DataFrame, by: tuple[str, ...] = ("sample", "scan"), unique: str = "psm_id") -> DataFrame:
    """Rank within the spectrum, and (score - next score) / max(score, 1); null for the last."""
    w = W.partitionBy(*by).orderBy(F.desc("score"), unique)
    return psms.withColumn("num", F.row_number().over(w)).withColumn("delta_cn", (F.col("score") - F.lead("score").over(w)) / F.greatest(F.col("score"), F.lit(1.0)))


def rel_change(a: Column, b: Column) -> Column:
    """(a - b) / a; a zero a counts as 1e-5."""
    base = F.when(a == 0, F.lit(1e-5)).otherwise(a)
    return (a - b) / base


def rank_change(native: DataFrame, hybrid: DataFrame, value: str = "score") -> DataFrame:
    """Per spectrum: change and rel_change of a column from the native to the hybrid search, native less hybrid, over the
    first-ranked matches (num = 1) of both."""
    best = lambda df, name: top_ranked(df).groupBy(*SPECTRUM).agg(F.max(value).cast("double").alias(name))
    df = best(native, "native").join(best(hybrid, "hybrid"), SPECTRUM)
    n, h = F.col("native"), F.col("hybrid")
    return df.select(*SPECTRUM, (n - h).alias("change"), rel_change(n, h).alias("rel_change"))


def native_hybrid_change(native: DataFrame, hybrid: DataFrame) -> DataFrame:
    """Per spectrum that both searches have, over all matches: the best scores, their change (hybrid less native) and the
    change relative to the native score (null where that is zero), the largest and the least native e-value, the most ions
    matched and their change, and the numbers of matches."""

    def best(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*SPECTRUM).agg(
            F.max("score").alias(f"{name}_score"), F.max("eval").alias(f"{name}_eval"), F.min("eval").alias(f"{name}_least_eval"),
            F.max("ions_matched").alias(f"{name}_ions"), F.count("*").alias(f"{name}_n"),
        )

    df = best(native, "native").join(best(hybrid, "hybrid").drop("hybrid_eval", "hybrid_least_eval"), SPECTRUM)
    n, h = F.col("native_score"), F.col("hybrid_score")
    df = df.withColumn("change", h - n).withColumn("rel_change", (h - n) / F.nullif(n, F.lit(0.0)))
    return df.withColumn("ions_change", F.col("hybrid_ions") - F.col("native_ions"))


def union_scans(native: DataFrame, hybrid: DataFrame) -> tuple[str, int]:
    """Sample and scan of two lists of matches, which must all be of one spectrum; anything else is an error."""
    found = native.select(*SPECTRUM).union(hybrid.select(*SPECTRUM)).distinct().take(2)
    if len(found) != 1:
        raise ValueError("the matches are not of one spectrum" if found else "there are no matches")
    return found[0][0], found[0][1]


def psm_groups(psms: DataFrame, order: str = "num") -> DataFrame:
    """sample, scan, group: the matches of each spectrum as an array of structs in the order of a column. A spectrum's
    matches are few, as searches list the best ones only."""
    others = [c for c in psms.columns if c not in (*SPECTRUM, order)]
    row = F.struct(order, *others)
    return psms.groupBy(*SPECTRUM).agg(F.sort_array(F.collect_list(row)).alias("group"))


def fcn_of_psms(psms: DataFrame, value: str, fcn, by: list[str]) -> DataFrame:
    """by, value: an aggregate function (such as F.min) of a column per group."""
    return psms.groupBy(*by).agg(fcn(value).alias(value))


def arg_fcn_of_psms(psms: DataFrame, value: str, fcn, by: list[str]) -> DataFrame:
    """All matches that attain their group's value of the aggregate function, ties kept."""
    top = psms.groupBy(*by).agg(fcn(value).alias("__top"))
    return psms.join(top, by).where(F.col(value) == F.col("__top")).drop("__top")


def seq_with_hyphen(psms: DataFrame) -> DataFrame:
    """Adds forms: left-right of each protein of a hybrid match, and the plain sequence of any other."""
    sides = F.transform("proteins", lambda p: F.substring(p, len(HYBRID_PREFIX) + 1, F.length(p)))
    return psms.withColumn("forms", F.when(is_hybrid(F.col("proteins")) & (F.size("proteins") > 0), F.array_sort(F.array_distinct(sides))).otherwise(F.array("seq")))


def save_hybrids(psms: DataFrame, table: DataFrame, most_q: float = 0.01, min_side: int = 1) -> DataFrame:
    """Confident hybrid matches with every possible split, one row per pair; matches without a split vanish."""
    return possible_hybrids(hybrid_psms(high_confidence(psms, most_q)), table, min_side)


def concat_protein_names(hybrids: DataFrame, proteins: DataFrame) -> DataFrame:
    """left_ids and right_ids (arrays of prot_id) to left_proteins and right_proteins, sorted names of each hybrid, joined by
    ``hybrid_id``; ids without a protein are left out."""
    for side in ("left", "right"):
        ids = hybrids.select("hybrid_id", F.explode(f"{side}_ids").alias("prot_id")).join(proteins.select("prot_id", "name"), "prot_id")
        names = ids.groupBy("hybrid_id").agg(F.sort_array(F.collect_set("name")).alias(f"{side}_proteins"))
        hybrids = hybrids.join(names, "hybrid_id", "left").withColumn(f"{side}_proteins", F.coalesce(f"{side}_proteins", F.array().cast("array<string>")))
    return hybrids
