"""Hybrids: pairs of pieces that add up to the precursor, without native sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masses import DEFAULT_PPM, PROTON_MASS, WATER_MASS, aa_mass, y_mz
from ..functions.sequences import counted, fasta_description, hybrid_name, hyphenated
from .clusters import pieces
from .keys import SPECTRUM
from .kmers import contains_seq
from .range_join import range_join
from .settle import settled


def piece_proteins(found: DataFrame) -> DataFrame:
    """Distinct pieces per spectrum and side with the sorted set of their proteins."""
    return found.groupBy(*SPECTRUM, "side", "piece").agg(F.sort_array(F.collect_set("protein")).alias("proteins"))


def pieces_with_proteins(extended: DataFrame) -> DataFrame:
    """piece_proteins of extended clusters. Clusters of one spectrum that grew to the same sequence become one row with
    their proteins before pieces are cut, so a sequence that many proteins share is cut once."""
    same = extended.where("extended_seq is not null").groupBy(*SPECTRUM, "ion_type", "extended_seq", "shortest").agg(F.collect_set("protein").alias("protein"))
    every = F.sort_array(F.array_distinct(F.flatten(F.collect_list("protein"))))
    return pieces(same).groupBy(*SPECTRUM, "side", "piece").agg(every.alias("proteins"))


def hybrid_pairs(found: DataFrame, spectra: DataFrame, ppm: float = DEFAULT_PPM) -> DataFrame:
    """piece_proteins x spectra to (sample, scan, left_seq, right_seq, left_proteins, right_proteins): the second range join.

    m/z of left and right at the precursor's charge must add up to the precursor within ppm of it. Both sides of a piece
    (two rows at most) are put in one row first, and that table is settled: the two branches of the join read it, and the
    search that made the pieces runs once. Pairs are dealt to as many partitions as pieces were, if the session's are fewer.
    """
    m, z = F.col("precursor_mz"), F.col("precursor_charge")
    df = found.join(spectra.select(*SPECTRUM, "precursor_mz", "precursor_charge"), SPECTRUM)
    df = df.groupBy(*SPECTRUM, "precursor_mz", "precursor_charge", "piece").agg(F.collect_list(F.struct("side", "proteins")).alias("sides"))
    df = settled(df.withColumn("mz", y_mz(aa_mass(F.col("piece")), z)))
    n = df.rdd.getNumPartitions()
    n = n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
    of = lambda side: F.get(F.filter("sides", lambda s: s["side"] == side), F.lit(0))["proteins"]
    target, tol = m + F.lit(WATER_MASS) / z + PROTON_MASS - F.col("mz"), F.lit(ppm) * m / 1e6
    left = df.select(*SPECTRUM, F.col("piece").alias("left_seq"), of("L").alias("left_proteins"), (target - tol).alias("lo"), (target + tol).alias("hi"))
    right = df.select(*SPECTRUM, F.col("piece").alias("right_seq"), of("R").alias("right_proteins"), F.col("mz").alias("right_mz"))
    left, right = left.where("left_proteins is not null"), right.where("right_proteins is not null")
    return range_join(right, left, "right_mz", "lo", "hi", 0.1, on=SPECTRUM, partitions=n).drop("lo", "hi", "right_mz")


def remove_native(hybrids: DataFrame, kmers: DataFrame) -> DataFrame:
    """Drops hybrids whose joined sequence is a known k-mer."""
    df = hybrids.withColumn("kmer", F.concat("left_seq", "right_seq"))
    return df.join(kmers.select("kmer"), "kmer", "left_anti").drop("kmer")


def remove_contained(hybrids: DataFrame, proteins: DataFrame) -> DataFrame:
    """Drops hybrids whose joined sequence stands in some protein, however long it is."""
    # the search that made the hybrids is read twice
    df = settled(hybrids.withColumn("__seq", F.concat("left_seq", "right_seq")))
    native = contains_seq(proteins, df.select(F.col("__seq").alias("query")))
    return df.join(native.withColumnRenamed("query", "__seq"), "__seq", "left_anti").select(*hybrids.columns)


def hybrids_by_sequence(hybrids: DataFrame) -> DataFrame:
    """sample, scan, seq, hyphenated forms (sorted): A-BC and AB-C are one sequence."""
    forms = F.sort_array(F.collect_set(hyphenated(F.col("left_seq"), F.col("right_seq"))))
    return hybrids.groupBy(*SPECTRUM, F.concat("left_seq", "right_seq").alias("seq")).agg(forms.alias("forms"))


def hybrids_fasta(hybrids: DataFrame) -> DataFrame:
    """name, description, seq of the hybrids as FASTA records."""
    return hybrids.select(
        hybrid_name(F.col("left_seq"), F.col("right_seq")).alias("name"),
        fasta_description(F.col("left_proteins"), F.col("right_proteins")).alias("description"),
        F.concat("left_seq", "right_seq").alias("seq"),
    )


def split_points(psms: DataFrame, min_side: int = 1) -> DataFrame:
    """psms (seq, ...) x the places at which they may be cut: cut, left_seq, right_seq."""
    n = F.length("seq")
    df = psms.withColumn("cut", F.explode(counted(F.lit(min_side), n - min_side)))
    return df.withColumn("left_seq", F.left("seq", F.col("cut"))).withColumn("right_seq", F.substring("seq", F.col("cut") + 1, n))


def possible_hybrids(psms: DataFrame, table: DataFrame, min_side: int = 1) -> DataFrame:
    """Splits of which both sides are known k-mers (kmer, proteins)."""
    left = table.select(F.col("kmer").alias("left_seq"), F.col("proteins").alias("left_proteins"))
    right = table.select(F.col("kmer").alias("right_seq"), F.col("proteins").alias("right_proteins"))
    return split_points(psms, min_side).join(left, "left_seq").join(right, "right_seq")
