"""Clusters of positioned ions, and their extension up to the precursor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masses import DEFAULT_PPM, PROTON_MASS, RESIDUES, WATER_MASS, y_mz
from ..functions.sequences import counted
from .extension import STOP, chunk_of, count_at_most, mass_before, offset_in, running_masses
from .keys import SPECTRUM

MIN_LENGTH, MIN_SUPPORT = 3, 2


def clusters(ions: DataFrame) -> DataFrame:
    """Positioned ions (sample, scan, ion_type, protein, start, end, kmer) to clusters: b ions by start, y ions by end.
    Rows of counted_matches count ``n`` times."""
    support = F.sum("n") if "n" in ions.columns else F.count("*")
    anchor = F.when(F.col("ion_type") == "b", F.col("start")).otherwise(F.col("end"))
    return (
        ions.groupBy(*SPECTRUM, "ion_type", "protein", anchor.alias("anchor"))
        .agg(support.alias("support"), F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.length("kmer")).alias("shortest"))
        .withColumn("length", F.col("end") - F.col("start"))
    )


def cluster_filter(found: DataFrame, min_length: int = MIN_LENGTH, min_support: int = MIN_SUPPORT) -> DataFrame:
    return found.where((F.col("support") >= min_support) & (F.col("length") >= min_length))


def extend_clusters(found: DataFrame, proteins: DataFrame, spectra: DataFrame, ppm: float = DEFAULT_PPM) -> DataFrame:
    """Adds extended_seq: b clusters grown to the right, y clusters to the left, one residue at a time, while the m/z at
    the precursor's charge stays below precursor + ppm. Null where even the cluster itself is too heavy.

    Masses are positive, so the end is found by binary search in the protein's running masses, for the heaviest units that
    fit. Growth stops at an unknown residue and at the protein's end.
    """
    z, limit = F.col("precursor_charge"), F.col("precursor_mz") + F.lit(ppm) * F.col("precursor_mz") / 1e6
    fits = lambda units: y_mz(units / F.lit(1e7), z) < limit
    # the bound in closed form may be off by a unit's rounding; the rule itself decides
    near = F.floor(((limit - PROTON_MASS) * z - WATER_MASS) * 1e7).cast("long")
    heaviest = F.coalesce(*[F.when(fits(near + d), near + d) for d in (2, 1, 0, -1, -2)])
    # a residue weighs 57 Da at least
    reach = spectra.agg(F.max(F.floor(F.col("precursor_mz") * z * (1 + ppm / 1e6) / 57.0) + 1))
    table = running_masses(proteins.withColumnRenamed("name", "protein"), "protein", reach, {c: round(m * 10**7) for c, m in RESIDUES.items()})
    limits = spectra.select(*SPECTRUM, F.when(heaviest < STOP, heaviest).when(heaviest.isNotNull(), STOP - 1).alias("__most"))
    anchor = F.when(F.col("ion_type") == "b", F.col("start")).otherwise(F.col("end"))
    df = found.join(limits, SPECTRUM).withColumn("chunk", chunk_of(F.col("ion_type"), anchor)).join(table, ["protein", "ion_type", "chunk"])
    at = offset_in(F.col("ion_type"), anchor)
    df = df.withColumn("__n", count_at_most(F.col("masses"), mass_before(at) + F.col("__most")) - at)
    grown = F.substring("letters", at + 1, F.col("__n"))
    grown = F.when(F.col("__n") >= F.col("length"), F.when(F.col("ion_type") == "b", grown).otherwise(F.reverse(grown)))
    return df.select(*[F.col(c) for c in found.columns], grown.alias("extended_seq"))


def pieces(extended: DataFrame) -> DataFrame:
    """Extended clusters to rows (sample, scan, side, piece, protein): prefixes of b, suffixes of y, from the shortest ion on."""
    n = F.length("extended_seq")
    df = extended.where("extended_seq is not null").withColumn("n", F.explode(counted(F.col("shortest"), n)))
    piece = F.when(F.col("ion_type") == "b", F.left("extended_seq", F.col("n"))).otherwise(F.right("extended_seq", F.col("n")))
    return df.select(*SPECTRUM, F.when(F.col("ion_type") == "b", "L").otherwise("R").alias("side"), piece.alias("piece"), "protein")
