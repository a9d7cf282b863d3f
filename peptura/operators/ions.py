"""Product ions and their matches with peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masses import DEFAULT_PPM, PROTON_MASS, WATER_MASS, aa_mass, b_ion_bounds, ion_mz, y_ion_bounds
from ..functions.sequences import prefixes, suffixes
from .keys import SPECTRUM
from .range_join import range_join


def product_ions(peptides: DataFrame, charges: list[int], keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """peptides (seq, ...) to rows (kept, ion_seq, ion_type, charge, mz): prefixes are b ions, suffixes y ions."""
    kinds = F.array(
        F.struct(F.lit("b").alias("ion_type"), prefixes(F.col("seq")).alias("seqs")),
        F.struct(F.lit("y").alias("ion_type"), suffixes(F.col("seq")).alias("seqs")),
    )
    df = peptides.select(*keep, F.explode(kinds).alias("kind"))
    df = df.select(*keep, F.col("kind.ion_type").alias("ion_type"), F.explode("kind.seqs").alias("ion_seq"))
    df = df.withColumn("aa_mass", aa_mass(F.col("ion_seq"))).withColumn("charge", F.explode(F.array(*map(F.lit, charges))))
    return df.withColumn("mz", ion_mz(F.col("aa_mass"), F.col("charge"), F.col("ion_type"))).drop("aa_mass")


def peak_probes(peaks: DataFrame, spectra: DataFrame, ppm: float = DEFAULT_PPM, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per peak, charge up to the precursor's and ion type: bounds lo, hi on the residue mass and most, the
    residue mass of the precursor, which a matching k-mer may not exceed."""
    df = peaks.join(spectra.select(*SPECTRUM, "precursor_mz", "precursor_charge"), SPECTRUM)
    df = df.withColumn("charge", F.explode(F.sequence(F.lit(1), F.col("precursor_charge"))))
    mz, z = F.col("mz"), F.col("charge")
    (b_lo, b_hi), (y_lo, y_hi) = b_ion_bounds(mz, z, ppm), y_ion_bounds(mz, z, ppm)
    span = lambda kind, lo, hi: F.struct(F.lit(kind).alias("ion_type"), lo.alias("lo"), hi.alias("hi"))
    df = df.withColumn("span", F.explode(F.array(span("b", b_lo, b_hi), span("y", y_lo, y_hi))))
    return df.select(
        *SPECTRUM, *keep, "peak_id", "mz", "charge", "precursor_charge", "precursor_mz", "span.ion_type", "span.lo", "span.hi",
        (F.col("precursor_charge") * (F.col("precursor_mz") - PROTON_MASS) - WATER_MASS).alias("most"),
    )


def peak_ion_match(peaks: DataFrame, spectra: DataFrame, table: DataFrame, ppm: float = DEFAULT_PPM, width: float = 0.1) -> DataFrame:
    """The search's range join: k-mers (kmer, aa_mass, ...) whose ions lie within ppm of a peak and which are not heavier
    than the precursor. Repeats stay: a k-mer met by two peaks or charges counts twice."""
    probes = peak_probes(peaks, spectra, ppm).where("hi > 0 and lo <= most")
    return range_join(table, probes, "aa_mass", "lo", "hi", width).where("aa_mass <= most").drop("lo", "hi", "most")


def counted_matches(matches: DataFrame) -> DataFrame:
    """sample, scan, ion_type, kmer, n: how many peaks and charges of a spectrum meet a k-mer. Places and clusters need no
    more, so what goes on to the next joins is one row per k-mer, not one per peak and charge."""
    return matches.groupBy(*SPECTRUM, "ion_type", "kmer").agg(F.count("*").alias("n"))


def position_ions(matches: DataFrame, places: DataFrame) -> DataFrame:
    """Matches (kmer, ...) to one row per protein and place: protein, start, end. places: see kmer_places."""
    df = matches.join(places.select("kmer", "protein", "starts"), "kmer").withColumn("start", F.explode("starts")).drop("starts")
    return df.withColumn("end", F.col("start") + F.length("kmer"))
