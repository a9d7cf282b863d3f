"""A search of spectra against peptides by shared peaks, in place of the external program; its result tables can be read
instead (sources.tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.masses import aa_mass, precursor_mz
from ..plans.settings import ScorerSettings
from .ions import product_ions
from .keys import SPECTRUM
from .range_join import range_join


def candidates(spectra: DataFrame, peptides: DataFrame, settings: ScorerSettings) -> DataFrame:
    """sample, scan, charge, seq: peptides (seq) of a fitting length whose m/z at the precursor's charge lies within ppm of the
    precursor. Peptides with unknown residues have no mass and fit nothing."""
    n = F.length("seq")
    own = peptides.where((n >= settings.least_length) & (n <= settings.most_length)).select("seq").distinct()
    own = own.select("seq", aa_mass(F.col("seq")).alias("m"), F.explode(F.sequence(F.lit(1), F.lit(settings.most_charge))).alias("charge"))
    own = own.select("seq", "charge", precursor_mz(F.col("m"), F.col("charge")).alias("mz")).where("mz is not null")
    m = F.col("precursor_mz")
    spans = spectra.select(*SPECTRUM, F.col("precursor_charge").alias("charge"), (m - m * settings.precursor_ppm / 1e6).alias("lo"), (m + m * settings.precursor_ppm / 1e6).alias("hi"))
    return range_join(own, spans, "mz", "lo", "hi", 0.1, on=["charge"]).select(*SPECTRUM, "charge", "seq")


def search_spectra(spectra: DataFrame, peaks: DataFrame, peptides: DataFrame, settings: ScorerSettings | None = None) -> DataFrame:
    """sample, scan, seq, ions_matched, ions_total, score (their ratio), num: the top_n peptides of every spectrum.

    An ion counts as matched if its m/z bin, or one beside it with ``flanking``, holds a peak. Ions have charge 1, and 2 where
    the precursor has more than 2. Peaks and ions meet in an equi-join on (spectrum, bin).
    """
    settings = settings or ScorerSettings()
    found = candidates(spectra, peptides, settings)
    charges = [1, 2] if settings.most_charge > 2 else [1]
    ions = product_ions(found.select("seq").distinct(), charges).select("seq", "ion_type", "ion_seq", F.col("charge").alias("z"), F.floor(F.col("mz") / settings.bin_width).alias("bin"))
    wanted = found.join(ions, "seq").where("z = 1 or charge > 2")
    beside = F.explode(F.array(*[F.lit(i) for i in ((-1, 0, 1) if settings.flanking else (0,))]))
    bins = peaks.select(*SPECTRUM, F.floor(F.col("mz") / settings.bin_width).alias("own"), beside.alias("d")).select(*SPECTRUM, (F.col("own") + F.col("d")).alias("bin")).distinct()
    met = wanted.join(bins.withColumn("hit", F.lit(1)), [*SPECTRUM, "bin"], "left")
    scored = met.groupBy(*SPECTRUM, "seq").agg(F.count("hit").alias("ions_matched"), F.count("*").alias("ions_total"))
    scored = scored.withColumn("score", F.col("ions_matched") / F.col("ions_total"))
    best = W.partitionBy(*SPECTRUM).orderBy(F.desc("score"), "seq")
    return scored.withColumn("num", F.row_number().over(best)).where(F.col("num") <= settings.top_n)
