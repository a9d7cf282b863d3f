"""Peptides against spectra: matched ions, supported intensity, junction support."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.masses import aa_mass, ppm_diff, precursor_mz
from ..functions.sequences import is_hybrid, junction_seqs
from .ions import product_ions
from .keys import SPECTRUM
from .range_join import outer_range_join


def peaks_vs_product_ions(peptides: DataFrame, peaks: DataFrame, ppm: float = 20.0, charges: tuple[int, ...] = (1, 2)) -> DataFrame:
    """peptides (pid, sample, scan, seq) x peaks: one row per ion with the ids of the peaks within ppm of it (relative to
    the ion), empty where none is: pid, sample, scan, ion_seq, ion_type, charge, mz, peak_ids, intensity (sum over those peaks)."""
    ions = product_ions(peptides, list(charges), keep=("pid", *SPECTRUM, "seq")).drop("seq")
    m = F.col("mz")
    spans = ions.withColumn("lo", m - m * ppm / 1e6).withColumn("hi", m + m * ppm / 1e6)
    p = peaks.select(*SPECTRUM, F.col("mz").alias("peak_mz"), "peak_id", "intensity")
    # tolerances are relative, so on a logarithmic scale all intervals are equally wide; 1 % more is for rounding
    width = 1.01 * math.log((1 + ppm / 1e6) / (1 - ppm / 1e6)) + 1e-12
    met = outer_range_join(spans, p, "peak_mz", "lo", "hi", width, on=SPECTRUM, scale=F.ln)
    return met.groupBy("pid", *SPECTRUM, "ion_seq", "ion_type", "charge", "mz").agg(
        F.sort_array(F.collect_list("peak_id")).alias("peak_ids"), F.coalesce(F.sum("intensity"), F.lit(0.0)).alias("intensity")
    )


def matches_by_seq_and_type(matched: DataFrame) -> DataFrame:
    return matched.groupBy("pid", "ion_type", "ion_seq").agg(
        F.sum(F.size("peak_ids")).alias("n_peaks"), F.sort_array(F.flatten(F.collect_list("peak_ids"))).alias("peak_ids")
    )


def peptide_spectrum_report(peptides: DataFrame, peaks: DataFrame, ppm: float = 20.0, charges: tuple[int, ...] = (1, 2)) -> DataFrame:
    """One row per peptide (pid, sample, scan, seq, and left_seq, right_seq or nulls): supported intensity shares (a peak
    that two ions meet counts twice; ``n_peaks_distinct`` counts once), supported ions, and supported sequences that span
    the junction with their share of all that do (null if none can). A sequence counts as spanning for either ion type."""
    met = peaks_vs_product_ions(peptides, peaks, ppm, charges)
    b, y = junction_seqs(F.col("left_seq"), F.col("right_seq"))
    info = peptides.select("pid", "seq", F.coalesce(F.concat(b, y), F.array().cast("array<string>")).alias("junction"))
    total = peaks.groupBy(*SPECTRUM).agg(F.sum("intensity").alias("total"))
    df = met.join(info, "pid").join(total, SPECTRUM, "left")
    hit, is_b = F.size("peak_ids") > 0, F.col("ion_type") == "b"
    span = F.array_contains("junction", F.col("ion_seq"))
    share = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("intensity"))), F.lit(0.0)) / F.max("total")
    seqs = lambda cond: F.count_distinct(F.when(cond & hit, F.col("ion_seq")))
    out = df.groupBy("pid", *SPECTRUM, "seq").agg(
        share(F.lit(True)).alias("share_by"), share(is_b).alias("share_b"), share(~is_b).alias("share_y"), share(span).alias("share_hybrid"),
        seqs(is_b).alias("n_b"), seqs(~is_b).alias("n_y"), F.count_distinct(F.when(span & hit, F.col("ion_seq"))).alias("n_hybrid"),
        F.count_distinct(F.when(span, F.concat("ion_type", "ion_seq"))).alias("n_junction"),
        F.size(F.array_distinct(F.flatten(F.collect_list("peak_ids")))).cast("long").alias("n_peaks_distinct"),
    )
    out = out.withColumn("prop_hybrid", F.col("n_hybrid") / F.nullif(F.col("n_junction"), F.lit(0)))
    return out.withColumn("share_seqs", (F.col("n_b") + F.col("n_y")) / (2 * F.length("seq")))


def precursor_ppm_diff(peptides: DataFrame, spectra: DataFrame) -> DataFrame:
    """pid, ppm_diff: how far the spectrum's precursor lies from the peptide's, relative to the peptide's."""
    df = peptides.select("pid", *SPECTRUM, "seq").join(spectra.select(*SPECTRUM, F.col("precursor_mz").alias("measured"), "precursor_charge"), SPECTRUM)
    return df.select("pid", ppm_diff(precursor_mz(aa_mass(F.col("seq")), F.col("precursor_charge")), F.col("measured")).alias("ppm_diff"))


def psm_spectrum_report(psms: DataFrame, peaks: DataFrame, ppm: float = 20.0) -> DataFrame:
    """peptide_spectrum_report of matches (psm_id, sample, scan, seq, proteins ...) with the search's own columns beside it.
    A hybrid's sides come from its first protein's name."""
    name = F.element_at("proteins", 1)
    hybrid = is_hybrid(F.col("proteins")) & name.rlike("^hybrid_[^-]*-[^-]*$")
    side = lambda i: F.when(hybrid, F.regexp_extract(name, "^hybrid_([^-]*)-([^-]*)$", i))
    peptides = psms.select(F.col("psm_id").alias("pid"), *SPECTRUM, "seq", side(1).alias("left_seq"), side(2).alias("right_seq"))
    own = [c for c in ("score", "eval", "num", "ions_matched", "ions_total", "proteins", "q_value") if c in psms.columns]
    return peptide_spectrum_report(peptides, peaks, ppm).join(psms.select(F.col("psm_id").alias("pid"), *own), "pid").withColumnRenamed("pid", "psm_id")


def spectra_to_psms(spectra: DataFrame, psms: DataFrame, unique: str = "psm_id") -> DataFrame:
    """Each spectrum with its first match (by the unique column)."""
    first = W.partitionBy("sample", "scan").orderBy(unique)
    return spectra.join(psms.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r"), ["sample", "scan"])
