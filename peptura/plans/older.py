"""The older engine from spectra and proteins to its result table, as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masses import legacy_mass
from ..operators.legacy import aligned_peptides, best_complement, legacy_clusters, legacy_extend, legacy_kmers, legacy_mass_join, legacy_output, legacy_precursors


@dataclass(frozen=True)
class OlderConfig:
    """Parameters of a run. digest_left, digest_right: letters after or before which a protein is cut, ``-`` for no rule."""

    max_k: int = 25
    ppm: float = 10.0
    decimals: int = 4
    num_peaks: int = 0
    share: float = 0.0
    digest_left: tuple[str, ...] = ("-",)
    digest_right: tuple[str, ...] = ("-",)


def spectrum_key(sample, scan):
    return F.concat_ws(":", sample, scan.cast("string"))


def identify(spectra: DataFrame, proteins: DataFrame, config: OlderConfig | None = None) -> DataFrame:
    """spectra (sample, scan, precursor_mz, precursor_charge, peaks) and proteins (prot_id, name, seq) to aligned_peptides
    with precursor_mz and precursor_charge; prec_id is ``sample:scan``."""
    config = config or OlderConfig()
    fragments = legacy_precursors(spectra, config.decimals, config.num_peaks, config.share).withColumn("prec_id", spectrum_key(F.col("sample"), F.col("scan")))
    kmers = legacy_kmers(proteins, config.max_k, list(config.digest_left), list(config.digest_right)).withColumn("kmer_mass", legacy_mass(F.col("kmer")))
    met = legacy_mass_join(fragments.select("prec_id", "precursor_mz", "frag_id", "mz"), kmers, config.ppm).drop("mz")
    found = legacy_extend(legacy_clusters(met), proteins.select("prot_id", "seq"))
    found = found.join(proteins.select("prot_id", F.length("seq").alias("seq_length")), "prot_id")
    precursors = fragments.select("prec_id", "precursor_mz", "precursor_charge").distinct()
    return aligned_peptides(best_complement(found)).join(precursors, "prec_id")


def run(spectra: DataFrame, proteins: DataFrame, config: OlderConfig | None = None) -> DataFrame:
    """The 15 columns of the older engine's result table."""
    return legacy_output(identify(spectra, proteins, config), proteins.select("prot_id", "name"))
