"""The hybrid search over all spectra as one plan."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clusters import cluster_filter, clusters, extend_clusters
from ..operators.hybrids import hybrid_pairs, pieces_with_proteins, remove_contained
from ..operators.ions import counted_matches, peak_ion_match, position_ions
from ..operators.kmers import kmer_masses, kmer_places
from ..operators.psms import high_confidence, protein_counts, top_n_proteins
from ..operators.spectra import top_n_peaks
from ..sources.tables import find_setting


@dataclass(frozen=True)
class SearchConfig:
    """Parameters of a search, with the reference's defaults. scans: the scans searched; 0 alone stands for all."""

    min_k: int = 1
    max_k: int = 25
    peak_ppm: float = 20.0
    precursor_ppm: float = 20.0
    min_cluster_length: int = 3
    min_cluster_support: int = 2
    q_value: float = 0.01
    top_n_proteins: int = 10
    num_peaks: int = 0
    min_side: int = 1
    scans: tuple[int, ...] = (0,)

    @classmethod
    def from_settings(cls, settings: dict) -> SearchConfig:
        """From a settings file (sources.tables.read_yaml): names at any depth, others are left at their defaults."""
        found = {f.name: find_setting(settings, f.name) for f in fields(cls)}
        found = {n: tuple(v) if isinstance(v, list) else v for n, v in found.items() if v is not None}
        return cls(**found)


def extended_clusters(spectra: DataFrame, peaks: DataFrame, proteins: DataFrame, table: DataFrame, places: DataFrame, config: SearchConfig) -> DataFrame:
    matches = counted_matches(peak_ion_match(top_n_peaks(peaks, config.num_peaks), spectra, table, config.peak_ppm))
    found = cluster_filter(clusters(position_ions(matches, places)), config.min_cluster_length, config.min_cluster_support)
    return extend_clusters(found, proteins, spectra, config.precursor_ppm)


def find_hybrids(
    spectra: DataFrame, peaks: DataFrame, proteins: DataFrame, config: SearchConfig | None = None, table: DataFrame | None = None, places: DataFrame | None = None
) -> DataFrame:
    """sample, scan, left_seq, right_seq, left_proteins, right_proteins of all spectra, natives of any length removed.

    table (kmer, aa_mass) and places (kmer, protein, starts) are made from the proteins unless stored ones are given.
    """
    config = config or SearchConfig()
    spectra = spectra if config.scans == (0,) else spectra.where(F.col("scan").isin(*config.scans))
    table = kmer_masses(proteins, config.max_k, config.min_k) if table is None else table
    places = kmer_places(proteins, config.max_k, config.min_k) if places is None else places
    found = pieces_with_proteins(extended_clusters(spectra, peaks, proteins, table.select("kmer", "aa_mass"), places, config))
    return remove_contained(hybrid_pairs(found, spectra, config.precursor_ppm), proteins)


def abundant_proteins(psms: DataFrame, proteins: DataFrame, config: SearchConfig | None = None) -> DataFrame:
    """Proteins that confident matches name most often."""
    config = config or SearchConfig()
    top = top_n_proteins(protein_counts(high_confidence(psms, config.q_value)), config.top_n_proteins)
    return proteins.join(top.selectExpr("protein as name"), "name", "left_semi")
