"""Spectra that arrive as a stream against a static k-mer table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.masses import DEFAULT_PPM
from ..operators.ions import peak_probes
from ..operators.range_join import range_join


def stream_peak_ion_match(peaks: DataFrame, spectra: DataFrame, table: DataFrame, ppm: float = DEFAULT_PPM, width: float = 0.1, keep: tuple[str, ...] = ()) -> DataFrame:
    """peaks: a stream (sample, scan, peak_id, mz); spectra and table static. Stateless, so no watermark is needed. keep: other
    columns of the peaks that go along."""
    probes = peak_probes(peaks, spectra, ppm, keep).where("hi > 0 and lo <= most")
    return range_join(table, probes, "aa_mass", "lo", "hi", width).where("aa_mass <= most").drop("lo", "hi", "most")
