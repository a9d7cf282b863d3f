"""Clusters of spectra whose peaks arrive as a stream, late ones too.

Peaks are matched with the static k-mer table and placed as in a batch; what is kept per (sample, scan) is one entry for each
cluster so far. A spectrum's clusters are given out once the watermark has passed its last peak by ``wait``; a peak that comes
after that is too late and is dropped, as its time is below the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.masses import DEFAULT_PPM
from ..operators.ions import position_ions
from ..operators.keys import SPECTRUM
from .matches import stream_peak_ion_match

KEY = ["ion_type", "protein", "anchor"]
_CLUSTERS = "sample string, scan long, ion_type string, protein string, anchor int, support long, start int, end int, shortest int, length int"
_STATE = "ion_type array<string>, protein array<string>, anchor array<int>, support array<long>, start array<int>, end array<int>, shortest array<int>, last long"


def merged(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """Clusters of several batches of ions to one row for each (ion_type, protein, anchor)."""
    how = {"support": "sum", "start": "min", "end": "max", "shortest": "min"}
    return pd.concat(parts).groupby(KEY, as_index=False, sort=True).agg(how)


def stream_clusters(peaks: DataFrame, spectra: DataFrame, table: DataFrame, places: DataFrame, time: str = "time", delay: str = "10 minutes", wait: str = "5 minutes", ppm: float = DEFAULT_PPM) -> DataFrame:
    """sample, scan, ion_type, protein, anchor, support, start, end, shortest, length: the rows of operators.clusters.clusters.

    peaks: a stream (sample, scan, peak_id, mz, and a column with the event's time); delay: how late a peak may be; wait: how
    long a spectrum stays open after its last peak. spectra, table and places are static.
    """
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    timed = peaks.withColumnRenamed(time, "time").withWatermark("time", delay)
    matched = stream_peak_ion_match(timed, spectra, table, ppm, keep=("time",))
    ions = position_ions(matched, places)
    anchor = F.when(F.col("ion_type") == "b", F.col("start")).otherwise(F.col("end"))
    ions = ions.select(*SPECTRUM, "ion_type", "protein", anchor.alias("anchor"), "start", "end", F.length("kmer").alias("shortest"), "time")

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = None
        if state.exists:
            *columns, last = state.get
            held = pd.DataFrame(dict(zip([*KEY, "support", "start", "end", "shortest"], columns, strict=True)))
        else:
            last = 0
        if state.hasTimedOut:
            state.remove()
            out = held.assign(sample=key[0], scan=key[1], length=held["end"] - held["start"])
            yield out[[f.strip().split(" ")[0] for f in _CLUSTERS.split(",")]]
            return
        mark = state.getCurrentWatermarkMs()
        parts = [] if held is None else [held]
        for b in batches:
            at = b["time"].astype("int64") // 10**6 if str(b["time"].dtype).startswith("datetime64[ns") else b["time"].astype("datetime64[ms]").astype("int64")
            b, at = b[at >= mark], at[at >= mark]
            if len(b):
                last = max(last, int(at.max()))
                parts.append(b.assign(support=1)[[*KEY, "support", "start", "end", "shortest"]])
        if parts:
            held = merged(parts)
            state.update((*[held[c].tolist() for c in (*KEY, "support", "start", "end", "shortest")], last))
            state.setTimeoutTimestamp(max(last + wait_ms, mark + 1))

    return ions.groupBy(*SPECTRUM).applyInPandasWithState(update, _CLUSTERS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
