"""Settings of the shared-peak scorer, and what the older driver needs of a machine."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class ScorerSettings:
    """The reference's settings of its search program, as far as this scorer has a use for them."""

    precursor_ppm: float = 20.0
    least_length: int = 5
    most_length: int = 50
    bin_width: float = 0.02
    most_charge: int = 3
    flanking: bool = True
    top_n: int = 5
    #: of the cross-correlation: bins on either side that make the background, windows of equal weight, least share of the
    #: base peak, width of a score's histogram bin, and the least number of bins that a tail is fitted to
    background: int = 75
    windows: int = 10
    least_share: float = 0.05
    score_step: float = 0.05
    least_tail: int = 3


def core_count(wanted: int) -> int:
    """At least one, and one less than the machine has at most."""
    return min(max(1, wanted), max(1, (os.cpu_count() or 2) - 1))


@dataclass
class MeanTimer:
    """Running mean of times."""

    count: int = 0
    mean: float = 0.0

    def add(self, seconds: float) -> float:
        self.count += 1
        self.mean += (seconds - self.mean) / self.count
        return self.mean
