"""The cross-correlation scorer against a plain loop over all pairs."""

import math
import random

import numpy as np
import pytest

from peptura.functions import masses as M
from peptura.operators import xcorr as X
from peptura.operators.psms import tdc_q_value
from peptura.plans.settings import ScorerSettings

P, WATER = M.PROTON_MASS, M.WATER_MASS


def units(seq):
    return sum(round(M.RESIDUES[c] * 10**7) for c in seq)


def values(peaks, s):
    """bin -> value and the bins that hold a peak, by sums written out."""
    y = {}
    for mz, v in peaks:
        if v > 0:
            b = math.floor(mz / s.bin_width)
            y[b] = max(y.get(b, 0), math.sqrt(v))
    top = max(y.values(), default=0)
    last = max(y, default=-1)
    y = {b: v for b, v in y.items() if v > s.least_share * top}
    size = max(last, 0) // s.windows + 1
    heights = {}
    for b, v in y.items():
        heights[b // size] = max(heights.get(b // size, 0), v)
    y = {b: v * 50 / heights[b // size] for b, v in y.items()}
    back = lambda i: y.get(i, 0) - sum(y.get(i + d, 0) for d in range(-s.background, s.background + 1) if d) / (2 * s.background)
    at = lambda i: back(i) + (0.5 * (back(i - 1) + back(i + 1)) if s.flanking else 0)
    return at, lambda i: any(y.get(i + d, 0) > 0 for d in ((-1, 0, 1) if s.flanking else (0,)))


def brute(spectra, peaks, peptides, s):
    out = {}
    pool = sorted({p for p in peptides if s.least_length <= len(p) <= s.most_length and all(c in M.RESIDUES for c in p)})
    for sample, scan, m, z in spectra:
        own = [(mz, v) for a, b, mz, v in peaks if (a, b) == (sample, scan)]
        if not 1 <= z <= s.most_charge or not own:
            continue
        at, met = values(own, s)
        scored = []
        for p in pool:
            mz = (units(p) / 1e7 + WATER + z * P) / z
            if not m - m * s.precursor_ppm / 1e6 <= mz <= m + m * s.precursor_ppm / 1e6:
                continue
            bins = set()
            for k in range(1, len(p)):
                for c in (1, 2) if z > 2 else (1,):
                    bins |= {math.floor((units(p[:k]) / 1e7 + c * P) / c / s.bin_width), math.floor((units(p[k:]) / 1e7 + WATER + c * P) / c / s.bin_width)}
            scored.append((-round(0.005 * sum(map(at, bins)), 9), p, sum(map(met, bins)), len(bins)))
        scored.sort()
        hist = {}
        for x, *_ in scored:
            b = math.floor(max(-x, 0) / s.score_step)
            hist[b] = hist.get(b, 0) + 1
        tail = [(b * s.score_step, math.log10(r)) for b in sorted(hist)[:-1] if 2 * (r := sum(n for c, n in hist.items() if c >= b)) <= len(scored)]
        fit = np.polyfit(*zip(*tail, strict=True), 1) if len(tail) >= s.least_tail else (0, 0)
        for i, (x, p, n, total) in enumerate(scored[: s.top_n]):
            out[sample, scan, i + 1] = (p, -x, n, total, 10 ** (fit[1] + fit[0] * -x) if fit[0] < 0 else None)
    return out


def world(rng, n=150):
    letters = "ACDEFGHIKLMNPQRSTVWY"
    peptides = ["".join(rng.choices(letters, k=rng.randrange(4, 14))) for _ in range(n)] + ["AXAAAA", "A" * 51, "ACDEFG", "CADEFG", "ACDEFG"]
    spectra, peaks = [], []
    for i, p in enumerate(peptides[:25] + ["ACDEFG"]):
        z = 1 + i % 4
        spectra.append(("s" if i % 2 else "t", i // 2, (units(p) / 1e7 + WATER + z * P) / z, z))
        key = spectra[-1][:2]
        for k in range(1, len(p)):
            if rng.random() < 0.8:
                peaks.append((*key, units(p[:k]) / 1e7 + P, rng.uniform(1, 100)))
                peaks.append((*key, units(p[k:]) / 1e7 + WATER + P, rng.uniform(1, 100)))
        peaks += [(*key, rng.uniform(50, 1500), rng.uniform(0, 20)) for _ in range(20)]
    return spectra + [("none", 1, 500.0, 2)], peaks, peptides


def frames(spark, spectra, peaks, peptides):
    return (
        spark.createDataFrame(spectra, "sample string, scan long, precursor_mz double, precursor_charge int"),
        spark.createDataFrame(peaks, "sample string, scan long, mz double, intensity double"),
        spark.createDataFrame([(p,) for p in peptides], "seq string"),
    )


@pytest.mark.parametrize(("settings", "blocks"), [(ScorerSettings(precursor_ppm=200_000.0, score_step=0.02), {}), (ScorerSettings(precursor_ppm=300_000.0, flanking=False, top_n=3, bin_width=0.5, background=9), {"width": 40.0, "block_peptides": 4, "block_spectra": 2})])
def test_against_a_plain_loop(spark, settings, blocks):
    spectra, peaks, peptides = world(random.Random(7))
    got = X.xcorr_search(*frames(spark, spectra, peaks, peptides), settings, **blocks).collect()
    want = brute(spectra, peaks, peptides, settings)
    assert {(r["sample"], r["scan"], r["num"]) for r in got} == set(want)
    fitted = 0
    for r in got:
        seq, x, n, total, e = want[r["sample"], r["scan"], r["num"]]
        assert r["xcorr"] == pytest.approx(x, abs=1e-8) and (r["seq"], r["ions_matched"], r["ions_total"]) == (seq, n, total)
        assert (r["eval"] is None) == (e is None) and (e is None or r["eval"] == pytest.approx(e, rel=1e-6))
        fitted += e is not None
        following = want.get((r["sample"], r["scan"], r["num"] + 1))
        assert (r["delta_cn"] is None) == (following is None or x <= 0) and (following is None or x <= 0 or r["delta_cn"] == pytest.approx((x - following[1]) / x, abs=1e-6))
    assert fitted > 20


def test_right_peptides_win_and_decoys_compete(spark):
    spectra, peaks, peptides = world(random.Random(8), 300)
    found = X.search_with_decoys(*frames(spark, spectra, peaks, peptides), ScorerSettings(precursor_ppm=50_000.0))
    first = found.where("num = 1").collect()
    right = {(s[0], s[1]): p for s, p in zip(spectra, peptides[:25], strict=False)}
    asked = [r for r in first if (r["sample"], r["scan"]) in right and len(right[r["sample"], r["scan"]]) >= 5]
    assert sum(r["seq"] == right[r["sample"], r["scan"]] for r in asked) >= 0.9 * len(asked)
    assert found.where("is_decoy").count() > 0
    assert tdc_q_value(found.withColumnRenamed("seq", "psm_id")).where("q_value < 0.5").count() > 5


def test_samples_with_results_are_skipped(spark, tmp_path):
    spectra, peaks, peptides = world(random.Random(9), 60)
    s, p, q = frames(spark, spectra, peaks, peptides)
    wide = ScorerSettings(precursor_ppm=100_000.0)
    folder = f"file://{tmp_path}/found"
    assert X.search_missing(s.where("sample = 's'"), p, q, folder, wide) == ["s"]
    before = spark.read.parquet(folder).count()
    assert X.search_missing(s.where("sample <> 'none'"), p, q, folder, wide) == ["t"]
    assert X.search_missing(s.where("sample <> 'none'"), p, q, folder, wide) == []
    after = spark.read.parquet(folder)
    assert after.where("sample = 's'").count() == before and after.where("sample = 't'").count() > 0


def test_nothing_to_search(spark):
    s, p, q = frames(spark, *world(random.Random(1), 40))
    for a, b, c in ((s.limit(0), p, q), (s, p.limit(0), q), (s, p, q.limit(0)), (s, p, q.where("seq like '%X%'"))):
        assert X.xcorr_search(a, b, c).collect() == []
