"""A search of spectra against peptides by cross-correlation, with e-values from the tail of each spectrum's scores.

A spectrum becomes square roots of intensities in m/z bins, scaled to the same height in each of some windows; from every
bin the mean of the bins around it is subtracted, a window sum by prefix sums. A peptide's score is the sum over the
bins of its ions, so that a spectrum is prepared once and a candidate costs one look per ion.

Pairs are never rows. Peptides stand in blocks of near mass, with their ions in one array ordered by mass; spectra are sent
to the few blocks that their precursor's tolerance touches, and a spectrum's candidates are a slice of that array. Crowded
blocks are split, spectra of crowded blocks too. A block gives a spectrum's best peptides and a histogram of its scores,
and both add up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.masses import PROTON_MASS, RESIDUES, WATER_MASS, aa_mass
from ..functions.sequences import counted, decoy
from ..plans.settings import ScorerSettings
from .keys import SPECTRUM

BLOCK_PEPTIDES, BLOCK_SPECTRA = 1 << 15, 1 << 12
_UNITS = np.array([round(RESIDUES.get(chr(c), 0.0) * 10**7) for c in range(128)], np.int64)


def prepared(mz: np.ndarray, intensity: np.ndarray, s: ScorerSettings) -> tuple[np.ndarray, np.ndarray]:
    """Values to be summed over ions and whether a peak is met, by bin; bins beyond the arrays have neither."""
    own = (mz >= 0) & (intensity > 0)
    bins, roots = np.floor(mz[own] / s.bin_width).astype(np.int64), np.sqrt(intensity[own])
    y = np.zeros(int(bins.max(initial=-1)) + 1)
    np.maximum.at(y, bins, roots)
    y[y <= s.least_share * y.max(initial=0)] = 0
    size = max(len(y) - 1, 0) // s.windows + 1
    for w in range(0, len(y), size):
        top = y[w : w + size].max()
        y[w : w + size] *= 50 / top if top > 0 else 0
    b = s.background
    y = np.concatenate([y, np.zeros(b + 2)])  # beyond the last peak there is a background still
    sums = np.concatenate([[0.0], np.cumsum(y)])
    at = np.arange(len(y))
    around = sums[np.minimum(at + b + 1, len(y))] - sums[np.maximum(at - b, 0)] - y
    x, met = y - around / (2 * b), y > 0
    if s.flanking:
        near = lambda v: (np.concatenate([v[1:], [0]]), np.concatenate([[0], v[:-1]]))
        up, down = near(x)
        x = x + 0.5 * (up + down)
        up, down = near(met)
        met = met | up.astype(bool) | down.astype(bool)
    return np.append(x, 0.0), np.append(met, False)


class Ions:
    """Distinct ion bins of peptides in order of mass: those of peptide i are ``bins[starts[i]:starts[i + 1]]``."""

    def __init__(self, seqs: list[str], width: float, charges: list[int]):
        units = [_UNITS[np.frombuffer(q.encode("latin-1"), np.uint8)] for q in seqs]
        total = np.array([u.sum() for u in units], np.int64)
        order = np.lexsort((np.array(seqs, object), total)) if len(seqs) else np.empty(0, np.int64)
        self.seqs, self.mass = [seqs[i] for i in order], total[order] / 1e7
        who, bins = [], []
        for n, i in enumerate(order.tolist()):
            b = np.cumsum(units[i])[:-1]
            mass = np.concatenate([b / 1e7, (total[i] - b) / 1e7 + WATER_MASS])
            own = np.concatenate([np.floor((mass + z * PROTON_MASS) / z / width) for z in charges]) if len(b) else np.empty(0)
            own = np.unique(own.astype(np.int64))
            bins.append(own)
            who.append(len(own))
        self.bins = np.concatenate([np.empty(0, np.int64), *bins])
        self.starts = np.concatenate([[0], np.cumsum(who, dtype=np.int64)])

    def slice(self, charge: int, lo: float, hi: float) -> tuple[int, int]:
        """The peptides whose m/z at a charge lies within [lo, hi]."""
        mz = (self.mass + WATER_MASS + charge * PROTON_MASS) / charge
        return int(np.searchsorted(mz, lo, "left")), int(np.searchsorted(mz, hi, "right"))

    def scores(self, x: np.ndarray, met: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the peptides a..b, how many of their bins meet a peak, and how many bins they have."""
        at = np.minimum(self.bins[self.starts[a] : self.starts[b]], len(x) - 1)
        ends = self.starts[a : b + 1] - self.starts[a]
        sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[ends])
        return 0.005 * np.array([x[at[s:e]].sum() for s, e in zip(ends[:-1], ends[1:], strict=True)]), sums(met[at].astype(np.int64)), np.diff(ends)


_TOP = "array<struct<seq:string,xcorr:double,ions_matched:long,ions_total:long>>"
_FOUND = f"sample string, scan long, top {_TOP}, bins array<long>, counts array<long>"


def _scored(s: ScorerSettings):
    def run(spectra: pa.Table, peptides: pa.Table) -> pa.Table:
        rows, ions = [], {}
        seqs = peptides.column("seq").to_pylist()
        for r in spectra.to_pylist():
            charges = [1, 2] if r["charge"] > 2 else [1]
            if len(charges) not in ions:
                ions[len(charges)] = Ions(seqs, s.bin_width, charges)
            own = ions[len(charges)]
            a, b = own.slice(r["charge"], r["lo"], r["hi"])
            if a >= b:
                continue
            x, met = prepared(np.array([p["mz"] for p in r["peaks"]]), np.array([p["intensity"] for p in r["peaks"]]), s)
            score, matched, total = own.scores(x, met, a, b)
            score = np.round(score, 9)
            best = np.lexsort((np.array(own.seqs[a:b], object), -score))[: s.top_n]
            bins, counts = np.unique(np.floor(np.maximum(score, 0) / s.score_step).astype(np.int64), return_counts=True)
            top = [{"seq": own.seqs[a + i], "xcorr": float(score[i]), "ions_matched": int(matched[i]), "ions_total": int(total[i])} for i in best.tolist()]
            rows.append({"sample": r["sample"], "scan": r["scan"], "top": top, "bins": bins.tolist(), "counts": counts.tolist()})
        peptide = pa.struct([("seq", pa.string()), ("xcorr", pa.float64()), ("ions_matched", pa.int64()), ("ions_total", pa.int64())])
        kinds = [("sample", pa.string()), ("scan", pa.int64()), ("top", pa.list_(peptide)), ("bins", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
        return pa.Table.from_pylist(rows, pa.schema(kinds))

    return run


def _parts(rows: DataFrame, count: DataFrame, column: str, part: str, key: str) -> DataFrame:
    """rows with the part of their block, of as many as ``count`` (block, column) has."""
    return rows.join(count.select("block", column), "block").withColumn(part, F.pmod(F.xxhash64(key), F.col(column)).cast("int"))


def xcorr_search(spectra: DataFrame, peaks: DataFrame, peptides: DataFrame, settings: ScorerSettings | None = None, width: float | None = None, block_peptides: int = BLOCK_PEPTIDES, block_spectra: int = BLOCK_SPECTRA) -> DataFrame:
    """sample, scan, seq, xcorr, ions_matched, ions_total, num, delta_cn, eval: the top_n peptides of every spectrum.

    Peptides (seq) that repeat count once, those with unknown residues never. eval: the number of candidates expected to
    score as much, by a line through the logarithms of how many reach each score of the upper half, the best bin left out;
    null where the tail has too few bins or does not fall. delta_cn: the relative distance to the next of the top_n.
    width: of a block in Da; spectra and peptides of a block are split by block_spectra and block_peptides.
    """
    s = settings or ScorerSettings()
    width = width or max(1.0, s.precursor_ppm * 4e-3)  # a tolerance at 2000 Da touches two blocks or so
    n, m, z = F.length("seq"), F.col("precursor_mz"), F.col("precursor_charge")
    pool = peptides.select("seq").where((n >= s.least_length) & (n <= s.most_length)).distinct()
    pool = pool.withColumn("m", aa_mass(F.col("seq"))).where("m is not null").select("seq", F.floor(F.col("m") / width).alias("block"))
    lists = peaks.where("mz is not null and intensity is not null").groupBy(*SPECTRUM).agg(F.collect_list(F.struct("mz", "intensity")).alias("peaks"))
    asked = spectra.where(z.between(1, s.most_charge)).select(*SPECTRUM, z.cast("int").alias("charge"), (m - m * s.precursor_ppm / 1e6).alias("lo"), (m + m * s.precursor_ppm / 1e6).alias("hi"))
    mass = lambda c: F.floor((F.col("charge") * (F.col(c) - PROTON_MASS) - WATER_MASS) / width)
    touched = F.transform(counted((mass("lo") - 1).cast("int"), (mass("hi") + 1).cast("int")), lambda b: b.cast("long"))
    asked = asked.join(lists, SPECTRUM).withColumn("block", F.explode(touched))
    # how many parts a block has: a row a block, of which there are no more than the heaviest peptide's mass allows
    crowd = pool.groupBy("block").agg(F.ceil(F.count("*") / block_peptides).cast("int").alias("parts"))
    crowd = crowd.join(asked.groupBy("block").agg(F.ceil(F.count("*") / block_spectra).cast("int").alias("shares")), "block")
    left = _parts(asked, crowd, "shares", "share", "scan").join(crowd.select("block", "parts"), "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = _parts(pool, crowd, "parts", "part", "seq").join(crowd.select("block", "shares"), "block").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    left = left.select("block", "part", "share", F.col("sample").cast("string").alias("sample"), F.col("scan").cast("long").alias("scan"), "charge", "lo", "hi", "peaks")
    key = ["block", "part", "share"]
    found = left.groupBy(*key).cogroup(right.select(*key, "seq").groupBy(*key)).applyInArrow(_scored(s), _FOUND)
    return _ranked(found, s)


def _ranked(found: DataFrame, s: ScorerSettings) -> DataFrame:
    """Parts of spectra (top, bins, counts) to the best peptides with e-values."""
    # one exchange by spectrum serves the best ones and the histograms
    one = found.groupBy(*SPECTRUM).agg(F.flatten(F.collect_list("top")).alias("top"), F.flatten(F.collect_list(F.arrays_zip("bins", "counts"))).alias("hist"))
    order = lambda a, b: F.when((a["xcorr"] > b["xcorr"]) | ((a["xcorr"] == b["xcorr"]) & (a["seq"] < b["seq"])), -1).when(a["seq"] == b["seq"], 0).otherwise(1)
    best = one.select(*SPECTRUM, F.slice(F.array_sort("top", order), 1, s.top_n).alias("top"))
    best = best.select(*SPECTRUM, F.posexplode("top").alias("i", "p")).select(*SPECTRUM, "p.*", (F.col("i") + 1).alias("num"))
    hist = one.select(*SPECTRUM, F.explode("hist").alias("h")).groupBy(*SPECTRUM, F.col("h.bins").alias("bin")).agg(F.sum("h.counts").alias("n"))
    own = W.partitionBy(*SPECTRUM)
    above = own.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
    hist = hist.select(*SPECTRUM, "bin", F.sum("n").over(above).alias("reach"), F.sum("n").over(own).alias("all"), F.max("bin").over(own).alias("last"))
    x, y = F.col("bin") * s.score_step, F.log10("reach")
    tail = hist.where("2 * reach <= all and bin < last").groupBy(*SPECTRUM).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("at0"), F.count("*").alias("n"))
    tail = tail.where((F.col("n") >= s.least_tail) & (F.col("slope") < 0)).select(*SPECTRUM, "slope", "at0")
    following = F.lead("xcorr").over(own.orderBy("num"))
    delta = F.when(F.col("xcorr") > 0, (F.col("xcorr") - following) / F.col("xcorr"))
    return best.withColumn("delta_cn", delta).join(tail, SPECTRUM, "left").withColumn("eval", F.pow(F.lit(10.0), F.col("at0") + F.col("slope") * F.col("xcorr"))).drop("slope", "at0")


def search_with_decoys(spectra: DataFrame, peaks: DataFrame, peptides: DataFrame, settings: ScorerSettings | None = None) -> DataFrame:
    """xcorr_search against peptides and their decoys together, with is_decoy; a decoy that is a peptide is none. What
    tdc_q_value takes, with xcorr as score."""
    own = peptides.select("seq").distinct()
    false = own.select(decoy(F.col("seq")).alias("seq")).distinct().join(own, "seq", "left_anti")
    found = xcorr_search(spectra, peaks, own.unionByName(false), settings)
    return found.join(false.withColumn("is_decoy", F.lit(True)), "seq", "left").withColumn("is_decoy", F.coalesce("is_decoy", F.lit(False))).withColumn("score", F.col("xcorr"))


def search_missing(spectra: DataFrame, peaks: DataFrame, peptides: DataFrame, folder: str, settings: ScorerSettings | None = None) -> list[str]:
    """Searches the samples that ``folder`` has no results of, target and decoy, and adds theirs as Parquet by sample;
    samples without spectra have none. Returns the samples searched, a list as long as the samples."""
    spark = spectra.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    todo = sorted(r[0] for r in spectra.select(F.col("sample").cast("string")).distinct().collect())
    done = {p.getPath().getName().partition("=")[2] for p in system.listStatus(path)} if system.exists(path) else set()
    todo = [t for t in todo if t not in done]
    if todo:
        own = F.col("sample").isin(todo)
        found = search_with_decoys(spectra.where(own), peaks.where(own), peptides, settings)
        found.write.mode("append").partitionBy("sample").parquet(folder)
    return todo
