"""Peaks, and peptides against spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as C
from ..operators import spectra as S
from . import adapters as A
from . import query

_IONS = f"""ions AS MATERIALIZED (SELECT pid, sample, scan, ion_seq, ion_type, z AS charge, CASE ion_type WHEN 'b' THEN ({A.sql_mass('ion_seq')} + z * {A.P}) / z ELSE ({A.sql_mass('ion_seq')} + {A.WATER} + z * {A.P}) / z END AS mz FROM (
  SELECT pid, sample, scan, 'b' AS ion_type, left(left_seq || right_seq, n) AS ion_seq FROM planted, range(1, 13) r(n) WHERE n <= length(left_seq || right_seq)
  UNION ALL SELECT pid, sample, scan, 'y', right(left_seq || right_seq, n) FROM planted, range(1, 13) r(n) WHERE n <= length(left_seq || right_seq)), range(1, 3) c(z))"""
_MET = """met AS MATERIALIZED (SELECT i.pid, i.sample, i.scan, ion_seq, ion_type, charge, list(peak_id ORDER BY peak_id) FILTER (WHERE peak_id IS NOT NULL) AS ids, coalesce(sum(intensity), 0) AS intensity
  FROM ions i LEFT JOIN peaks_theo p ON p.sample = i.sample AND p.scan = i.scan AND p.mz BETWEEN i.mz - i.mz * 20 / 1e6 AND i.mz + i.mz * 20 / 1e6 GROUP BY ALL)"""


@query(f"WITH {A.PEAKS} SELECT sample, scan, peak_id, mz, intensity FROM (SELECT *, row_number() OVER (PARTITION BY sample, scan ORDER BY intensity DESC, peak_id) AS r FROM peaks) WHERE r <= 3")
def top_n_peaks(t):
    return S.top_n_peaks(t.peaks, 3)


@query(f"WITH {A.PEAKS} SELECT sample, scan, peak_id, intensity FROM (SELECT *, sum(intensity) OVER (PARTITION BY sample, scan) AS t FROM peaks) WHERE intensity >= 0.3 * t")
def relative_abundance(t):
    return S.relative_abundance(t.peaks, 0.3).select("sample", "scan", "peak_id", "intensity")


@query(f"WITH {A.PEAKS} SELECT sample, scan, sum(intensity) AS total_intensity, count(*) AS n_peaks FROM peaks GROUP BY sample, scan")
def total_intensity(t):
    return S.total_intensity(t.peaks)


@query(f"WITH {A.PEAKS} SELECT sample, scan, peak_id, mz FROM peaks WHERE abs(mz - 750.0) / mz * 1e6 <= 5000")
def peaks_near_mz(t):
    return S.peaks_near_mz(t.peaks, 750.0, 5000).select("sample", "scan", "peak_id", "mz")


@query(f"WITH {A.PEAKS} SELECT DISTINCT sample, scan, CAST(floor(mz / 5.0) AS BIGINT) AS bin, 50 AS value FROM peaks")
def sparse_bins(t):
    return S.sparse_bins(t.peaks, 5.0)


@query(f"WITH {A.PEAKS} SELECT CAST(least(floor((mz - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM peaks, (SELECT min(mz) AS lo, max(mz) AS hi FROM peaks) GROUP BY 1")
def histogram(t):
    return S.histogram(t.peaks, "mz", 20)


@query(f"WITH {A.PEAKS} SELECT round(regr_slope(intensity, mz), 9) AS slope, round(regr_intercept(intensity, mz), 6) AS intercept FROM peaks")
def best_fit_line(t):
    df = S.best_fit_line(t.peaks, "mz", "intensity")
    return df.select(F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query(f"WITH {A.SPECTRA}, {A.PEAKS} SELECT sample, count(DISTINCT scan) AS n_scans, count(*) AS n_peaks FROM spectra JOIN peaks USING (sample, scan) GROUP BY sample")
def load_samples(t):
    from ..sources import mzml

    at = t.folder("mzml")
    mzml.write_mzml(t.peak_lists, at).collect()  # a row for each file
    found = mzml.load_samples(t.spark, at, [f"s{i}" for i in range(4)])
    return found.groupBy("sample").agg(F.count_distinct("scan").alias("n_scans"), F.sum(F.size("peaks")).alias("n_peaks"))


@query(f"""WITH {A.SPECTRA}, {A.PEAKS} SELECT sample, scan, precursor_mz, precursor_charge, string_agg(round(mz, 6) || ':' || CAST(intensity AS BIGINT), ',' ORDER BY peak_id) AS peaks
FROM spectra JOIN peaks USING (sample, scan) GROUP BY ALL""")
def scan_mzml(t):
    from ..sources import mzml

    at = t.folder("mzml-all")
    mzml.write_mzml(t.peak_lists, at).collect()
    peak = F.transform("peaks", lambda p: F.concat(F.round(p["mz"], 6).cast("string"), F.lit(":"), p["intensity"].cast("long").cast("string")))
    found = mzml.scan_mzml(t.spark, at, range_bytes=1 << 20)
    return found.select("sample", "scan", "precursor_mz", "precursor_charge", F.array_join(peak, ",").alias("peaks"))


@query(f"WITH {A.SPECTRA}, {A.PEAKS}, asked AS (SELECT min(scan) AS scan FROM spectra JOIN peaks USING (sample, scan)) SELECT sample, scan, count(*) AS n_peaks FROM spectra JOIN peaks USING (sample, scan) WHERE scan IN (SELECT scan FROM asked) GROUP BY sample, scan")
def unique_scan_lookup(t):
    from ..sources import mzml

    at = t.folder("mzml-lookup")
    mzml.write_mzml(t.peak_lists, at).collect()
    first = t.peak_lists.agg(F.min("scan")).first()[0]
    return mzml.scan_mzml(t.spark, at, scans=[-1 if first is None else first]).select("sample", "scan", F.size("peaks").cast("long").alias("n_peaks"))


@query(f"WITH {A.THEO}, {_IONS}, {_MET} SELECT pid, ion_seq, ion_type, charge, coalesce(array_to_string(ids, ','), '') AS peak_ids, intensity FROM met")
def peaks_vs_product_ions(t):
    df = C.peaks_vs_product_ions(t.peptides, t.peaks_theo)
    return df.select("pid", "ion_seq", "ion_type", F.col("charge").cast("long").alias("charge"), F.array_join(F.col("peak_ids").cast("array<string>"), ",").alias("peak_ids"), "intensity")


@query(f"""WITH {A.THEO}, {_IONS}, {_MET} SELECT pid, ion_type, ion_seq, CAST(sum(coalesce(len(ids), 0)) AS BIGINT) AS n_peaks,
  array_to_string(list_sort(flatten(list(coalesce(ids, [])))), ',') AS peak_ids FROM met GROUP BY ALL""")
def matches_by_seq_and_type(t):
    found = C.matches_by_seq_and_type(C.peaks_vs_product_ions(t.peptides, t.peaks_theo))
    return found.withColumn("peak_ids", F.array_join(F.col("peak_ids").cast("array<string>"), ","))


@query(f"""WITH {A.THEO}, {_IONS}, {_MET}, j AS (
  SELECT met.*, left_seq, right_seq, list_contains(list_concat(list_transform(range(1, length(right_seq) + 1), lambda i: left_seq || left(right_seq, i)),
    list_transform(range(1, length(left_seq)), lambda i: substr(left_seq, i + 1) || right_seq)), ion_seq) AS span FROM met JOIN planted USING (pid)
), tot AS (SELECT sample, scan, sum(intensity) AS total FROM peaks_theo GROUP BY sample, scan),
d AS (SELECT pid, count(DISTINCT p) AS n FROM (SELECT pid, unnest(ids) AS p FROM met) GROUP BY pid)
SELECT j.pid, left_seq || right_seq AS seq, round(sum(intensity) / max(total), 6) AS share_by, round(coalesce(sum(intensity) FILTER (WHERE ion_type = 'b'), 0) / max(total), 6) AS share_b,
  round(coalesce(sum(intensity) FILTER (WHERE ion_type = 'y'), 0) / max(total), 6) AS share_y, round(coalesce(sum(intensity) FILTER (WHERE span), 0) / max(total), 6) AS share_hybrid,
  count(DISTINCT ion_seq) FILTER (WHERE ion_type = 'b' AND len(ids) > 0) AS n_b, count(DISTINCT ion_seq) FILTER (WHERE ion_type = 'y' AND len(ids) > 0) AS n_y,
  count(DISTINCT ion_seq) FILTER (WHERE span AND len(ids) > 0) AS n_hybrid, count(DISTINCT ion_type || ion_seq) FILTER (WHERE span) AS n_junction, coalesce(max(d.n), 0) AS n_peaks_distinct
FROM j JOIN tot ON tot.sample = j.sample AND tot.scan = j.scan LEFT JOIN d ON d.pid = j.pid GROUP BY ALL""")
def peptide_spectrum_report(t):
    df = C.peptide_spectrum_report(t.peptides, t.peaks_theo)
    shares = ["share_by", "share_b", "share_y", "share_hybrid"]
    return df.select("pid", "seq", *[F.round(c, 6).alias(c) for c in shares], "n_b", "n_y", "n_hybrid", "n_junction", "n_peaks_distinct")


@query(f"""WITH {A.SPECTRA}, {A.PSMS} SELECT s.scan, s.sample, psm_id FROM spectra s JOIN (
  SELECT 's' || (psm_id % 4) AS sample, scan, min(psm_id) AS psm_id FROM psms GROUP BY 1, 2) USING (sample, scan)""")
def spectra_to_psms(t):
    psms = t.psms.withColumn("sample", F.concat(F.lit("s"), (F.col("psm_id") % 4).cast("string")))
    return C.spectra_to_psms(t.spectra, psms).select("scan", "sample", "psm_id")


@query(f"""WITH {A.PEAKS} SELECT sample, scan, peak_id, CAST(row_number() OVER (PARTITION BY sample, scan ORDER BY mz, peak_id) AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY sample, scan ORDER BY intensity DESC, peak_id) AS r FROM peaks) WHERE r <= 3""")
def legacy_top_n_peaks(t):
    return S.legacy_top_n_peaks(t.peaks, 3).select("sample", "scan", "peak_id", "place")


@query(f"""WITH {A.PEAKS}, b AS (SELECT DISTINCT sample, scan, CAST(floor(mz / 50.0) AS BIGINT) AS bin FROM peaks), m AS (SELECT sample, scan, list(bin) AS bins, max(bin) AS last FROM b GROUP BY ALL)
SELECT sample, scan, array_to_string(list_transform(range(0, last + 1), lambda i: CASE WHEN list_contains(bins, i) THEN 50 ELSE 0 END), ',') AS values FROM m""")
def dense_bins(t):
    return S.dense_bins(S.sparse_bins(t.peaks, 50.0)).select("sample", "scan", F.array_join(F.col("values").cast("array<string>"), ",").alias("values"))


@query(f"""WITH {A.THEO} SELECT pid, round(abs(m - precursor_mz) / m * 1e6, 6) AS ppm_diff FROM (
  SELECT pid, precursor_mz + 0.001 AS precursor_mz, ({A.sql_mass('left_seq || right_seq')} + {A.WATER} + precursor_charge * {A.P}) / precursor_charge AS m FROM planted JOIN spectra_theo USING (sample, scan))""")
def precursor_ppm_diff(t):
    df = C.precursor_ppm_diff(t.peptides, t.spectra_theo.withColumn("precursor_mz", F.col("precursor_mz") + 0.001))
    return df.select("pid", F.round("ppm_diff", 6).alias("ppm_diff"))


@query(f"""WITH {A.THEO}, {_IONS}, {_MET} SELECT pid AS psm_id, pid * 0.5 AS score, count(DISTINCT ion_seq) FILTER (WHERE ion_type = 'b' AND len(ids) > 0) AS n_b,
  count(DISTINCT ion_seq) FILTER (WHERE ion_type = 'y' AND len(ids) > 0) AS n_y FROM met GROUP BY pid""")
def psm_spectrum_report(t):
    name = F.when(F.col("pid") % 2 == 0, F.concat(F.lit("hybrid_"), "left_seq", F.lit("-"), "right_seq")).otherwise(F.lit("part|1"))
    psms = t.peptides.select(F.col("pid").alias("psm_id"), "sample", "scan", "seq", F.array(name).alias("proteins"), (F.col("pid") * 0.5).alias("score"))
    return C.psm_spectrum_report(psms, t.peaks_theo).select("psm_id", "score", "n_b", "n_y")


@query(f"""WITH {A.THEO}, pep AS (SELECT DISTINCT left_seq || right_seq AS seq FROM planted), mass AS (SELECT seq, {A.sql_mass('seq')} AS m FROM pep),
cand AS (SELECT sample, scan, precursor_charge AS charge, seq FROM spectra_theo JOIN mass ON (m + {A.WATER} + precursor_charge * {A.P}) / precursor_charge
  BETWEEN precursor_mz - precursor_mz * 20.0 / 1e6 AND precursor_mz + precursor_mz * 20.0 / 1e6 WHERE precursor_charge <= 3 AND length(seq) BETWEEN 5 AND 50),
ion AS (SELECT seq, 'b' AS t, left(seq, n) AS s, z FROM pep, range(1, 51) r(n), range(1, 3) c(z) WHERE n <= length(seq) UNION ALL
  SELECT seq, 'y', right(seq, n), z FROM pep, range(1, 51) r(n), range(1, 3) c(z) WHERE n <= length(seq)),
ions AS (SELECT seq, t, s, z, CAST(floor(CASE t WHEN 'b' THEN ({A.sql_mass('s')} + z * {A.P}) / z ELSE ({A.sql_mass('s')} + {A.WATER} + z * {A.P}) / z END / 0.02) AS BIGINT) AS bin FROM ion),
bins AS (SELECT DISTINCT sample, scan, CAST(floor(mz / 0.02) AS BIGINT) + d AS bin FROM peaks_theo, range(-1, 2) x(d)),
scored AS (SELECT c.sample, c.scan, c.seq, count(b.bin) AS ions_matched, count(*) AS ions_total FROM cand c JOIN ions i ON i.seq = c.seq AND (z = 1 OR charge > 2)
  LEFT JOIN bins b ON b.sample = c.sample AND b.scan = c.scan AND b.bin = i.bin GROUP BY ALL)
SELECT sample, scan, seq, ions_matched, ions_total, num FROM (SELECT *, row_number() OVER (PARTITION BY sample, scan ORDER BY ions_matched / ions_total::DOUBLE DESC, seq) AS num FROM scored) WHERE num <= 5""")
def search_spectra(t):
    from ..operators.scorer import search_spectra as search

    df = search(t.spectra_theo, t.peaks_theo, t.peptides)
    return df.select("sample", "scan", "seq", "ions_matched", "ions_total", F.col("num").cast("long").alias("num"))


_STEP, _W = 0.05, "(CASE WHEN d = 0 THEN 1.0 WHEN abs(d) = 1 THEN 0.5 ELSE 0.0 END)"
_BACK = "(CASE WHEN abs(d) <= 75 THEN 1.0 ELSE 0.0 END + CASE WHEN abs(d - 1) <= 75 THEN 0.5 ELSE 0.0 END + CASE WHEN abs(d + 1) <= 75 THEN 0.5 ELSE 0.0 END)"


@query(f"""WITH {A.THEO}, pep AS (SELECT DISTINCT left_seq || right_seq AS seq FROM planted), mass AS (SELECT seq, {A.sql_mass('seq')} AS m FROM pep WHERE length(seq) BETWEEN 5 AND 50),
cand AS MATERIALIZED (SELECT sample, scan, seq FROM spectra_theo JOIN mass ON (m + {A.WATER} + precursor_charge * {A.P}) / precursor_charge
  BETWEEN precursor_mz - precursor_mz * 100000.0 / 1e6 AND precursor_mz + precursor_mz * 100000.0 / 1e6),
ion AS (SELECT seq, {A.sql_mass('left(seq, n)')} AS m FROM pep, range(1, 50) r(n) WHERE n < length(seq) UNION ALL SELECT seq, {A.sql_mass('right(seq, n)')} + {A.WATER} FROM pep, range(1, 50) r(n) WHERE n < length(seq)),
ions AS MATERIALIZED (SELECT DISTINCT seq, CAST(floor((m + 1 * {A.P}) / 1 / 0.02) AS BIGINT) AS bin FROM ion),
y0 AS (SELECT sample, scan, CAST(floor(mz / 0.02) AS BIGINT) AS bin, max(sqrt(intensity)) AS v FROM peaks_theo GROUP BY ALL),
y1 AS (SELECT *, max(v) OVER (PARTITION BY sample, scan) AS top, max(bin) OVER (PARTITION BY sample, scan) // 10 + 1 AS size FROM y0),
y AS MATERIALIZED (SELECT sample, scan, bin, v * 50 / max(v) OVER (PARTITION BY sample, scan, bin // size) AS v FROM y1 WHERE v > 0.05 * top),
near AS (SELECT c.sample, c.scan, c.seq, i.bin, y.v, y.bin - i.bin AS d FROM cand c JOIN ions i USING (seq) LEFT JOIN y ON y.sample = c.sample AND y.scan = c.scan AND y.bin BETWEEN i.bin - 76 AND i.bin + 76),
scored AS MATERIALIZED (SELECT sample, scan, seq, round(0.005 * coalesce(sum(v * ({_W} * (1 + 1 / 150.0::DOUBLE) - {_BACK} / 150.0::DOUBLE)), 0), 9) AS xcorr,
  count(DISTINCT bin) FILTER (WHERE abs(d) <= 1) AS ions_matched, count(DISTINCT bin) AS ions_total FROM near GROUP BY sample, scan, seq),
hist AS (SELECT sample, scan, CAST(floor(greatest(xcorr, 0) / {_STEP}) AS BIGINT) AS bin, count(*) AS n FROM scored GROUP BY ALL),
reach AS (SELECT sample, scan, bin, sum(n) OVER (PARTITION BY sample, scan ORDER BY bin DESC) AS r, sum(n) OVER (PARTITION BY sample, scan) AS total, max(bin) OVER (PARTITION BY sample, scan) AS last FROM hist),
tail AS (SELECT sample, scan, regr_slope(log10(r), bin * {_STEP}) AS slope, regr_intercept(log10(r), bin * {_STEP}) AS at0 FROM reach WHERE 2 * r <= total AND bin < last GROUP BY ALL HAVING count(*) >= 3),
best AS (SELECT *, row_number() OVER (PARTITION BY sample, scan ORDER BY xcorr DESC, seq) AS num FROM scored)
SELECT sample, scan, seq, round(xcorr, 6) AS xcorr, ions_matched, ions_total, num, round(CASE WHEN slope < 0 THEN at0 + slope * xcorr END, 5) AS log_eval FROM best LEFT JOIN tail USING (sample, scan) WHERE num <= 5""")
def xcorr_search(t):
    from ..operators.xcorr import xcorr_search as search
    from ..plans.settings import ScorerSettings

    df = search(t.spectra_theo, t.peaks_theo, t.peptides, ScorerSettings(precursor_ppm=100_000.0, score_step=_STEP))
    return df.select("sample", "scan", "seq", F.round("xcorr", 6).alias("xcorr"), "ions_matched", "ions_total", F.col("num").cast("long").alias("num"), F.round(F.log10("eval"), 5).alias("log_eval"))


@query(f"""WITH {A.PEAKS}, lim AS (SELECT min(mz) AS lo, max(mz) AS hi, CAST(count(mz) AS DOUBLE) AS n, stddev_samp(mz) AS sd, (max(mz) - min(mz)) / 1024 AS w FROM peaks),
c AS (SELECT least(floor((mz - lo) / w), 1023) AS bin, count(*) AS c FROM peaks, lim GROUP BY 1),
h AS (SELECT *, pow(n, -0.2::DOUBLE) * sd * 2.0::DOUBLE AS h FROM lim), x AS (SELECT lo + (hi - lo) * i / 199 AS x, h.* FROM h, range(200) r(i))
SELECT round(x, 6) AS x, round(sum(c * exp(-0.5::DOUBLE * ((x - (lo + (bin + 0.5::DOUBLE) * w)) / h) * ((x - (lo + (bin + 0.5::DOUBLE) * w)) / h))) / (max(n) * max(h) * sqrt(2 * pi())), 9) AS density FROM x, c GROUP BY x""")
def density(t):
    return S.density(t.peaks, "mz").select(F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))
