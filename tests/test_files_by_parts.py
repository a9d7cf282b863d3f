"""A sample's files are written by several tasks and read as one sample."""

import pytest
from pyspark.sql import functions as F

from peptura.sources import mzml


def _spectra(spark, n, sample="s"):
    peaks = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct((3 - i).cast("int").alias("id"), (F.col("id") + i / 8).cast("double").alias("mz"), (i + 1).cast("double").alias("intensity")))
    return spark.range(n).select(F.lit(sample).alias("sample"), F.col("id").alias("scan"), F.lit(400.25).alias("precursor_mz"), F.lit(2).alias("precursor_charge"), peaks.alias("peaks"))


def _read(df):
    return sorted((r["sample"], r["scan"], r["precursor_mz"], r["precursor_charge"], tuple(tuple(p) for p in r["peaks"])) for r in df.collect())


def test_a_sample_is_written_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mzml, "SCANS", 100)
    at = f"file://{tmp_path}/out"
    written = mzml.write_mzml(_spectra(spark, 450), at).collect()
    assert sorted(r["n"] for r in written) == [50, 100, 100, 100, 100]  # one file of 450 before
    assert sorted(r["file"].rpartition("/")[2] for r in written) == ["s.mzML", *[f"s.part-{i:06d}.mzML" for i in range(1, 5)]]
    want = [("s", i, 400.25, 2, tuple((k, i + (3 - k) / 8, 4.0 - k) for k in range(4))) for i in range(450)]
    assert [(s, i, m, z, tuple((k, *v) for k, (_, *v) in enumerate(p))) for s, i, m, z, p in _read(mzml.load_samples(spark, at, ["s"]))] == want
    assert _read(mzml.scan_mzml(spark, at, range_bytes=300)) == _read(mzml.load_samples(spark, at, ["s"]))
    assert [r[1] for r in _read(mzml.scan_mzml(spark, at, scans=[7, 123, 449, 900]))] == [7, 123, 449]
    # another sample whose name goes on is not the same sample, and what a larger call has left is gone
    mzml.write_mzml(_spectra(spark, 3, "s2").union(_spectra(spark, 250)), at).collect()
    assert [r[1] for r in _read(mzml.load_samples(spark, at, ["s"]))] == list(range(250))
    assert mzml.scan_mzml(spark, at).count() == 253
    with pytest.raises(Exception, match="FileNotFound|s3"):
        mzml.load_samples(spark, at, ["s3"]).collect()
    monkeypatch.setattr(mzml, "_opened_here", lambda path: False)
    with pytest.raises(Exception, match="no such parameter group"):  # read as text: the parts are found
        mzml.load_samples(spark, at, ["s"]).collect()


def test_scans_far_from_zero_and_none(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mzml, "SCANS", 10)
    rows = [("s", s, 1.0, 1, [(1, 2.0, 3.0)]) for s in (-25, -15, -4, 4, 15, 25, None)] + [("t", 31, 1.0, 1, None)]
    df = spark.createDataFrame(rows, "sample string, scan long, precursor_mz double, precursor_charge int, peaks array<struct<id:int,mz:double,intensity:double>>")
    assert sum(r["n"] for r in mzml.write_mzml(df, str(tmp_path / "o")).collect()) == 8
    got = mzml.load_samples(spark, str(tmp_path / "o"), ["s", "t"]).collect()
    # an id with a sign is read as no number
    assert len(got) == 8 and sorted((r["sample"], r["scan"]) for r in got if r["scan"] is not None) == [("s", 4), ("s", 15), ("s", 25), ("t", 31)]


def test_long_arrays_are_compressed(spark, tmp_path):
    peaks = [(i, 100.0, 1.0) for i in range(500)]
    df = spark.createDataFrame([("s", 1, 1.0, 1, peaks)], "sample string, scan long, precursor_mz double, precursor_charge int, peaks array<struct<id:int,mz:double,intensity:double>>")
    mzml.write_mzml(df, str(tmp_path / "o")).collect()
    assert (tmp_path / "o/s.mzML").stat().st_size < 3000
    assert [tuple(p) for p in mzml.scan_mzml(spark, str(tmp_path / "o")).first()["peaks"]] == [(i, 100.0, 1.0) for i in range(500)]
