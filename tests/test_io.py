"""Tables on disk, dataclass tables, and the stream of spectra."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from peptura.functions.masses import PROTON_MASS, RESIDUES
from peptura.operators import kmers
from peptura.operators.ions import peak_ion_match
from peptura.plans.search import SearchConfig
from peptura.sources import tables
from peptura.streaming.matches import stream_peak_ion_match


@dataclasses.dataclass
class Row:
    name: str
    mass: float
    n: int
    _note: str = ""


@dataclasses.dataclass
class Bad:
    xs: list


def test_dataclass_tables(spark):
    tables.insert_dataclasses(spark, [], "peptura_rows")
    tables.insert_dataclasses(spark, [Row("a", 1.5, 2), Row("b", 2.5, 3)], "peptura_rows")
    tables.insert_dataclasses(spark, [Row("c", 0.5, 4)], "peptura_rows")
    assert tables.table_info(spark, "peptura_rows") == [("name", "string"), ("mass", "double"), ("n", "bigint")]
    assert spark.table("peptura_rows").count() == tables.row_count(spark, "peptura_rows") == tables.table_rows(spark, "peptura_rows").count() == 3
    assert [r[0] for r in tables.read_query(spark, "SELECT name FROM peptura_rows WHERE n = 4").collect()] == ["c"]
    spark.sql("DROP TABLE peptura_rows")
    with pytest.raises(TypeError):
        tables.schema_of(Bad)


def test_kmer_table_prunes_by_mass(spark, tmp_path):
    proteins = spark.createDataFrame([(0, "p", "ACDEFGHIKL"), (1, "q", "ACDW")], "prot_id int, name string, seq string")
    table = kmers.kmer_table(proteins, 4, 2)
    kmers.write_kmer_table(table, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == table.count()
    near = back.where("mass_bin = 174").select("kmer")
    assert {r[0] for r in near.collect()} == {r["kmer"] for r in table.collect() if int(r["aa_mass"]) == 174}
    assert "PartitionFilters: [isnotnull(mass_bin" in near._jdf.queryExecution().executedPlan().toString()


def test_stream_matches_batch(spark, tmp_path):
    proteins = spark.createDataFrame([(0, "p", "ACDEFG")], "prot_id int, name string, seq string")
    table = kmers.kmer_table(proteins, 3, 2).select("kmer", "aa_mass")
    spectra = spark.createDataFrame([("s", 1, 500.0, 2), ("s", 2, 90.0, 1)], "sample string, scan long, precursor_mz double, precursor_charge int")
    ac = RESIDUES["A"] + RESIDUES["C"] + PROTON_MASS
    peaks = spark.createDataFrame([("s", 1, 0, ac), ("s", 2, 0, ac), ("s", 1, 1, 77.7), ("t", 1, 0, ac)], "sample string, scan long, peak_id long, mz double")
    peaks.write.parquet(str(tmp_path / "peaks"))
    stream = stream_peak_ion_match(spark.readStream.schema(peaks.schema).parquet(str(tmp_path / "peaks")), spectra, table)
    q = stream.writeStream.format("memory").queryName("met").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("met").select("scan", "peak_id", "kmer", "charge", "sample").collect()))
    want = sorted(map(tuple, peak_ion_match(peaks, spectra, table).select("scan", "peak_id", "kmer", "charge", "sample").collect()))
    assert got == want and ("AC" in {g[2] for g in got})
    assert all(g[0] == 1 and g[4] == "s" for g in got)  # scan 2's precursor is too light, sample t has no spectra


def test_contained_and_missing(spark):
    proteins = spark.createDataFrame([(0, "p", "ACDEF")], "prot_id int, name string, seq string")
    q = spark.createDataFrame([("CDE",), ("XX",)], "query string")
    assert [r[0] for r in kmers.contains_seq(proteins, q).collect()] == ["CDE"]
    scans = spark.createDataFrame([("s", 7)], "sample string, scan long")
    want = tables.expected_outputs(scans)
    done = want.where("kind = 'decoy'").select("file")
    assert [r["file"] for r in tables.missing_outputs(want.select("file"), done).collect()] == ["s.comet.7-7.target.txt"]
    assert want.select(F.count_distinct("file")).first()[0] == 2


def test_result_folders_and_settings(spark, tmp_path):
    head = "scan\txcorr score\txcorr rank\tsequence\tprotein id\ttdc q-value"
    for name, rows in {"a.comet.target.txt": ["7\t2.5\t1\tACD\tp\t0.1", "7\t1.5\t2\tACE\tp\t0.1"], "b.comet.target.txt": ["9\t3.5\t1\tAC\tq\t0.2"], "assign-confidence.target.txt": ["7\t2.5\t1\tACD\tp\t0.005", "9\t2.5\t1\tACD\tp\t0.5"]}.items():
        (tmp_path / name).write_text("\n".join([head, *rows]) + "\n")
    assert sorted((r["sample"], r["scan"], r["num"]) for r in tables.load_comet_psms(spark, str(tmp_path), top_n=1).collect()) == [("a", 7, 1), ("b", 9, 1)]
    assert [r["scan"] for r in tables.load_comet_psms(spark, str(tmp_path), most_q=0.01).collect()] == [7]
    with pytest.raises(ValueError):
        tables.load_comet_psms(spark, str(tmp_path))
    one = tables.get_scan_results(spark, str(tmp_path / "a.comet.target.txt"), str(tmp_path / "b.comet.target.txt"), "s", 9)
    assert [df.count() for df in one] == [0, 1]
    (tmp_path / "c.comet.3-3.target.txt").write_text("")
    (tmp_path / "c.comet.4-4.target.txt").write_text(head + "\n4\t1\t1\tAA\tp\t0\n")
    (tmp_path / "c.comet.4-4.decoy.txt").write_text(head + "\n4\t1\t1\tAD\tp\t0\n")
    target, decoy = tables.union_scan_results(spark, str(tmp_path))
    assert ([r["seq"] for r in target.collect()], [r["seq"] for r in decoy.collect()]) == (["AA"], ["AD"])
    (tmp_path / "n.txt").write_text("CometVersion 2023\tx\nscan\tnum\n5\t1\n")
    assert tables.header_lines(spark, str(tmp_path / "n.txt")) == ("scan\tnum", "5\t1") and tables.header_lines(spark, str(tmp_path / "a.comet.target.txt")) is None
    (tmp_path / "c.yaml").write_text("a: {b: {key: 3}}\nkey2: x\n")
    settings = tables.read_yaml(spark, str(tmp_path / "c.yaml"))
    assert (tables.find_setting(settings, "key"), tables.find_setting(settings, "none", 1)) == (3, 1)
    (tmp_path / "s.json").write_text('{\n "a": 1,\n "b": [2]\n}')
    assert [tuple(r) for r in tables.read_json(spark, str(tmp_path / "s.json")).collect()] == [(1, [2])]
    tables.write_yaml(spark, {"search": {"max_k": 9, "scans": [3, 4]}, "other": 1}, str(tmp_path / "y"))
    config = SearchConfig.from_settings(tables.read_yaml(spark, str(tmp_path / "y")))
    assert (config.max_k, config.scans, config.min_k) == (9, (3, 4), 1)
    with pytest.raises(ValueError):
        tables.save_kmer_map(spark.range(1), str(tmp_path / "k.pickle"))
    (tmp_path / "x.7.log").write_text("s\tm\n1.5\t2\n")
    r = tables.benchmark_scan(spark, str(tmp_path / "x.7.log")).collect()[0]
    assert (r["mzml"], r["scan"], r["s"]) == ("x", 7, "1.5")
    import hashlib

    assert tables.file_hash(spark, str(tmp_path / "c.yaml")).collect()[0]["sha256"] == hashlib.sha256((tmp_path / "c.yaml").read_bytes()).hexdigest()


def test_spectra_by_name_or_fraction(spark):
    from peptura.sources import mzml

    df = spark.createDataFrame([("BMEM_AspN_Fxn4", 7, "b"), ("BMEM_AspN_Fxn4", 7, "a"), ("x", 7, "c")], "sample string, scan long, spectrum_id string")
    assert [mzml.spectrum_by_sample_scan(df, s, 7).collect()[0]["spectrum_id"] for s in (4, "x")] == ["a", "c"]
    assert mzml.spectrum_by_sample_scan(df, 5, 7).count() == 0 and mzml.mzml_scans(df).count() == 2
    got = spark.range(1).select(mzml.mzml_name(F.lit("d/a.b.mzML")), mzml.mzml_sample(F.lit("d/a.b.mzML"))).collect()[0]
    assert tuple(got) == ("a.b", "a.b")


def test_large_mzml_is_split(spark, tmp_path):
    """Spectra of one file read in many small ranges, with text before, between and after them."""
    from peptura.sources import mzml

    body = "".join(f'<spectrum index="{i}" id="scan={i}"><cvParam accession="MS:1000511" value="{1 + i % 2}"/></spectrum>\n' for i in range(400))
    (tmp_path / "big.x.mzML").write_text(f'<?xml version="1.0"?><mzML><run><spectrumList count="400">{body}</spectrumList><chromatogramList/></run></mzML>')
    (tmp_path / "none.mzML").write_text("<mzML/>")
    for size in (97, 1000, 1 << 20):
        df = mzml.scan_mzml(spark, str(tmp_path), ms2_only=False, range_bytes=size)
        assert df.rdd.getNumPartitions() > 5 or size > 1000
        assert sorted((r["sample"], r["scan"]) for r in df.collect()) == [("big", i) for i in range(400)]
    assert mzml.scan_mzml(spark, str(tmp_path)).count() == 200
    # without an index, scans are found by reading on
    assert [r["scan"] for r in mzml.scan_mzml(spark, str(tmp_path), scans=[7, 8, 900]).collect()] == [7]


def _cv(accession, value=""):
    return f'<cvParam accession="{accession}" value="{value}"/>'


def _array(kind, values, form="d", zipped=True, group=""):
    import base64
    import struct
    import zlib

    raw = struct.pack(f"<{len(values)}{form}", *values)
    own = {"d": "MS:1000523", "f": "MS:1000521", "q": "MS:1000522", "i": "MS:1000519"}[form]
    text = base64.b64encode(zlib.compress(raw) if zipped else raw).decode()
    params = group or _cv(own) + _cv("MS:1000574" if zipped else "MS:1000576")
    return f"<binaryDataArray>{params}{_cv(kind)}<binary>{text}</binary></binaryDataArray>"


GROUPS = (
    '<referenceableParamGroupList count="2"><referenceableParamGroup id="level">' + _cv("MS:1000511", 2) + '</referenceableParamGroup>'
    '<referenceableParamGroup id="\u00fc">' + _cv("MS:1000523") + _cv("MS:1000574") + "</referenceableParamGroup></referenceableParamGroupList>"
)


def _indexed(spectra, groups=GROUPS, encoding="iso-8859-1", shift=0):
    """An indexed file of (scan, element) whose index is off by some bytes."""
    text = f'<?xml version="1.0" encoding="{encoding}"?>\n<indexedmzML xmlns="http://psi.hupo.org/ms/mzml"><mzML>{groups}<run><spectrumList>\n'.encode(encoding)
    offsets = []
    for scan, element in spectra:
        offsets.append((scan, len(text) + shift))
        text += element.encode(encoding) + b"\n"
    text += b"</spectrumList></run></mzML>\n"
    index = "".join(f'<offset idRef="controllerType=0 scan={s}">{o}</offset>' for s, o in offsets)
    return text + f'<indexList count="1"><index name="spectrum">{index}</index></indexList><indexListOffset>{len(text)}</indexListOffset></indexedmzML>'.encode(encoding)


def _element(scan, form="d", zipped=True, grouped=False):
    group = '<referenceableParamGroupRef ref="\u00fc"/>' if grouped else ""
    arrays = _array("MS:1000514", [100 + scan, 200 + scan], form, zipped, group) + _array("MS:1000515", [1, 2], form, zipped, group)
    return f'<spectrum id="controllerType=0 scan={scan}"><referenceableParamGroupRef ref="level"/><binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>'


def test_mzml_parameter_groups_and_kinds(spark, tmp_path):
    from peptura.sources import mzml

    kinds = [("d", True, False), ("f", True, False), ("d", False, False), ("q", True, False), ("i", False, False), ("d", True, True)]
    (tmp_path / "g.mzML").write_bytes(_indexed([(i, _element(i, *k)) for i, k in enumerate(kinds)]))
    for size in (50, 300, 1 << 20):
        rows = sorted(mzml.scan_mzml(spark, str(tmp_path), range_bytes=size).collect(), key=lambda r: r["scan"])
        assert [(r["scan"], r["ms_level"], [tuple(p) for p in r["peaks"]]) for r in rows] == [(i, 2, [(0, 100.0 + i, 1.0), (1, 200.0 + i, 2.0)]) for i in range(len(kinds))]


@pytest.mark.parametrize("shift", [0, 3])
def test_mzml_scans_by_index(spark, tmp_path, shift):
    """A scan is read where the index says, and found all the same where the index is wrong."""
    from peptura.sources import mzml

    (tmp_path / "a.mzML").write_bytes(_indexed([(i, _element(i)) for i in range(60)], shift=shift))
    (tmp_path / "b.mzML").write_bytes(_indexed([(i, _element(i)) for i in range(50, 90)], shift=shift))
    got = mzml.scan_mzml(spark, str(tmp_path), scans=[3, 55, 999])
    assert got.rdd.getNumPartitions() == 2
    assert sorted((r["sample"], r["scan"]) for r in got.collect()) == [("a", 3), ("a", 55), ("b", 55)]
    assert mzml.spectrum_by_index(spark, str(tmp_path / "a.mzML"), 7).collect()[0]["peaks"][0]["mz"] == 107.0
    with pytest.raises(ValueError):
        mzml.spectrum_by_index(spark, str(tmp_path), 55)
    # a filter on scan is taken by the source where the session lets it
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = mzml.scan_mzml(spark, str(tmp_path), range_bytes=100).where("scan in (4, 70) and sample <> 'b'")
        assert df.rdd.getNumPartitions() == 2  # one a file, not one a range
        assert [(r["sample"], r["scan"]) for r in df.collect()] == [("a", 4)]
        assert mzml.scan_mzml(spark, str(tmp_path), scans=[4, 5]).where("scan = 5").count() == 1
        assert mzml.scan_mzml(spark, str(tmp_path)).where("scan > 85").count() == 4
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_mzml_errors(spark, tmp_path, monkeypatch):
    from peptura.sources import mzml

    (tmp_path / "x.mzML").write_bytes(_indexed([(1, _element(1))], groups=""))
    with pytest.raises(Exception, match="no such parameter group"):
        mzml.scan_mzml(spark, str(tmp_path)).collect()
    (tmp_path / "x.mzML").write_bytes(_indexed([(1, _element(1).replace("MS:1000574", "MS:1002312"))]))
    with pytest.raises(Exception, match="of a kind that is not read"):
        mzml.scan_mzml(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="FileNotFound|nothing"):
        mzml.scan_mzml(spark, str(tmp_path / "nothing")).collect()
    # paths that only Spark opens: as text, where groups cannot be known
    monkeypatch.setattr(mzml, "_opened_here", lambda path: False)
    (tmp_path / "x.mzML").write_bytes(_indexed([(1, _element(1).replace('<referenceableParamGroupRef ref="level"/>', _cv("MS:1000511", 2)))], encoding="utf-8"))
    assert [(r["scan"], len(r["peaks"])) for r in mzml.scan_mzml(spark, str(tmp_path)).collect()] == [(1, 2)]
    (tmp_path / "x.mzML").write_bytes(_indexed([(1, _element(1))], encoding="utf-8"))
    with pytest.raises(Exception, match="no such parameter group"):
        mzml.scan_mzml(spark, str(tmp_path)).collect()


def test_mzml_round_trip(spark, tmp_path):
    from peptura.sources import mzml

    peak = "array<struct<id:int,mz:double,intensity:double>>"
    rows = [("s", 2, 400.25, 2, [(1, 2.5, 3.0), (0, 1.5, 9.0)]), ("s", 1, None, None, []), ("t", 2, 1.0, 1, [(0, 7.0, 1.0)]), ("t", -4, 1.0, 1, None)]
    df = spark.createDataFrame(rows, f"sample string, scan long, precursor_mz double, precursor_charge int, peaks {peak}")
    folder = f"file://{tmp_path}/out"
    assert sorted((r["file"].rpartition("/")[2], r["n"]) for r in mzml.write_mzml(df, folder).collect()) == [("s.mzML", 2), ("t.mzML", 2)]
    got = mzml.load_samples(spark, folder, ["s", "t"]).where("scan is not null")
    found = {(r["sample"], r["scan"]): (r["precursor_mz"], r["precursor_charge"], [tuple(p) for p in r["peaks"]]) for r in got.collect()}
    assert found["s", 2] == (400.25, 2, [(0, 1.5, 9.0), (1, 2.5, 3.0)]) and found["s", 1] == (None, None, []) and found["t", 2][2] == [(0, 7.0, 1.0)]
