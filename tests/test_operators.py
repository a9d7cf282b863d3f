"""Operators against literals, plain Python and files."""

import base64
import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from peptura.functions import masses as M
from peptura.functions import sequences as S
from peptura.operators import hybrids, ions, kmers, legacy, psms, scoring, spectra
from peptura.operators.clusters import cluster_filter, clusters, extend_clusters, pieces
from peptura.operators.range_join import outer_range_join, range_join
from peptura.plans.search import SearchConfig, find_hybrids
from peptura.sources import fasta, mzml, tables


def one(df):
    return [tuple(r) for r in df.collect()]


def test_ion_mz(spark):
    df = spark.createDataFrame([("ACD", 2)], "seq string, z int").select(M.aa_mass(F.col("seq")).alias("m"), "z")
    b, y = one(df.select(M.ion_mz(F.col("m"), F.col("z"), F.lit("b")), M.ion_mz(F.col("m"), F.col("z"), F.lit("y"))))[0]
    assert b == pytest.approx(145.54389711688, abs=1e-9) and y == pytest.approx(154.54917946688, abs=1e-9)
    assert one(spark.range(1).select(M.aa_mass(F.lit("AXA")), M.aa_mass(F.lit("")))) == [(None, 0.0)]
    with pytest.raises(Exception, match="unknown residue"):
        spark.range(1).select(M.checked_aa_mass(F.concat(F.lit("AX"), F.col("id").cast("string")))).collect()


def test_sequence_functions(spark):
    r = spark.range(1)
    assert one(r.select(S.prefixes(F.lit("ABC")), S.suffixes(F.lit("ABC")), S.prefixes(F.lit("")))) == [(["A", "AB", "ABC"], ["ABC", "BC", "C"], [])]
    assert one(r.select(S.positions(F.lit("AAAAA"), F.lit("AA")), S.positions(F.lit("ABC"), F.lit("X")))) == [([0, 2], [])]
    assert one(r.select(S.kmer_overlap(F.lit("ABCD"), F.lit("CDE")), S.kmer_overlap(F.lit("AB"), F.lit("C")))) == [(2, 0)]
    assert one(r.select(*S.parse_hybrid_name(F.lit("hybrid_AB-CD")))) == [("AB", "CD")]
    with pytest.raises(Exception, match="not a hybrid"):
        one(r.select(S.parse_hybrid_name(F.concat(F.lit("x"), F.col("id").cast("string")))[0]))
    b, y = S.junction_seqs(F.lit("AB"), F.lit("CD"))
    assert one(r.select(b, y)) == [(["ABC", "ABCD"], ["BCD"])]
    assert one(r.select(*S.parse_result_file_name(F.lit("a.b.comet.7-7.target.txt")), S.parse_result_file_name(F.lit("a.comet.7-8.target.txt"))[0])) == [("a.b", "7", "target", "")]
    assert sorted(one(r.select(F.explode(S.permuted(F.lit("abx"), "ab"))))) == [("aax",), ("abx",), ("bax",), ("bbx",)]
    assert one(r.select(S.decoy(F.lit("ABCD")), S.fasta_description(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("c"))))) == [("CBAD", "left-prots:a,b;right-prots:c")]


def test_kmers_of_any_length(spark):
    rng = random.Random(0)
    seqs = ["", "A", "ACDX", "".join(rng.choices("ACDEFGHIKLX", k=127)), "".join(rng.choices("ACDEFGHIKLX", k=128)), "".join(rng.choices("ACDEFGHIKLXB", k=700))]
    df = spark.createDataFrame(list(enumerate(seqs)), "prot_id int, seq string")
    want = sorted((i, s[a : a + k], a, k) for i, s in enumerate(seqs) for k in range(2, 6) for a in range(len(s) - k + 1) if not re.search("[BXUZOJ]", s[a : a + k]))
    assert sorted(one(kmers.kmers(df, 5, 2))) == want
    small = spark.createDataFrame([(0, "p", "ACACD"), (1, "q", "ACN")], "prot_id int, name string, seq string")
    assert {(r["kmer"], r["prot_id"]): r["n"] for r in kmers.kmer_counts_by_protein(small, 2, 2).collect()}["AC", 0] == 2
    assert {r["kmer"]: r["proteins"] for r in kmers.kmer_to_proteins(small, 2, 2).collect()}["AC"] == ["p", "q"]


def test_range_join_is_between(spark):
    rng = random.Random(1)
    points = [(i, rng.uniform(-5, 50)) for i in range(200)] + [(900, 7.0), (901, 0.0)]
    spans = [(i, (a := rng.uniform(-5, 50)), a + rng.choice([0, 0.01, 0.5, 7])) for i in range(150)] + [(900, 7.0, 7.0), (901, 9.0, 8.0), (902, 100.0, 101.0)]
    p, s = spark.createDataFrame(points, "i int, x double"), spark.createDataFrame(spans, "j int, lo double, hi double")
    want = sorted((j, i) for j, lo, hi in spans for i, x in points if lo <= x <= hi)
    for width in (0.3, 5.0):
        df = range_join(p, s, "x", "lo", "hi", width)
        assert sorted(one(df.select("j", "i"))) == want
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    narrow = s.where("hi - lo < 1")
    outer = outer_range_join(narrow, p, "x", "lo", "hi", 1.0)
    ids = {j for j, lo, hi in spans if hi - lo < 1}
    assert sorted(one(outer.select("j", "i").where("i is not null"))) == [(j, i) for j, i in want if j in ids]
    assert sorted(j for j, i in one(outer.select("j", "i")) if i is None) == sorted(ids - {j for j, _ in want})
    assert "NestedLoop" not in outer._jdf.queryExecution().executedPlan().toString()
    logs = outer_range_join(narrow.where("lo > 0.5"), p.where("x > 0"), "x", "lo", "hi", 1.2, scale=F.ln)
    assert sorted(one(logs.select("j", "i").where("i is not null"))) == [(j, i) for j, i in want if j in ids and {a: b for a, b, _ in spans}[j] > 0.5]
    with pytest.raises(Exception, match="wider than the bins"):
        outer_range_join(s, p, "x", "lo", "hi", 0.3).collect()


def test_clusters_extension_and_pieces(spark):
    proteins = spark.createDataFrame([(0, "p", "MEEADNEEEK"), (1, "q", "AXAA")], "prot_id int, name string, seq string")
    positioned = [("b", "p", 3, 5, "AD"), ("b", "p", 3, 6, "ADN"), ("y", "p", 4, 6, "DN"), ("y", "p", 3, 6, "ADN"), ("b", "q", 0, 1, "A")]
    df = spark.createDataFrame([("s", 1, *r) for r in positioned], "sample string, scan int, ion_type string, protein string, start int, end int, kmer string")
    found = cluster_filter(clusters(df))
    assert sorted(one(found.select("ion_type", "support", "start", "end"))) == [("b", 2, 3, 6), ("y", 2, 3, 6)]
    mass = sum(M.RESIDUES[c] for c in "ADNEE") + M.WATER_MASS
    spec = spark.createDataFrame([("s", 1, mass / 2 + M.PROTON_MASS, 2)], "sample string, scan int, precursor_mz double, precursor_charge int")
    ext = {r["ion_type"]: r["extended_seq"] for r in extend_clusters(found, proteins, spec).collect()}
    assert ext == {"b": "ADNEE", "y": "EEADN"}
    assert sorted(one(pieces(extend_clusters(found, proteins, spec)).select("side", "piece")))[0] == ("L", "AD")


def test_search_recovers_a_planted_hybrid(spark):
    rng = random.Random(5)
    seqs = ["".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=40)) for _ in range(6)]
    left, right = seqs[0][5:11], seqs[3][20:27]
    mass = lambda s: sum(M.RESIDUES[c] for c in s)
    peaks = [mass(left[:k]) + M.PROTON_MASS for k in range(2, 7)] + [mass(right[-k:]) + M.WATER_MASS + M.PROTON_MASS for k in range(2, 8)]
    precursor = (mass(left + right) + M.WATER_MASS + 2 * M.PROTON_MASS) / 2
    got = find_hybrids(
        spark.createDataFrame([("s", 1, precursor, 2)], "sample string, scan int, precursor_mz double, precursor_charge int"),
        spark.createDataFrame([("s", 1, i, m, 1.0) for i, m in enumerate(peaks)], "sample string, scan int, peak_id int, mz double, intensity double"),
        spark.createDataFrame([(i, f"p{i}", s) for i, s in enumerate(seqs)], "prot_id int, name string, seq string"),
        SearchConfig(min_k=1, max_k=8),
    ).collect()
    assert (left, right) in {(r["left_seq"], r["right_seq"]) for r in got}
    spec = spark.createDataFrame([("s", 1, precursor, 2)], "sample string, scan int, precursor_mz double, precursor_charge int")
    own = spark.createDataFrame([("s", 1, i, m, 1.0) for i, m in enumerate(peaks)], "sample string, scan int, peak_id int, mz double, intensity double")
    proteins = spark.createDataFrame([(i, f"p{i}", s) for i, s in enumerate(seqs)], "prot_id int, name string, seq string")
    assert [find_hybrids(spec, own, proteins, SearchConfig(max_k=8, scans=s)).isEmpty() for s in ((2,), (1, 2))] == [True, False]
    for r in got:  # every hybrid lies within the tolerance of the precursor
        mz = (mass(r["left_seq"] + r["right_seq"]) + M.WATER_MASS + 2 * M.PROTON_MASS) / 2
        assert abs(mz - precursor) <= 20 * precursor / 1e6 * 1.001


def test_possible_hybrids(spark):
    table = spark.createDataFrame([("A", ["p"]), ("BC", ["q"]), ("AB", ["p"]), ("C", ["r"])], "kmer string, proteins array<string>")
    df = spark.createDataFrame([("ABC",), ("XY",)], "seq string")
    assert sorted(one(hybrids.possible_hybrids(df, table).select("left_seq", "right_seq"))) == [("A", "BC"), ("AB", "C")]
    assert sorted(one(hybrids.split_points(df, 2).select("seq"))) == []


def test_q_values(spark):
    rng = random.Random(2)
    rows = [(i, "s", i % 260, float(rng.randint(0, 60)), rng.random() < 0.3) for i in range(400)]
    df = spark.createDataFrame(rows, "psm_id int, sample string, scan int, score double, is_decoy boolean")
    won = {}
    for r in rows:
        if r[2] not in won or (r[3], r[4], -r[0]) > (won[r[2]][3], won[r[2]][4], -won[r[2]][0]):
            won[r[2]] = r
    fdr = lambda s: min(1.0, (sum(r[4] for r in won.values() if r[3] >= s) + 1) / max(1, sum(not r[4] for r in won.values() if r[3] >= s)))
    scores = sorted({r[3] for r in won.values()})
    want = {r[0]: min(fdr(s) for s in scores if s <= r[3]) for r in won.values() if not r[4]}
    got = {r["psm_id"]: r["q_value"] for r in psms.tdc_q_value(df, buckets=7).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_peaks_and_report(spark):
    peaks = spark.createDataFrame([("s", 1, i, 100.0 + i, float(v)) for i, v in enumerate([5, 9, 9, 1])], "sample string, scan int, peak_id int, mz double, intensity double")
    assert [r["peak_id"] for r in spectra.top_n_peaks(peaks, 1).collect()] == [1] and spectra.top_n_peaks(peaks, 0).count() == 4
    pep = spark.createDataFrame([(1, "s", 1, "GA", "G", "A")], "pid int, sample string, scan int, seq string, left_seq string, right_seq string")
    g = M.RESIDUES["G"] + M.PROTON_MASS
    hit = spark.createDataFrame([("s", 1, 0, g, 3.0), ("s", 1, 1, 999.0, 1.0), ("t", 1, 0, g, 9.0)], "sample string, scan int, peak_id int, mz double, intensity double")
    r = scoring.peptide_spectrum_report(pep, hit).collect()[0]
    assert (r["n_b"], r["n_y"], r["n_peaks_distinct"], r["share_b"]) == (1, 0, 1, 0.75)
    assert (r["n_hybrid"], r["n_junction"], r["prop_hybrid"]) == (0, 2, 0.0)  # the whole sequence as b and as y ion


def test_best_complement_is_the_heaviest_fit(spark):
    rng = random.Random(3)
    rows = [(p, 500.0, i % 5, rng.choice("by"), i, f"k{i}", float(rng.randint(50, 480))) for p in range(4) for i in range(30)]
    df = spark.createDataFrame(rows, "prec_id int, precursor_mz double, prot_id int, ion_type string, anchor int, kmer string, kmer_mass double")
    want = set()
    for r in rows:
        fit = [o for o in rows if o[0] == r[0] and o[3] != r[3] and o[6] <= r[1] - r[6]]
        if fit:
            want.add((r[5], r[0], min(fit, key=lambda o: (-o[6], o[2], o[4]))[5]))
    assert set(one(legacy.best_complement(df).select("kmer", "prec_id", "other_kmer"))) == want


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "in.fasta").write_text(">sp|P1|ONE_MOUSE First protein OS=Mus\nACD\nEFG\n>two\nKLM\n>three x y\nNN\n")
    df = fasta.scan_fasta(spark, str(tmp_path / "in.fasta"))
    rows = sorted(one(df))
    assert rows == [(0, "sp|P1|ONE_MOUSE", "First protein OS=Mus", "ACDEFG"), (1, "two", "", "KLM"), (2, "three", "x y", "NN")]
    fasta.write_fasta(df, str(tmp_path / "out"))
    assert sorted(r[1:] for r in one(fasta.scan_fasta(spark, str(tmp_path / "out")))) == sorted(r[1:] for r in rows)
    old = {r["identifier"]: r for r in fasta.scan_fasta_legacy(spark, str(tmp_path / "in.fasta")).collect()}
    assert (old["P1"]["name"], old["P1"]["readable_name"]) == ("ONE_MOUSE", "First protein")


def test_mzml(spark, tmp_path):
    pack = lambda xs, f: base64.b64encode(zlib.compress(struct.pack(f"<{len(xs)}{f}", *xs))).decode()
    cv = lambda acc, v="": f'<cvParam accession="{acc}" value="{v}"/>'
    array = lambda xs, f, kind: f"<binaryDataArray>{cv('MS:1000521' if f == 'f' else 'MS:1000523')}{cv('MS:1000574')}{cv(kind)}<binary>{pack(xs, f)}</binary></binaryDataArray>"
    spec = lambda n, level: (
        f'<spectrum id="controllerType=0 scan={n}">{cv("MS:1000511", level)}<scanList><scan>{cv("MS:1000016", 1.5)}</scan></scanList><precursorList><precursor><selectedIonList>'
        f"<selectedIon>{cv('MS:1000744', 400.25)}{cv('MS:1000041', 2)}{cv('MS:1000042', 99)}</selectedIon></selectedIonList></precursor></precursorList>"
        f"<binaryDataArrayList>{array([100.5, 200.25], 'd', 'MS:1000514')}{array([1.0, 2.0], 'f', 'MS:1000515')}</binaryDataArrayList></spectrum>"
    )
    text = f'<mzML xmlns="http://psi.hupo.org/ms/mzml"><run><spectrumList>{spec(1, 1)}{spec(7, 2)}</spectrumList></run></mzML>'
    (tmp_path / "a.b.mzML").write_text(text)
    rows = mzml.scan_mzml(spark, str(tmp_path)).collect()
    assert [(r["sample"], r["scan"], r["precursor_mz"], r["precursor_charge"], r["retention_time"]) for r in rows] == [("a", 7, 400.25, 2, 1.5)]
    assert [(p["id"], p["mz"], p["intensity"]) for p in rows[0]["peaks"]] == [(0, 100.5, 1.0), (1, 200.25, 2.0)]
    df = mzml.scan_mzml(spark, str(tmp_path), ms2_only=False)
    assert df.count() == 2 and mzml.get_spectrum(df, 7).count() == 1
    with pytest.raises(ValueError):
        mzml.get_spectrum(df, 8)


def test_result_files_and_tables(spark, tmp_path):
    (tmp_path / "s.comet.target.txt").write_text("scan\txcorr score\txcorr rank\tsequence\tprotein id\n7\t2.5\t1\tACD\tp,q\n8\t1.5\t2\tEE\thybrid_A-B\n")
    got = {r["scan"]: r for r in tables.scan_psms(spark, str(tmp_path / "s.comet.target.txt")).collect()}
    assert (got[7]["xcorr"], got[7]["num"], got[7]["proteins"], got[7]["sample"]) == (2.5, 1, ["p", "q"], "s")
    (tmp_path / "q.txt").write_text("file\tscan\ttdc q-value\ta/b.comet.target.txt\n".replace("\ta/b.comet.target.txt", "") + "x/F4.comet.target.txt\t3\t0.05\n")
    assert one(tables.scan_psms(spark, str(tmp_path / "q.txt")).select("sample", "scan", "q_value")) == [("F4", 3, 0.05)]
    (tmp_path / "n.txt").write_text("CometVersion 2023\trun\tdb\nscan\tnum\txcorr\tplain_peptide\tprotein\n5\t1\t3.5\tACD\tp,q\n")
    assert one(tables.scan_psms(spark, str(tmp_path / "n.txt")).select("scan", "num", "xcorr", "seq", "proteins")) == [(5, 1, 3.5, "ACD", ["p", "q"])]
    with pytest.raises(ValueError):
        tables.write_table(spark.range(1), str(tmp_path / "x"), "pickle")
    tables.write_table(spark.range(1).select("id", F.array(F.lit(1), F.lit(2)).alias("a")), str(tmp_path / "t"), "tsv")
    assert one(spark.read.option("header", "true").option("sep", "\t").csv(str(tmp_path / "t"))) == [("0", "1/2")]


def test_samples_are_kept_apart(spark):
    """The left ions in one sample and the right ions in another, under one scan number, are no hybrid."""
    rng = random.Random(5)
    seqs = ["".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=40)) for _ in range(6)]
    left, right = seqs[0][5:11], seqs[3][20:27]
    mass = lambda s: sum(M.RESIDUES[c] for c in s)
    precursor = (mass(left + right) + M.WATER_MASS + 2 * M.PROTON_MASS) / 2
    b = [mass(left[:k]) + M.PROTON_MASS for k in range(2, 7)]
    y = [mass(right[-k:]) + M.WATER_MASS + M.PROTON_MASS for k in range(2, 8)]
    spec = spark.createDataFrame([(s, 1, precursor, 2) for s in "ab"], "sample string, scan int, precursor_mz double, precursor_charge int")
    proteins = spark.createDataFrame([(i, f"p{i}", s) for i, s in enumerate(seqs)], "prot_id int, name string, seq string")
    for parts, found in (({"a": b, "b": y}, set()), ({"a": b + y, "b": []}, {"a"})):
        rows = [(s, 1, i, m, 1.0) for s, mz in parts.items() for i, m in enumerate(mz)]
        got = find_hybrids(spec, spark.createDataFrame(rows, "sample string, scan int, peak_id int, mz double, intensity double"), proteins, SearchConfig(max_k=8)).collect()
        assert {r["sample"] for r in got if (r["left_seq"], r["right_seq"]) == (left, right)} == found
        assert found or not got


def test_search_runs_once(spark):
    """hybrid_pairs reads its pieces on both sides: the search that made them is run for neither a second time."""
    spec = spark.createDataFrame([("a", 1, 500.0, 2)], "sample string, scan int, precursor_mz double, precursor_charge int")
    found = spark.createDataFrame([("a", 1, "L", "AC", "p"), ("a", 1, "R", "AC", "q")], "sample string, scan int, side string, piece string, protein string")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    hybrids.hybrid_pairs(hybrids.piece_proteins(found.mapInPandas(counted, found.schema)), spec).collect()
    assert seen.value == 2


def test_places_do_not_overlap(spark):
    df = spark.createDataFrame([(0, "p", "AAAAACAAX"), (1, "q", "ACAC"), (2, "r", "")], "prot_id int, name string, seq string")
    got = {(r["kmer"], r["protein"]): r["starts"] for r in kmers.kmer_places(df, 3, 1).collect()}
    for name, seq in (("p", "AAAAACAAX"), ("q", "ACAC")):
        for k in (1, 2, 3):
            for w in {seq[i : i + k] for i in range(len(seq) - k + 1)}:
                want = [m.start() for m in re.finditer(w, seq)]
                assert got.get((w, name)) == (None if "X" in w else want)


def test_contained_sequences(spark):
    rng = random.Random(4)
    seqs = ["".join(rng.choices("ACD", k=n)) for n in (0, 1, 5, 127, 128, 129, 700)] + [None]
    queries = [s[a : a + n] for s in seqs if s for n in (1, 2, 3, 9, 140, 600) for a in (0, len(s) // 2)] + ["", "W", "AW", "WWWW", "ACDACDACDACDA", None]
    p = spark.createDataFrame([(s,) for s in seqs], "seq string")
    q = spark.createDataFrame([(x,) for x in queries], "query string")
    df = kmers.contains_seq(p, q)
    assert sorted(r[0] for r in df.collect()) == sorted({x for x in queries if x is not None and any(s is not None and x in s for s in seqs)})
    assert kmers.contains_seq(p.limit(0), q).count() == 0


def test_change_is_as_stated(spark):
    psm = "sample string, scan int, num int, score double, eval double, ions_matched int"
    n = spark.createDataFrame([("s", 1, 1, 2.0, 0.5, 7), ("s", 1, 2, 1.0, 0.9, 9), ("s", 2, 1, 0.0, 1.0, 1), ("s", 3, 1, 1.0, 1.0, 1)], psm)
    h = spark.createDataFrame([("s", 1, 1, 3.0, 0.1, 8), ("s", 1, 2, 5.0, 0.1, 12), ("s", 2, 1, 1.0, 0.1, 2)], psm)
    r = {x["scan"]: x for x in psms.native_hybrid_change(n, h).collect()}
    assert set(r) == {1, 2} and (r[1]["change"], r[1]["rel_change"], r[1]["native_eval"], r[1]["native_least_eval"], r[1]["ions_change"]) == (3.0, 1.5, 0.9, 0.5, 3)
    assert r[2]["rel_change"] is None
    k = {x["scan"]: x for x in psms.rank_change(n, h).collect()}
    assert (k[1]["change"], k[1]["rel_change"]) == (-1.0, -0.5) and k[2]["rel_change"] == pytest.approx(-1e5)
    assert psms.union_scans(n.where("scan = 1"), h.where("scan = 1")) == ("s", 1)
    for a, b in ((n, h), (n.limit(0), h.limit(0))):
        with pytest.raises(ValueError):
            psms.union_scans(a, b)


def test_dense_rank_in_two_levels(spark):
    rng = random.Random(6)
    vals = [rng.choice([1.5, rng.uniform(0, 50), float(rng.randint(0, 9))]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(vals)), "i int, v double")
    order = sorted(set(vals), reverse=True)
    assert sorted(one(psms.dense_rank_desc(df, "v", 7).select("i", "rank"))) == [(i, order.index(v) + 1) for i, v in enumerate(vals)]


def test_older_engine_peptides(spark):
    """A pair of clusters and its peptide, by hand."""
    rows = [("x", 400.0, 1, "b", 0, "AC", 174.0, 3, "DE", 10), ("x", 400.0, 2, "y", 9, "KR", 220.0, 2, "F", 20), ("x", 400.0, 2, "y", 5, "K", 128.0, 1, "", 20)]
    df = spark.createDataFrame(rows, "prec_id string, precursor_mz double, prot_id int, ion_type string, anchor int, kmer string, kmer_mass double, score int, extension string, seq_length int")
    got = {r["anchor"]: r for r in legacy.aligned_peptides(legacy.best_complement(df)).collect()}
    r = got[0]
    assert (r["sequence"], r["peptide_type"], r["b_score"], r["y_score"], r["total_score"], r["length_score"]) == ("ACDEFKR", "h", 3, 2, 5, 0.4)
    assert (got[9]["sequence"], got[9]["left_prot_id"], got[9]["length_score"]) == ("ACDEFKR", 1, 0.2) and got[5]["sequence"] == "ACDEK"
    out = legacy.legacy_output(legacy.aligned_peptides(legacy.best_complement(df)).withColumn("precursor_mz", F.lit(400.0)).withColumn("precursor_charge", F.lit(2)), spark.createDataFrame([(1, "p"), (2, "q")], "prot_id int, name string"))
    assert out.columns == list(legacy.OUTPUT_COLUMNS) and ("D/E", "F") in {(x["prev aa"], x["next aa"]) for x in out.collect()}
    spec = spark.createDataFrame([("s", 1, None, None, [(0, 100.126, 5.0), (1, 50.5, 9.0), (2, 70.0, 1.0)])], "sample string, scan int, precursor_mz double, precursor_charge int, peaks array<struct<id:int,mz:double,intensity:double>>")
    assert one(legacy.legacy_precursors(spec, 2, num_peaks=2).select("precursor_mz", "precursor_charge", "frag_id", "mz")) == [(100.13, 1, 0, 50.5), (100.13, 1, 1, 100.13)]
    assert [r["mz"] for r in legacy.legacy_precursors(spec, 2, share=50).collect()] == [50.5]


def test_legacy_kmers_of_any_length(spark):
    rng = random.Random(7)
    seqs = ["", "S", "".join(rng.choices("SDKRAX", k=130)), "".join(rng.choices("SDKRA", k=400))]
    got = sorted(one(legacy.legacy_kmers(spark.createDataFrame(list(enumerate(seqs)), "prot_id int, seq string"), 4, ["S", "D"], ["K", "R"]).where("charge = 1").select("prot_id", "kmer", "start", "ion_type")))
    want = []
    for i, s in enumerate(seqs):
        for k in range(2, 5):
            for a in range(len(s) - k + 1):
                w, z = s[a : a + k], a + k
                if re.search("[BXUZOJ]", w):
                    continue
                if w[0] in "SD" or (a > 0 and s[a - 1] in "KR"):
                    want.append((i, w, a, "b"))
                if w[-1] in "KR" or (z < len(s) and s[z] in "SD"):
                    want.append((i, w, a, "y"))
    assert got == sorted(want)


def test_kmers_of_a_protein_are_not_shuffled(spark):
    df = spark.createDataFrame([(i, f"p{i}", "ACDEFG" * (i + 1)) for i in range(9)], "prot_id int, name string, seq string")
    for made, shuffles in ((kmers.kmer_counts_by_protein(df, 3, 2), 1), (kmers.kmer_places(df, 3, 2), 1), (kmers.kmer_to_proteins(df, 3, 2), 2)):
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == shuffles


def test_remove_contained(spark):
    proteins = spark.createDataFrame([(0, "p", "ACDEFGHIKLMNPQRSTVWYACDEFGHIKL"), (1, "q", None), (2, "r", "")], "prot_id int, name string, seq string")
    pairs = [("ACDEFGHIKLM", "NPQRSTVWYACDE"), ("AC", "DE"), ("WY", "AC"), ("C", "A"), ("K", "L"), ("KL", "AC"), ("ACDEFGHIKLMNPQRSTVWYACDEFGHIKL", "A"), ("ACDEFGHIKLMNPQRSTVWYACDEFGHIK", "L")]
    df = spark.createDataFrame([("s", i, a, b) for i, (a, b) in enumerate(pairs)], "sample string, scan int, left_seq string, right_seq string")
    assert sorted(r["scan"] for r in hybrids.remove_contained(df, proteins).collect()) == [3, 5, 6]
    assert hybrids.remove_contained(df.limit(0), proteins).collect() == [] and hybrids.remove_contained(df, proteins.limit(0)).count() == len(pairs)


@pytest.mark.parametrize(("name", "check"), [
    ("remove_native", lambda rows, q: 0 < len(rows) < q["hybrid_pairs"].count()),
    ("remove_native_kmers", lambda rows, q: 0 < len(rows) < q["hybrid_pairs"].count()),
    ("legacy_clusters", lambda rows, q: max(r["score"] for r in rows) > 2 and any(len(r["kmer"]) > 2 for r in rows)),
    ("kmer_postings", lambda rows, q: max(r["n_proteins"] for r in rows) > 150 and all(r["bounded"] for r in rows)),
])
def test_queries_do_something(spark, name, check):
    """Rows are removed, grouped, bounded: a query that passes everything through would match its SQL as well."""
    import os

    import __spark_entry__

    if not os.path.exists("/root/testdata/sf0.001"):
        pytest.skip("no tables here")
    found = __spark_entry__.queries()
    asked = {n: found[n](spark, "/root/testdata/sf0.001") for n in (name, "hybrid_pairs")}
    assert check(asked[name].collect(), asked)
