"""The command line, the settings and the scorer on small files."""

import json

import pytest

from peptura import __main__ as cli
from peptura.functions import masses as M
from peptura.operators.scorer import search_spectra
from peptura.plans.settings import MeanTimer, ScorerSettings, core_count


def test_commands(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "p.fasta").write_text(">a one\nACDEF\n>b two\nACGG\n")
    (tmp_path / "names.txt").write_text("b\n")
    cli.main(["create-db", "--fasta", at("p.fasta"), "--out", at("db"), "--protein_names", at("names.txt"), "--max_k", "2"])
    assert {r["kmer"] for r in spark.read.parquet(at("db")).collect()} == {"A", "C", "G", "AC", "CG", "GG"}
    cli.main(["uniq-kmers", "--fasta", at("p.fasta"), "--out", at("k"), "--min_k", "4", "--max_k", "4"])
    assert {r[0] for r in spark.read.text(at("k")).collect()} == {"ACDE", "CDEF", "ACGG"}
    (tmp_path / "res").mkdir()
    head = "scan\txcorr score\txcorr rank\tsequence\tprotein id\n"
    (tmp_path / "res" / "s.comet.target.txt").write_text(head + "7\t2\t1\tACD\ta,b\n7\t1\t2\tAC\tb\n8\t1\t1\tAC\tb\n")
    cli.main(["protein-abundances", "--results", at("res"), "--top_n_psms", "1", "--top_n_proteins", "1", "--out", at("top")])
    assert [r[0] for r in spark.read.text(at("top")).collect()] == ["b"]
    cli.main(["prefix-abundances", "--results", at("res"), "--top_n_psms", "2", "--out", at("prefix")])
    rows = {r["length"]: [(p["prefix"], p["n"]) for p in r["prefixes"]] for r in map(json.loads, (x[0] for x in spark.read.text(at("prefix")).collect()))}
    assert rows == {1: [("A", 3)], 2: [("AC", 3)], 3: [("ACD", 1)]}
    with pytest.raises(SystemExit):
        cli.main(["no-such-command"])


def test_scorer_ranks_the_right_peptide_first(spark):
    mass = lambda s: sum(M.RESIDUES[c] for c in s)
    right, same_mass, other = "ACDEFGHIK", "KIHGFEDCA", "ACDEFGHIKL"
    precursor = (mass(right) + M.WATER_MASS + 2 * M.PROTON_MASS) / 2
    spec = spark.createDataFrame([("s", 1, precursor, 2), ("t", 1, precursor, 3)], "sample string, scan int, precursor_mz double, precursor_charge int")
    peaks = [mass(right[:k]) + M.PROTON_MASS for k in range(1, 9)] + [mass(right[-k:]) + M.WATER_MASS + M.PROTON_MASS for k in range(1, 9)]
    peaks = spark.createDataFrame([("s", 1, i, m, 1.0) for i, m in enumerate(peaks)], "sample string, scan int, peak_id int, mz double, intensity double")
    seqs = spark.createDataFrame([(right,), (same_mass,), (other,), ("ACD",), ("ACXEFGHIK",)], "seq string")
    got = sorted(map(tuple, search_spectra(spec, peaks, seqs).select("sample", "num", "seq").collect()))
    assert got == [("s", 1, right), ("s", 2, same_mass)]
    assert search_spectra(spec, peaks, seqs, ScorerSettings(top_n=1)).count() == 1 and search_spectra(spec, peaks.limit(0), seqs).count() == 2


def test_small_helpers():
    assert core_count(0) == 1 and core_count(10**6) >= 1
    timer = MeanTimer()
    assert [timer.add(x) for x in (1.0, 3.0, 5.0)] == [1.0, 2.0, 3.0]


def test_searches_from_files(spark, tmp_path):
    """The scorer and the older engine from mzML and FASTA to their results."""
    from peptura.sources import mzml

    mass = lambda x: sum(M.RESIDUES[c] for c in x)
    at = lambda name: str(tmp_path / name)
    seq = "SACDEFGHIKR"
    ions = [mass(seq[:k]) + M.PROTON_MASS for k in range(2, 9)] + [mass(seq[-k:]) + M.WATER_MASS + M.PROTON_MASS for k in range(2, 9)]
    peaks = [(i, m, 10.0 + i) for i, m in enumerate(sorted(ions))]
    spectra = spark.createDataFrame([("run", 7, (mass(seq) + M.WATER_MASS + 2 * M.PROTON_MASS) / 2, 2, peaks)], "sample string, scan long, precursor_mz double, precursor_charge int, peaks array<struct<id:int,mz:double,intensity:double>>")
    mzml.write_mzml(spectra, at("spectra")).collect()
    (tmp_path / "p.fasta").write_text(f">a one\nMM{seq}GG\n>b two\nGGSACDKRHIG\n")
    cli.main(["search", "--mzml", at("spectra"), "--fasta", at("p.fasta"), "--out", at("found")])
    first = spark.read.parquet(at("found")).where("num = 1").collect()
    assert [(r["seq"], r["sample"], r["scan"], r["is_decoy"]) for r in first] == [(seq, "run", 7, False)]
    before = spark.read.parquet(at("found")).count()
    cli.main(["search", "--mzml", at("spectra"), "--fasta", at("p.fasta"), "--out", at("found")])  # has results, is skipped
    assert spark.read.parquet(at("found")).count() == before
    cli.main(["older-run", "--mzml", at("spectra"), "--fasta", at("p.fasta"), "--out", at("older"), "--max_k", "3", "--ppm", "20"])
    table = spark.read.option("header", "true").option("sep", "\t").csv(at("older"))
    assert len(table.columns) == 15 and {r["spectrum_id"] for r in table.collect()} == {"run:7"}
    cli.main(["kmer-counts", "--fasta", at("p.fasta"), "--k", "2", "--out", at("counts")])
    counts = {(r["kmer"], r["prot_id"]): r["n"] for r in spark.read.parquet(at("counts")).collect()}
    assert counts["GG", 0] == 1 and counts["SA", 1] == 1 and ("MM", 1) not in counts
    cli.main(["kmer-counts", "--fasta", at("p.fasta"), "--k", "3", "--out", at("counts")])
    assert {len(r["kmer"]) for r in spark.read.parquet(at("counts")).collect()} == {2}
    cli.main(["kmer-counts", "--fasta", at("p.fasta"), "--k", "3", "--out", at("counts"), "--overwrite"])
    assert {len(r["kmer"]) for r in spark.read.parquet(at("counts")).collect()} == {3}
