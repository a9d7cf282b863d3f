"""Work is dealt by the number of rows, not by the bytes of small files."""

import pytest
from pyspark.sql import functions as F

from peptura.operators.dealing import ROWS, dealt, few
from peptura.operators.legacy import best_complement
from peptura.queries import retired
from peptura.queries.adapters import Tables


def _tables(spark, tmp_path, suppliers):
    at = str(tmp_path)
    spark.createDataFrame([(i, n, t, "B") for i, (n, t) in enumerate([("ACDKSEF", "GHSKIK"), ("LMNKSPQ", "RSTDRSV"), ("WYAKCSD", "EFGKHDI")])], "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{at}/part.parquet")
    spark.range(suppliers).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{at}/supplier.parquet")
    return Tables(spark, at)


def _most_in_a_partition(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_spectra_of_one_small_file_are_dealt(spark, tmp_path):
    t = _tables(spark, tmp_path, 8 * ROWS)
    assert t["supplier"].rdd.getNumPartitions() == 1
    for df, each in ((t.planted, 1), (t.peaks_theo, 8), (retired._planted_fragments(t), 2)):
        assert df.rdd.getNumPartitions() == 8
        assert df.count() == 8 * ROWS * each and _most_in_a_partition(df) < 2 * ROWS * each


def test_the_complement_needs_no_second_deal(spark, capsys):
    rows = [("p", t, 500.0, 1, a, "AC", m, 1) for t, a, m in (("b", 1, 150.0), ("b", 2, 250.0), ("y", 3, 200.0), ("y", 4, 300.0))]
    df = spark.createDataFrame(rows, "prec_id string, ion_type string, precursor_mz double, prot_id long, anchor int, kmer string, kmer_mass double, score int")
    found = best_complement(dealt(df, 1, "prec_id"))
    found.explain()
    assert capsys.readouterr().out.count("Exchange ") == 1
    assert sorted((r["ion_type"], r["anchor"], r["other_anchor"]) for r in found.collect()) == [("b", 1, 4), ("b", 2, 3), ("y", 3, 2), ("y", 4, 1)]


def test_few_rows_are_counted_up_to_the_bound(spark, capsys):
    def hinted(df):
        df.explain(True)
        return "ResolvedHint" in capsys.readouterr().out

    assert hinted(few(spark.range(3), 3)) and not hinted(few(spark.range(4), 3))


def test_large_doubles_are_written_out(spark):
    from peptura.functions.sequences import time_units

    df = spark.createDataFrame([(0.05,), (9999999.0,), (18000001.0,), (123456789.5,), (5e16,)], "s double")
    assert [r[0].split(" = ")[0] for r in df.select(time_units(F.col("s"))).collect()] == ["0.05 secs", "9999999.0 secs", "18000001.0 secs", "123456789.5 secs", "5e+16 secs"]
    assert df.where("s = 18000001").select(time_units(F.col("s"))).first()[0] == "18000001.0 secs = 300000.02 mins = 5000.0 hrs"


@pytest.mark.parametrize("few", [0, 500_000])
def test_contained_queries_of_any_length(spark, monkeypatch, few):
    import random

    from peptura.operators import kmers
    from peptura.operators.kmers import CHUNK, contains_seq

    monkeypatch.setattr(kmers, "FEW_QUERIES", few)
    random.seed(5)
    seqs = ["".join(random.choices("ACDE", k=n)) for n in (0, 1, 7, 20, CHUNK, CHUNK + 1, 5 * CHUNK + 3)]
    there = {s[i : i + k] for s in seqs for k in (1, 2, 5, 14, 15, 16, 17, 18, 23, 24, 40, 150, 643) for i in range(len(s) - k + 1)}
    asked = sorted(random.sample(sorted(there), 900)) + [s for s in seqs if s]
    asked += [q[:-1] + "W" for q in asked] + [q + "A" for q in asked[:50]]
    proteins, queries = spark.createDataFrame([(s,) for s in seqs], "seq string"), spark.createDataFrame([(q,) for q in asked], "query string")
    got = sorted(r[0] for r in contains_seq(proteins, queries).collect())
    assert got == sorted({q for q in asked if any(q in s for s in seqs)})


@pytest.mark.parametrize("few", [0, 500_000])
def test_windows_of_texts_are_no_rows_of_a_plan(spark, monkeypatch, capsys, few):
    from peptura.operators import kmers

    monkeypatch.setattr(kmers, "FEW_QUERIES", few)
    proteins = spark.createDataFrame([("ACDEFGHI" * 40,), ("\u00e9\u20acA\0",), ("CA",), ("",), (None,)], "seq string")
    asked = ["EFGHIA", "\u20acA", "\u00e9\u20ac", "\0", "A\0C", "AC", "IC", "\u20ad", "CAA", "", None]
    df = kmers.contains_seq(proteins, spark.createDataFrame([(q,) for q in asked], "query string"))
    assert sorted(r[0] for r in df.collect()) == ["", "\0", "AC", "EFGHIA", "\u00e9\u20ac", "\u20acA"]
    df.explain("formatted")
    assert "Generate" not in capsys.readouterr().out  # each letter of a text was a row, or several


def test_stretches_and_letters_are_not_cut(monkeypatch):
    import random

    import pyarrow as pa

    from peptura.operators import kmers

    random.seed(6)
    texts = ["".join(random.choices("AC\u00e9\u20ac\0", k=n)) for n in (0, 1, 40, 0, 3, 17, 300, 0)]
    batches = [pa.record_batch([pa.array(part, pa.string())], ["seq"]) for part in (texts[:3], [], texts[2:])]
    batches.append(pa.record_batch([pa.array(["xx", *texts, "yy"], pa.large_string())], ["seq"]).slice(1, len(texts)))
    there = {t[i : i + k] for t in texts for k in range(1, 17) for i in range(len(t) - k + 1)}
    asked = sorted(there | {q[:-1] + "D" for q in there} | {q[1:] + q[:1] for q in there})
    want = sorted(q for q in asked if any(q in t for t in texts))
    for step in (1, 5, 64, 1 << 20):
        monkeypatch.setattr(kmers, "STRETCH", step)
        monkeypatch.setattr(kmers, "LETTERS", 4 * step)
        got = [q for b in kmers.held(iter(batches), kmers.by_size(asked)) for q in b.column(0).to_pylist()]
        assert sorted(got) == want
        sizes = sorted({len(q.encode()) for q in there})
        got = {q for b in kmers.windows(iter(batches), sizes) for q in b.column(0).to_pylist()}
        assert there <= got and all(any(q in t for t in texts) for q in got)


def test_an_index_is_not_held_for_a_lookup(tmp_path):
    import tracemalloc

    from pyarrow import fs

    from peptura.sources import mzml

    n, one = 100_000, '<spectrum id="scan={}"></spectrum>\n'
    text, offsets = "<mzML>", []
    parts, at = [text], len(text)
    for i in range(n):
        parts.append(one.format(i))
        offsets.append(at)
        at += len(parts[-1])
    listed = "".join(f'<offset idRef="scan={i}">{o}</offset>\n' for i, o in enumerate(offsets))
    other = '<index name="chromatogram"><offset idRef="scan=7">1</offset></index>'
    parts.append(f'<indexList><index name="spectrum">{listed}</index>{other}</indexList><indexListOffset>{at}</indexListOffset>')
    (tmp_path / "a.mzML").write_text("".join(parts))
    file = mzml._File(fs.LocalFileSystem(), str(tmp_path / "a.mzML"))
    tracemalloc.start()
    found = list(file.of_scans((7, n - 1)))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    print("MB", most)
    assert found == [one.format(7).strip().encode(), one.format(n - 1).strip().encode()] and most < 8


def test_pairs_are_dealt_as_pieces_were(spark):
    from peptura.operators.hybrids import hybrid_pairs
    from peptura.operators.keys import SPECTRUM

    rows = [("s", i, side, piece, [f"p{i}"]) for i in range(60) for side, piece in (("L", "ACD"), ("R", "EFG"))]
    found = spark.createDataFrame(rows, "sample string, scan long, side string, piece string, proteins array<string>")
    spectra = spark.range(60).select(F.lit("s").alias("sample"), F.col("id").alias("scan"), F.lit(2).alias("precursor_charge"))
    from peptura.functions.masses import aa_mass, y_mz

    spectra = spectra.withColumn("precursor_mz", y_mz(aa_mass(F.lit("ACDEFG")), F.col("precursor_charge")))
    for parts, want in ((9, 9), (2, None)):  # of four by the session
        pairs = hybrid_pairs(found.repartition(parts, *SPECTRUM), spectra.transform(dealt, 60, *SPECTRUM, rows=-(-60 // parts)))
        assert want is None or pairs.rdd.getNumPartitions() == want
        assert sorted((r["scan"], r["left_seq"], r["right_seq"]) for r in pairs.collect()) == [(i, "ACD", "EFG") for i in range(60)]


@pytest.mark.parametrize("name", ["best_complement", "cluster_filter", "clusters", "extend_cluster", "pieces", "position_ions", "piece_proteins", "_hybrids"])
def test_what_is_made_of_spectra_stays_dealt(spark, tmp_path, name):
    """No step of a query puts the spectra back into few partitions, as a grouping by the session's four would."""
    from peptura.queries import matching

    df = getattr(retired if name == "best_complement" else matching, name)(_tables(spark, tmp_path, 8 * ROWS))
    spectrum = ["prec_id"] if name == "best_complement" else ["sample", "scan"]
    own = df.select(F.spark_partition_id().alias("at"), *spectrum).distinct().groupBy("at").count().agg(F.sum("count"), F.max("count")).first()
    assert own[0] > 4 * ROWS and own[1] < 2 * ROWS
