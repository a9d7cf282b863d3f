"""The k-mer database on disk."""

import random
import re

import pytest

from peptura.operators import catalog as C
from peptura.operators import kmers
from peptura.operators.ions import peak_ion_match


def some_proteins(spark, rng, n=60):
    rows = [(i * 7 - 50, f"p{i}", "".join(rng.choices("ACDEFGHIKLX", k=rng.randrange(0, 400)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "prot_id long, name string, seq string").repartition(3)


@pytest.mark.parametrize("names", [1, 5, 1000])
def test_postings(spark, names):
    rows, proteins = some_proteins(spark, random.Random(names))
    want = {}
    for i, _, s in rows:
        for k in range(1, 4):
            for a in range(len(s) - k + 1):
                if "X" not in s[a : a + k]:
                    want.setdefault(s[a : a + k], set()).add(i)
    found = C.kmer_postings(proteins, 3, 1, names)
    assert max(r["n"] for r in found.collect()) <= names
    got = {}
    for r in C.posting_ids(found).collect():
        assert r["prot_id"] not in got.setdefault(r["kmer"], set())
        got[r["kmer"]].add(r["prot_id"])
    assert got == want
    asked = spark.createDataFrame([("A",), ("A",), ("CDE",), ("WWW",)], "kmer string")
    assert sorted(map(tuple, C.proteins_of(found, asked).collect())) == sorted((k, i) for k in ("A", "CDE") for i in want.get(k, ()))
    assert {r["kmer"]: r["prot_ids"] for r in C.merged_postings(found, 4).collect()} == {k: sorted(v) for k, v in want.items() if len(v) <= 4}


def test_postings_are_not_shuffled_as_kmers(spark):
    _, proteins = some_proteins(spark, random.Random(1))
    plan = C.kmer_postings(proteins, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(kmer" not in plan
    assert C.kmer_postings(proteins.limit(0), 3).collect() == []


def test_catalog_is_read_in_place(spark, tmp_path):
    rng = random.Random(2)
    _, proteins = some_proteins(spark, rng)
    table = kmers.kmer_masses(proteins, 5, 1)
    catalog = C.Catalog("peptura_test_catalog", buckets=8, part=50.0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        C.create_catalog(proteins, catalog, 5)
        spectra = spark.createDataFrame([("s", i, rng.uniform(150, 200), 1 + i % 2) for i in range(20)], "sample string, scan int, precursor_mz double, precursor_charge int")
        peaks = spark.createDataFrame([("s", rng.randrange(20), i, rng.uniform(150, 190)) for i in range(400)], "sample string, scan int, peak_id int, mz double")
        got = C.catalog_ion_match(peaks, spectra, catalog, 500.0)
        key = ["sample", "scan", "peak_id", "charge", "ion_type", "kmer"]
        want = sorted(map(tuple, peak_ion_match(peaks, spectra, table, 500.0).select(*key).collect()))
        assert len(want) > 20 and sorted(map(tuple, got.select(*key).collect())) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        scan = plan[plan.index("peptura_test_catalog") - 200 :]
        assert "SelectedBucketsCount: 8 out of 8" in scan
        # the scan stands below the join without an exchange
        lines = plan.split("\n")
        at = next(i for i, x in enumerate(lines) if "peptura_test_catalog" in x)
        join = max(i for i, x in enumerate(lines[:at]) if "SortMergeJoin" in x)
        depth = lambda x: re.search(r"[A-Z*]", x).start()
        above = [x for i, x in enumerate(lines[join + 1 : at]) if depth(x) < depth(lines[at]) and all(depth(y) > depth(x) for y in lines[join + 1 + i + 1 : at + 1])]
        assert above and not any("Exchange" in x for x in above)
        parts = {int(x) for x in re.search(r"mass_part#\d+ IN \(([\d,]+)\)", scan)[1].split(",")} if " IN (" in scan else set()
        assert parts and parts < {r[0] for r in catalog.rows(spark).select("mass_part").distinct().collect()} | parts
        every = spark.sql("show partitions peptura_test_catalog").count()
        assert len(parts & {r[0] for r in catalog.rows(spark).select("mass_part").distinct().collect()}) < every
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("drop table if exists peptura_test_catalog")


def test_database(spark, tmp_path):
    _, proteins = some_proteins(spark, random.Random(3), 5)
    catalog = C.Catalog("peptura_test_database", buckets=2)
    try:
        C.write_database(proteins, catalog, str(tmp_path / "postings"), 3, 2)
        assert sorted(r["kmer"] for r in catalog.rows(spark).collect()) == sorted(r["kmer"] for r in kmers.unique_kmers(proteins, 3, 2).collect())
        postings = spark.read.parquet(str(tmp_path / "postings"))
        assert {r[0] for r in postings.select("kmer").distinct().collect()} == {r["kmer"] for r in catalog.rows(spark).collect()}
    finally:
        spark.sql("drop table if exists peptura_test_database")
