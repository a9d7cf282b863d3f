"""SQLite files, folds, densities and the stream of clusters."""

import datetime
import math
import random
import sqlite3

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peptura.operators import folds, kmers
from peptura.operators import spectra as S
from peptura.operators.clusters import clusters
from peptura.operators.ions import peak_ion_match, position_ions
from peptura.functions.masses import PROTON_MASS, RESIDUES
from peptura.sources import sqlite
from peptura.streaming.clusters import stream_clusters


def test_sqlite_files(spark, tmp_path):
    at = str(tmp_path / "a b#.db")
    db = sqlite3.connect(at)
    db.execute('CREATE TABLE kmers (seq VARCHAR(9), mass DOUBLE, n INTEGER, raw BLOB, "odd name" NUMERIC, free)')
    db.execute("CREATE INDEX by_mass ON kmers (mass)")
    db.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, v INT) WITHOUT ROWID")
    db.execute("CREATE TABLE none (x INT)")
    db.execute("CREATE VIEW heavy AS SELECT seq, mass FROM kmers WHERE mass > 50")
    rows = [(f"K{i}", i * 0.5, i, bytes([i % 256]), i / 4, None if i % 2 else str(i)) for i in range(1000)] + [(None,) * 6, ("x", 7, "12", b"", 3, 4.5)]
    db.executemany("INSERT INTO kmers VALUES (?, ?, ?, ?, ?, ?)", rows)
    db.execute("DELETE FROM kmers WHERE n BETWEEN 300 AND 700")  # row numbers with gaps
    db.executemany("INSERT INTO keyed VALUES (?, ?)", [("b", 2), ("a", 1)])
    db.commit()
    db.close()
    df = sqlite.sqlite_scan(spark, at, "kmers", 7)
    assert df.dtypes == [("seq", "string"), ("mass", "double"), ("n", "bigint"), ("raw", "binary"), ("odd name", "double"), ("free", "string")]
    assert df.rdd.getNumPartitions() == 7
    want = [r for r in rows[:1000] if not 300 <= r[2] <= 700] + [(None,) * 6, ("x", 7.0, 12, b"", 3.0, "4.5")]
    assert sorted(((r[0], r[1], r[2], r[3] and bytes(r[3]), r[4], r[5]) for r in df.collect()), key=str) == sorted(((r[0], r[1], r[2], r[3] and bytes(r[3]), r[4], r[5]) for r in want), key=str)
    assert [tuple(r) for r in sqlite.sqlite_scan(spark, at, "keyed").orderBy("k").collect()] == [("a", 1), ("b", 2)]
    assert sqlite.sqlite_scan(spark, at, "none").collect() == [] and sqlite.sqlite_scan(spark, at, "heavy").count() == df.where("mass > 50").count()
    assert sqlite.sqlite_query(spark, f"file://{at}", "SELECT v FROM keyed WHERE k = 'b'").collect()[0]["v"] == 2
    assert sqlite.sqlite_tables(at) == ["keyed", "kmers", "none"] and "by_mass" in sqlite.sqlite_indices(at)
    with pytest.raises(Exception, match="no such table"):
        sqlite.sqlite_scan(spark, at, "nothing").collect()
    with pytest.raises(Exception, match="FileNotFound|nowhere"):
        sqlite.sqlite_scan(spark, str(tmp_path / "nowhere.db"), "kmers").collect()


def test_sqlite_is_written_by_one_task(spark, tmp_path):
    df = spark.range(25_000).selectExpr("id", "cast(id as string) name", "id / 3.0D ratio", "id % 2 = 0 even", "cast(null as binary) none").repartition(6)
    at = str(tmp_path / "out" / "x.db")
    assert sqlite.write_sqlite(df, at, "rows", ["name"]) == 25_000 == sqlite.write_sqlite(df, at, "rows")
    back = sqlite.sqlite_scan(spark, at, "rows", 4)
    assert back.dtypes == [("id", "bigint"), ("name", "string"), ("ratio", "double"), ("even", "bigint"), ("none", "binary")]
    assert back.agg(F.count_distinct("id"), F.sum("even"), F.sum("id")).first() == (25_000, 12_500, sum(range(25_000)))
    assert sqlite.write_sqlite(df.limit(0), str(tmp_path / "empty.db"), "rows") == 0
    with pytest.raises(TypeError):
        sqlite.write_sqlite(spark.createDataFrame([([1],)], "a array<int>"), at, "rows")


def test_folds(spark):
    rng = random.Random(1)
    rows = [(i % 5, rng.randrange(9)) for i in range(400)] + [(7, None), (8, 3), (8, None)]
    df = spark.createDataFrame(rows, "g int, v int")
    product = lambda a: math.prod(x + 1 for x in a.to_pylist()) % 1_000_003
    of = lambda g: [v for h, v in rows if h == g and v is not None]
    want = {g: math.prod(v + 1 for v in of(g)) % 1_000_003 if of(g) else None for g in {g for g, _ in rows}}
    assert {r["g"]: r["v"] for r in folds.fold_of(df, ["g"], "v", product, "bigint").collect()} == want
    folds.register_fold(spark, "peptura_product", product, "bigint")
    df.createOrReplaceTempView("peptura_folds")
    assert {r["g"]: r["p"] for r in spark.sql("SELECT g, peptura_product(v) p FROM peptura_folds GROUP BY g").collect()} == want
    import pyarrow.compute as pc

    most = folds.arg_fold_of(df, ["g"], "v", pc.max, "int")
    assert sorted(map(tuple, most.collect())) == sorted((g, v) for g, v in rows if v is not None and v == max(of(g)))
    assert isinstance(pc.max(pa.array([1])), pa.Scalar) and folds.fold_of(df.limit(0), ["g"], "v", product, "bigint").collect() == []


def test_density(spark):
    rng = random.Random(2)
    values = [rng.gauss(10, 2) for _ in range(300)] + [rng.gauss(30, 1) for _ in range(100)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [(r["x"], r["density"]) for r in S.density(df, "v", points=50, bins=4096).orderBy("x").collect()]
    own = [v for v in values if v is not None]
    mean = sum(own) / len(own)
    h = len(own) ** -0.2 * math.sqrt(sum((v - mean) ** 2 for v in own) / (len(own) - 1)) * 2
    assert len(got) == 50 and got[0][0] == min(own) and got[-1][0] == pytest.approx(max(own))
    for x, d in got:
        assert d == pytest.approx(sum(math.exp(-0.5 * ((x - v) / h) ** 2) for v in own) / (len(own) * h * math.sqrt(2 * math.pi)), rel=1e-4)
    assert S.density(df.where("v is null"), "v").collect() == [] == S.density(df.limit(1), "v").collect()


def test_stream_of_clusters_with_late_peaks(spark, tmp_path):
    proteins = spark.createDataFrame([(0, "p", "ACDEFGHIKACD"), (1, "q", "ACDW")], "prot_id int, name string, seq string")
    table, places = kmers.kmer_masses(proteins, 4, 2), kmers.kmer_places(proteins, 4, 2)
    spectra = spark.createDataFrame([("s", i, 400.0 + i, 2) for i in range(4)], "sample string, scan long, precursor_mz double, precursor_charge int")
    mass = lambda s: sum(RESIDUES[c] for c in s) + PROTON_MASS
    at = lambda minute: datetime.datetime(2024, 1, 1, 12, 0) + datetime.timedelta(minutes=minute)
    files = [
        [("s", 0, 0, mass("AC"), at(0)), ("s", 1, 0, mass("AC"), at(1)), ("s", 0, 1, mass("ACD"), at(2))],
        [("s", 1, 1, mass("CD"), at(9)), ("s", 0, 2, mass("ACDE"), at(4)), ("s", 2, 0, mass("DE"), at(10))],  # late, but not too late
        [("s", 3, 0, mass("AC"), at(60))],  # the watermark passes the first ones
        [("s", 0, 3, mass("CD"), at(3)), ("s", 3, 1, mass("ACD"), at(61))],  # too late: dropped
        [("s", 3, 2, 1.0, at(200)), ("none", 2, 9, mass("AC"), at(200))],
        [("none", 9, 0, 1.0, at(900))],
    ]
    schema = "sample string, scan long, peak_id long, mz double, time timestamp"
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "peaks"))
        import os
        import time

        for f in (tmp_path / "peaks").glob("*.parquet"):  # read in the order of writing
            if f.stat().st_mtime > 2_000_000_000 - 1 or "seen" in f.name:
                continue
            os.utime(f, (1_700_000_000 + i * 10,) * 2)
            f.rename(f.with_name(f"seen-{i}-{f.name}"))
        time.sleep(0)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "peaks"))
    q = stream_clusters(stream, spectra, table, places).writeStream.format("memory").queryName("peptura_clusters").outputMode("append")
    q = q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    columns = ["sample", "scan", "ion_type", "protein", "anchor", "support", "start", "end", "shortest", "length"]
    got = sorted(map(tuple, spark.table("peptura_clusters").select(*columns).collect()))
    # a batch over what was not too late, for the spectra that were closed
    kept = [r for rows in (files[0], files[1], [files[2][0]], [files[3][1]]) for r in rows]
    batch = spark.createDataFrame(kept, schema)
    want = clusters(position_ions(peak_ion_match(batch, spectra, table), places)).select(*columns)
    want = sorted(map(tuple, want.collect()))
    closed = {r[1] for r in got}
    assert {0, 1} <= closed and got == [r for r in want if r[1] in closed]
    assert any(r[5] > 1 for r in got)
