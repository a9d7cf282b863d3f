"""Readers and writers: the driver's tables written as files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import fasta, tables
from . import adapters as A
from . import query

JOINED = lambda c: F.array_join(c, ",")


@query(f"WITH {A.PARTS} SELECT name, 'of ' || prot_id AS description, seq FROM parts")
def scan_fasta(t):
    at = t.folder("fasta")
    fasta.write_fasta(t.parts.select("name", F.concat(F.lit("of "), F.col("prot_id").cast("string")).alias("description"), "seq"), at)
    return fasta.scan_fasta(t.spark, at).select("name", "description", "seq")


@query(f"WITH {A.PARTS} SELECT DISTINCT seq FROM parts")
def fasta_seqs(t):
    at = t.folder("fasta-seqs")
    fasta.write_fasta(t.parts.select("name", F.lit("").alias("description"), "seq"), at)
    return fasta.scan_fasta(t.spark, at).select("seq").distinct()


def _results(t, name, where="true"):
    """Matches as a result table of the search program, written as text."""
    at = t.folder(name)
    df = t.psms.where(where).select(
        F.concat("sample", F.lit(".comet.target.txt")).alias("file"), F.col("scan"), F.col("score").alias("xcorr score"), F.col("num").alias("xcorr rank"),
        F.col("seq").alias("sequence"), JOINED("proteins").alias("protein id"), F.col("eval").alias("tdc q-value"),
    )
    df.write.mode("overwrite").option("header", "true").option("sep", "\t").option("quote", "").csv(at)
    return at


@query(f"WITH {A.PSMS} SELECT sample, scan, score AS xcorr, num, seq, array_to_string(proteins, ',') AS proteins, eval AS q_value FROM psms WHERE seq <> ''")
def scan_psms(t):
    df = tables.scan_psms(t.spark, _results(t, "psms", "seq <> ''"))
    return df.select("sample", "scan", "xcorr", "num", "seq", JOINED("proteins").alias("proteins"), "q_value")


@query(f"WITH {A.PSMS} SELECT sample, scan, score AS xcorr FROM psms WHERE seq <> '' AND eval <= 2.5")
def load_comet_psms(t):
    at = t.folder("confidence")
    t.spark.read.text(_results(t, "confidence/assign-confidence.target.txt", "seq <> ''"))
    return tables.load_comet_psms(t.spark, at, most_q=2.5).select("sample", "scan", "xcorr")


@query(f"WITH {A.PSMS} SELECT sample, scan, score AS xcorr FROM psms WHERE seq <> '' AND num <= 1")
def load_top_psms(t):
    at = t.folder("ranked")
    _results(t, "ranked/a.comet.target.txt", "seq <> '' and psm_id % 2 = 0")
    _results(t, "ranked/b.comet.target.txt", "seq <> '' and psm_id % 2 = 1")
    return tables.load_comet_psms(t.spark, at, top_n=1).select("sample", "scan", "xcorr")


@query(f"WITH {A.PSMS} SELECT sample, scan, score AS xcorr FROM psms WHERE seq <> ''")
def combine_scan_files(t):
    parts = [_results(t, f"scans/{i}", f"seq <> '' and psm_id % 2 = {i}") for i in range(2)]
    out = t.folder("combined")
    tables.combine_scan_files(t.spark, parts, out)
    return tables.scan_psms(t.spark, out).select("sample", "scan", "xcorr")


@query(f"WITH {A.PSMS} SELECT 'native' AS run, scan, score AS xcorr FROM psms WHERE seq <> '' AND scan = 7 AND event_parity = 0 UNION ALL SELECT 'hybrid', scan, score FROM psms WHERE seq <> '' AND scan = 7 AND event_parity = 1".replace("event_parity", "psm_id % 3 // 2"))
def get_scan_results(t):
    native, hybrid = (_results(t, f"runs/{k}", f"seq <> '' and psm_id % 3 div 2 = {k}") for k in range(2))
    native, hybrid = tables.get_scan_results(t.spark, native, hybrid, "s", 7)
    return native.select(F.lit("native").alias("run"), "scan", "xcorr").union(hybrid.select(F.lit("hybrid"), "scan", "xcorr"))


@query(f"WITH {A.PARTS}, {A.TABLE} SELECT kmer, array_to_string(proteins, ',') AS proteins FROM tab")
def kmer_map_load(t):
    at = t.folder("kmers.json")
    tables.save_kmer_map(t.table.select("kmer", "proteins"), at)
    return tables.load_kmer_map(t.spark, at).select("kmer", JOINED("proteins").alias("proteins"))


@query(f"WITH {A.PARTS} SELECT name AS value FROM parts")
def read_lines(t):
    at = t.folder("names.txt")
    tables.write_table(t.parts.select("name"), at, "lines")
    return tables.read_lines(t.spark, at)


@query(f"WITH {A.PSMS} SELECT length(prefix) AS length, prefix, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(seq) + 1), lambda i: left(seq, i))) AS prefix FROM psms) GROUP BY 2, 1")
def prefix_counts_json(t):
    from ..operators.psms import prefix_counts_by_length

    at = t.folder("prefixes.json")
    tables.prefix_counts_json(prefix_counts_by_length(t.psms), at)
    df = t.spark.read.schema("length long, prefixes array<struct<prefix:string,n:long>>").json(at)
    return df.select("length", F.inline("prefixes"))


@query(f"WITH {A.UP_TO_HYBRIDS} SELECT sample, scan, left_seq || right_seq AS seq, count(*) AS n FROM hyb GROUP BY ALL")
def hybrids_json(t):
    from .matching import _hybrids

    at = t.folder("hybrids.json")
    tables.hybrids_json(_hybrids(t), at)
    df = t.spark.read.schema("sample string, scan long, seq string, hybrids array<struct<left_seq:string,right_seq:string>>").json(at)
    return df.select("sample", "scan", "seq", F.size("hybrids").cast("long").alias("n"))


@query(f"WITH {A.PARTS} SELECT 'id' || prot_id AS identifier, replace(name, '|', '_') AS name, seq FROM parts")
def scan_fasta_legacy(t):
    at = t.folder("fasta-old")
    fasta.write_fasta_legacy(t.parts.withColumn("name", F.replace("name", F.lit("|"), F.lit("_"))), at)
    return fasta.scan_fasta_legacy(t.spark, at).select("identifier", "name", "seq")


@query(f"WITH {A.PSMS} SELECT sample, count(*) AS n FROM psms WHERE is_decoy GROUP BY sample")
def read_query(t):
    t.psms.createOrReplaceTempView("peptura_psms")
    return tables.read_query(t.spark, "SELECT sample, count(*) AS n FROM peptura_psms WHERE is_decoy GROUP BY sample")


@query(f"""WITH {A.PLANTED}, {A.TABLE}, m AS (SELECT pid AS psm_id, left_seq || right_seq AS seq FROM planted WHERE pid % 3 <> 0 AND pid % 5 <> 0)
SELECT psm_id, left(seq, n) AS left_seq, array_to_string(l.proteins, '/') AS left_proteins FROM m, range(2, 11) r(n) JOIN tab l ON l.kmer = left(seq, n)
WHERE n <= length(seq) - 2 AND substr(seq, n + 1) IN (SELECT kmer FROM tab)""")
def hybrids_csv(t):
    from ..operators.psms import save_hybrids

    p, at = F.col("pid"), t.folder("hybrids.csv")
    name = F.when(p % 3 == 0, F.array(F.lit("part|1"))).otherwise(F.array(F.lit("hybrid_A-B")))
    psms = t.peptides.select(p.alias("psm_id"), "sample", "scan", "seq", name.alias("proteins"), F.when(p % 5 == 0, 0.02).otherwise(0.01).alias("q_value"))
    tables.write_table(save_hybrids(psms, t.table, 0.01, 2), at, "csv")
    df = t.spark.read.option("header", "true").csv(at)
    return df.select(F.col("psm_id").cast("long").alias("psm_id"), "left_seq", "left_proteins")

