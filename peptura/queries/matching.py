"""K-mers, the peak join, clusters and hybrids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import hybrids as H
from ..operators.clusters import cluster_filter as filter_clusters
from ..operators.clusters import clusters as make_clusters
from ..operators.clusters import extend_clusters as extend
from ..operators.clusters import pieces as make_pieces
from ..operators.ions import counted_matches as count_matches
from ..operators.ions import peak_ion_match as match_peaks
from ..operators.ions import position_ions as place_ions
from ..operators.ions import product_ions as make_ions
from ..operators.kmers import contains_seq as find_contained
from ..operators.kmers import kmer_counts_by_protein as count_kmers
from ..operators.kmers import kmer_table as make_table
from ..operators.kmers import kmer_to_proteins as map_kmers
from ..operators.kmers import kmers as make_kmers
from ..operators.kmers import proteins_by_name as pick_proteins
from ..operators.kmers import unique_kmers as distinct_kmers
from . import adapters as A
from . import query

JOINED = lambda c: F.array_join(c, ",")


@query(f"WITH {A.PROTEINS_RAW} SELECT kmer, count(*) AS n, min(start) AS first_start FROM {A.sql_kmers('proteins_raw', 2, 3, "NOT regexp_matches(kmer, '[BXUZOJ]')")} GROUP BY kmer")
def kmers(t):
    df = make_kmers(t.proteins_raw, 3, 2)
    return df.groupBy("kmer").agg(F.count("*").alias("n"), F.min("start").cast("long").alias("first_start"))


@query(f"WITH {A.PROTEINS} SELECT DISTINCT kmer FROM {A.sql_kmers('proteins', 2, 4)}")
def unique_kmers(t):
    return distinct_kmers(t.proteins, 4, 2)


@query(f"WITH {A.PROTEINS} SELECT kmer, count(DISTINCT name) AS n_proteins, string_agg(DISTINCT name, ',' ORDER BY name) AS proteins FROM {A.sql_kmers('proteins', 3, 4)} GROUP BY kmer")
def kmer_to_proteins(t):
    return map_kmers(t.proteins, 4, 3).select("kmer", F.size("proteins").cast("long").alias("n_proteins"), JOINED("proteins").alias("proteins"))


@query(f"WITH {A.PROTEINS} SELECT kmer, prot_id, count(*) AS n FROM {A.sql_kmers('proteins', 2, 3)} GROUP BY kmer, prot_id")
def kmer_counts_by_protein(t):
    return count_kmers(t.proteins, 3, 2)


@query(f"""WITH {A.PARTS}, {A.TABLE}, matches AS (SELECT kmer, proteins FROM tab), {A.PLACES} SELECT kmer, protein, string_agg(start, ',' ORDER BY start) AS starts FROM places GROUP BY ALL""")
def kmer_places(t):
    return t.places.select("kmer", "protein", F.array_join(F.col("starts").cast("array<string>"), ",").alias("starts"))


@query(f"WITH {A.PARTS}, {A.TABLE} SELECT kmer, round(aa_mass, 6) AS aa_mass, array_to_string(proteins, ',') AS proteins FROM tab")
def create_db(t):
    return make_table(t.parts, 6, 2).select("kmer", F.round("aa_mass", 6).alias("aa_mass"), JOINED("proteins").alias("proteins"))


@query(f"WITH {A.PROTEINS}, q(query) AS (SELECT DISTINCT left(seq, 5) FROM proteins UNION SELECT 'WWWWWW' UNION SELECT '') SELECT query FROM q WHERE EXISTS (SELECT 1 FROM proteins WHERE contains(seq, query))")
def contains_seq(t):
    q = t.proteins.select(F.left("seq", F.lit(5)).alias("query")).union(t.spark.createDataFrame([("WWWWWW",), ("",)], "query string")).distinct()
    return find_contained(t.proteins, q)


@query(f"WITH {A.PROTEINS} SELECT prot_id, name, md5(seq) AS seq_md5 FROM proteins WHERE name IN (SELECT 'doc|' || doc_id FROM labels WHERE quality = 1)")
def proteins_by_name(t):
    names = t["labels"].where("quality = 1").select(F.concat(F.lit("doc|"), F.col("doc_id").cast("string")).alias("name"))
    return pick_proteins(t.proteins, names).select("prot_id", "name", F.md5("seq").alias("seq_md5"))


@query(f"""WITH {A.PLANTED}, ions AS (
  SELECT pid, 'b' AS ion_type, left(left_seq || right_seq, n) AS ion_seq FROM planted, range(1, 13) r(n) WHERE n <= length(left_seq || right_seq)
  UNION ALL SELECT pid, 'y', right(left_seq || right_seq, n) FROM planted, range(1, 13) r(n) WHERE n <= length(left_seq || right_seq)
) SELECT pid, ion_type, ion_seq, z AS charge, round(CASE ion_type WHEN 'b' THEN ({A.sql_mass('ion_seq')} + z * {A.P}) / z ELSE ({A.sql_mass('ion_seq')} + {A.WATER} + z * {A.P}) / z END, 6) AS mz
FROM ions, range(1, 3) c(z)""")
def product_ions(t):
    df = make_ions(t.peptides, [1, 2], keep=("pid",))
    return df.select("pid", "ion_type", "ion_seq", F.col("charge").cast("long").alias("charge"), F.round("mz", 6).alias("mz"))


@query(f"""WITH {A.PARTS}, {A.TABLE}, {A.SPECTRA}, {A.PEAKS}, probes AS (
  SELECT p.sample, p.scan, peak_id, z.z AS charge, ion_type, z.z * (mz - mz * 20 / 1e6 - {A.P}) - off AS lo, z.z * (mz + mz * 20 / 1e6 - {A.P}) - off AS hi,
    precursor_charge * (precursor_mz - {A.P}) - {A.WATER} AS most
  FROM peaks p JOIN spectra s USING (sample, scan), range(1, 4) z(z), (VALUES ('b', 0.0::DOUBLE), ('y', {A.WATER}::DOUBLE)) t(ion_type, off) WHERE z.z <= precursor_charge
) SELECT sample, scan, peak_id, charge, ion_type, kmer FROM probes JOIN tab ON aa_mass BETWEEN lo AND hi AND aa_mass <= most""")
def peak_ion_match(t):
    df = match_peaks(t.peaks, t.spectra, t.masses)
    return df.select("sample", "scan", "peak_id", F.col("charge").cast("long").alias("charge"), "ion_type", "kmer")


def _matches(t):
    return match_peaks(t.peaks_theo, t.spectra_theo, t.masses)


def _ions(t):
    return place_ions(_matches(t), t.places)


def _clusters(t):
    return make_clusters(place_ions(count_matches(_matches(t)), t.places))


def _extended(t):
    return extend(filter_clusters(_clusters(t)), t.parts, t.spectra_theo)


def _hybrids(t):
    return H.hybrid_pairs(H.pieces_with_proteins(_extended(t)), t.spectra_theo)


@query(f'WITH {A.UP_TO_IONS} SELECT sample, scan, ion_type, kmer, protein, start, "end", count(*) AS n FROM ions GROUP BY ALL')
def position_ions(t):
    return _ions(t).groupBy("sample", "scan", "ion_type", "kmer", "protein", "start", "end").agg(F.count("*").alias("n"))


@query(f'WITH {A.UP_TO_IONS}, {A.CLUSTERS} SELECT sample, scan, ion_type, protein, anchor, support, start, "end", length FROM clus')
def clusters(t):
    return _clusters(t).drop("shortest")


@query(f'WITH {A.UP_TO_IONS}, {A.CLUSTERS}, {A.FILTERED} SELECT sample, scan, ion_type, protein, anchor, support FROM filt')
def cluster_filter(t):
    return filter_clusters(_clusters(t)).select("sample", "scan", "ion_type", "protein", "anchor", "support")


@query(f"WITH {A.UP_TO_EXTENDED} SELECT sample, scan, ion_type, protein, anchor, extended_seq FROM ext")
def extend_cluster(t):
    return _extended(t).select("sample", "scan", "ion_type", "protein", "anchor", "extended_seq")


@query(f"WITH {A.UP_TO_EXTENDED}, {A.PIECES} SELECT sample, scan, side, piece, count(*) AS n FROM piec GROUP BY ALL")
def pieces(t):
    return make_pieces(_extended(t)).groupBy("sample", "scan", "side", "piece").agg(F.count("*").alias("n"))


@query(f"WITH {A.UP_TO_EXTENDED}, {A.PIECES}, {A.PAIRED} SELECT sample, scan, side, piece, array_to_string(proteins, ',') AS proteins FROM sided")
def piece_proteins(t):
    return H.pieces_with_proteins(_extended(t)).withColumn("proteins", JOINED("proteins"))


@query(f"WITH {A.UP_TO_HYBRIDS} SELECT sample, scan, left_seq, right_seq, array_to_string(left_proteins, ',') AS left_proteins, array_to_string(right_proteins, ',') AS right_proteins FROM hyb")
def hybrid_pairs(t):
    return _hybrids(t).select("sample", "scan", "left_seq", "right_seq", JOINED("left_proteins").alias("left_proteins"), JOINED("right_proteins").alias("right_proteins"))


@query(f"WITH {A.UP_TO_HYBRIDS} SELECT sample, scan, left_seq, right_seq FROM hyb WHERE NOT EXISTS (SELECT 1 FROM parts WHERE contains(seq, left_seq || right_seq))")
def remove_native(t):
    return H.remove_contained(_hybrids(t), t.parts).select("sample", "scan", "left_seq", "right_seq")


@query(f"WITH {A.UP_TO_HYBRIDS} SELECT sample, scan, left_seq, right_seq FROM hyb WHERE left_seq || right_seq NOT IN (SELECT left(seq, n) FROM parts, range(4, 25) r(n))")
def remove_native_kmers(t):
    """By a table of k-mers: here those that proteins begin with."""
    kmers = t.parts.select(F.explode(F.transform(F.sequence(F.lit(4), F.lit(24)), lambda n: F.left("seq", n))).alias("kmer")).distinct()
    return H.remove_native(_hybrids(t), kmers).select("sample", "scan", "left_seq", "right_seq")


@query(f"""WITH {A.PROTEINS}, held AS (SELECT DISTINCT kmer, prot_id FROM {A.sql_kmers('proteins', 1, 2)})
SELECT kmer, count(*) AS n_proteins, min(prot_id) AS first, max(prot_id) AS last, CAST(sum(prot_id) AS BIGINT) AS total, true AS bounded FROM held GROUP BY kmer""")
def kmer_postings(t):
    """All proteins of every k-mer, whole documents and single letters included, in rows of bounded size."""
    ids = C.posting_ids(C.kmer_postings(t.proteins, 2), keep=("n",))
    return ids.groupBy("kmer").agg(
        F.count("*").alias("n_proteins"), F.min("prot_id").alias("first"), F.max("prot_id").alias("last"), F.sum("prot_id").alias("total"),
        (F.max("n") <= C.BLOCK_NAMES).alias("bounded"),
    )


_DOCUMENT_PROBES = f"""probes AS (
  SELECT p.sample, p.scan, peak_id, z.z AS charge, ion_type, z.z * (mz - mz * 20 / 1e6 - {A.P}) - off AS lo, z.z * (mz + mz * 20 / 1e6 - {A.P}) - off AS hi,
    precursor_charge * (precursor_mz - {A.P}) - {A.WATER} AS most
  FROM peaks p JOIN spectra s USING (sample, scan), range(1, 4) z(z), (VALUES ('b', 0.0::DOUBLE), ('y', {A.WATER}::DOUBLE)) t(ion_type, off) WHERE z.z <= precursor_charge)"""


@query(f"""WITH {A.PROTEINS}, tab AS MATERIALIZED (SELECT kmer, {A.sql_mass('kmer')} AS aa_mass FROM (SELECT DISTINCT kmer FROM {A.sql_kmers('proteins', 2, 3)})), {A.SPECTRA}, {A.PEAKS}, {_DOCUMENT_PROBES}
SELECT sample, scan, peak_id, charge, ion_type, count(*) AS n, min(kmer) AS first FROM probes JOIN tab ON aa_mass BETWEEN lo AND hi AND aa_mass <= most GROUP BY ALL""")
def catalog_ion_match(t):
    """The peak join against a catalog of the documents' k-mers, written as a table and read in place."""
    catalog = C.Catalog(t.table_name(), buckets=max(8, int(t.spark.conf.get("spark.sql.shuffle.partitions"))))
    C.create_catalog(t.proteins, catalog, 3, 2)
    found = C.catalog_ion_match(t.peaks, t.spectra, catalog)
    return found.groupBy("sample", "scan", "peak_id", F.col("charge").cast("long").alias("charge"), "ion_type").agg(F.count("*").alias("n"), F.min("kmer").alias("first"))


@query(f"WITH {A.UP_TO_HYBRIDS} SELECT sample, scan, left_seq || right_seq AS seq, string_agg(DISTINCT left_seq || '-' || right_seq, ',' ORDER BY left_seq || '-' || right_seq) AS forms FROM hyb GROUP BY 1, 2, 3")
def hybrids_by_sequence(t):
    return H.hybrids_by_sequence(_hybrids(t)).withColumn("forms", JOINED("forms"))


@query(f"""WITH {A.UP_TO_HYBRIDS} SELECT DISTINCT 'hybrid_' || left_seq || '-' || right_seq AS name,
  'left-prots:' || array_to_string(left_proteins, ',') || ';right-prots:' || array_to_string(right_proteins, ',') AS description, left_seq || right_seq AS seq FROM hyb
  UNION ALL SELECT name, '', seq FROM parts""")
def create_hybrids_fasta(t):
    return H.hybrids_fasta(_hybrids(t)).distinct().unionByName(t.parts.select("name", F.lit("").alias("description"), "seq"))


@query(f"""WITH {A.PLANTED}, {A.TABLE}, cut AS (
  SELECT pid, left(left_seq || right_seq, n) AS left_seq, substr(left_seq || right_seq, n + 1) AS right_seq FROM planted, range(1, 12) r(n) WHERE n < length(left_seq || right_seq)
) SELECT pid, left_seq, right_seq, array_to_string(l.proteins, ',') AS left_proteins, array_to_string(r.proteins, ',') AS right_proteins
FROM cut JOIN tab l ON l.kmer = left_seq JOIN tab r ON r.kmer = right_seq""")
def possible_hybrids(t):
    df = H.possible_hybrids(t.peptides.select("pid", "seq"), t.table)
    return df.select("pid", "left_seq", "right_seq", JOINED("left_proteins").alias("left_proteins"), JOINED("right_proteins").alias("right_proteins"))


@query(f"""WITH {A.PLANTED}, {A.TABLE} SELECT pid FROM planted WHERE EXISTS (
  SELECT 1 FROM range(2, 11) r(n) WHERE n <= length(left_seq || right_seq) - 2 AND left(left_seq || right_seq, n) IN (SELECT kmer FROM tab) AND substr(left_seq || right_seq, n + 1) IN (SELECT kmer FROM tab))""")
def hybrids_by_side_length(t):
    return H.possible_hybrids(t.peptides.select("pid", "seq"), t.table, 2).select("pid").distinct()


@query(f"WITH {A.PLANTED} SELECT pid, left(left_seq || right_seq, n) AS left_seq, substr(left_seq || right_seq, n + 1) AS right_seq FROM planted, range(3, 12) r(n) WHERE n <= length(left_seq || right_seq) - 3")
def split_points(t):
    return H.split_points(t.peptides.select("pid", "seq"), 3).select("pid", "left_seq", "right_seq")
