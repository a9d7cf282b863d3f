"""The driver's tables as proteins, spectra, peaks and matches: the same definition in Spark and in SQL. Whole tables."""

from __future__ import annotations

import atexit
import shutil
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.masses import PROTON_MASS, RESIDUES, WATER_MASS, aa_mass
from ..operators.dealing import dealt, few


def clean(text, drop: str = "[BJOUXZ]"):
    return F.regexp_replace(F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", "")), drop, "")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def own(self) -> str:
        return uuid.uuid4().hex

    def folder(self, name: str) -> str:
        """A place for files: in the folder that spark.checkpoint.dir names, or in the warehouse. Without the first, a session
        on a cluster is refused, as its warehouse may be a folder of the driver's machine. Folders of a local session are
        deleted when it ends."""
        root = self.spark.sparkContext.getCheckpointDir() or self.spark.conf.get("spark.checkpoint.dir", None)
        local = self.spark.sparkContext.master.startswith("local")
        if not root and not local:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"{(root or self.spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/peptura-files-{self.own}"
        if local:
            atexit.register(shutil.rmtree, at.removeprefix("file:"), ignore_errors=True)
        return f"{at}/{name}"

    def table_name(self) -> str:
        return f"peptura_{self.own}"

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def documents_as(self, drop: str) -> DataFrame:
        return self["documents"].select(F.col("doc_id").alias("prot_id"), F.concat(F.lit("doc|"), F.col("doc_id").cast("string")).alias("name"), clean(F.col("text"), drop).alias("seq"))

    @cached_property
    def proteins(self) -> DataFrame:
        return self.documents_as("[BJOUXZ]")

    @cached_property
    def proteins_raw(self) -> DataFrame:
        return self.documents_as("[^A-Z]")

    @cached_property
    def parts(self) -> DataFrame:
        """Distinct short proteins made of part names: prot_id, name, seq, i (0-based place)."""
        seq = clean(F.concat("p_name", "p_type", "p_brand"))
        df = self["part"].select("p_partkey", seq.alias("seq")).groupBy("seq").agg(F.min("p_partkey").alias("prot_id"))
        df = df.where("seq <> ''").withColumn("i", F.row_number().over(W.orderBy("prot_id")) - 1)  # a few hundred distinct names
        return few(df.select("prot_id", F.concat(F.lit("part|"), F.col("prot_id").cast("string")).alias("name"), "seq", F.col("i").cast("long").alias("i")))

    @cached_property
    def spectra(self) -> DataFrame:
        k = F.col("o_orderkey")  # four samples, with the same scan numbers
        return self["orders"].select(F.concat(F.lit("s"), (k % 4).cast("string")).alias("sample"), F.expr("o_orderkey div 4").alias("scan"), F.round(300 + F.col("o_totalprice") / 500, 6).alias("precursor_mz"), (1 + k % 3).cast("int").alias("precursor_charge"))

    @cached_property
    def peaks(self) -> DataFrame:
        w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        sample = F.concat(F.lit("s"), (F.col("l_orderkey") % 4).cast("string"))
        return self["lineitem"].select(sample.alias("sample"), F.expr("l_orderkey div 4").alias("scan"), F.row_number().over(w).cast("long").alias("peak_id"), F.round(50 + F.col("l_extendedprice") / 70, 6).alias("mz"), F.col("l_quantity").alias("intensity"))

    @cached_property
    def peak_lists(self) -> DataFrame:
        """Spectra with their peaks as arrays, as readers give them."""
        peak = F.struct(F.col("peak_id").cast("int").alias("id"), "mz", "intensity")
        return self.spectra.join(self.peaks.groupBy("sample", "scan").agg(F.sort_array(F.collect_list(peak)).alias("peaks")), ["sample", "scan"])

    @cached_property
    def psms(self) -> DataFrame:
        e = F.col("event_id")
        part = lambda n: F.concat(F.lit("part|"), (e % n).cast("string"))
        proteins = F.when(e % 3 == 0, F.array(part(40))).when(e % 3 == 1, F.array(part(40), part(7))).otherwise(F.array(F.concat(F.lit("hybrid_"), "event_type"), F.lit("hybrid_x")))
        return self["events"].select(
            e.alias("psm_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sample"), (e % 500).alias("scan"), F.col("value").alias("score"),
            (F.col("event_type") == "error").alias("is_decoy"), clean(F.concat("event_type", "props")).alias("seq"), proteins.alias("proteins"),
            (1 + e % 2).cast("int").alias("num"), ((e * 7919) % 1000 / 100.0).alias("eval"), (e % 23).cast("int").alias("ions_matched"),
        )

    @cached_property
    def planted(self) -> DataFrame:
        """pid, sample, scan, left_seq, right_seq: pieces of two part proteins for each supplier. Two samples, with the same
        scan numbers."""
        n = self.parts.agg(F.count("*").alias("n"))
        j = F.col("s_suppkey")
        df = self["supplier"].crossJoin(F.broadcast(n)).select(j.alias("pid"), (j % F.col("n")).alias("li"), ((j + 7) % F.col("n")).alias("ri"), (j % 3).cast("int").alias("off"))
        side = lambda x: self.parts.select(F.col("i").alias(f"{x}i"), F.col("seq").alias(f"{x}seq"))
        df = df.join(side("l"), "li").join(side("r"), "ri")
        where = F.concat(F.lit("s"), (F.col("pid") % 2).cast("string")).alias("sample"), F.expr("pid div 2").alias("scan")
        # of every fifth one the right piece follows the left one in the same protein
        right = F.when((F.col("pid") % 5 == 0) & (F.length("lseq") >= 14), F.substring("lseq", F.col("off") + 7, F.lit(6))).otherwise(F.substring("rseq", F.lit(4), F.lit(6)))
        df = df.select("pid", *where, F.substring("lseq", F.col("off") + 1, F.lit(6)).alias("left_seq"), right.alias("right_seq"))
        # a small file is one partition, but its rows meet thousands of k-mers each
        return dealt(df, self["supplier"].count(), "sample", "scan")

    @cached_property
    def spectra_theo(self) -> DataFrame:
        mz = F.round((aa_mass(F.col("left_seq")) + aa_mass(F.col("right_seq")) + WATER_MASS) / 2 + PROTON_MASS, 6)
        return self.planted.select("sample", "scan", mz.alias("precursor_mz"), F.lit(2).alias("precursor_charge"))

    @cached_property
    def peaks_theo(self) -> DataFrame:
        def of(kind: str, side: str, k: int):
            ion, more = (F.left, PROTON_MASS) if kind == "b" else (F.right, WATER_MASS + PROTON_MASS)
            return F.struct(F.lit(kind).alias("t"), F.lit(k).alias("k"), F.round(aa_mass(ion(side, F.lit(k))) + more, 6).alias("mz"))

        df = self.planted.select("sample", "scan", F.inline(F.array(*[of(t, s, k) for t, s in (("b", "left_seq"), ("y", "right_seq")) for k in range(2, 6)])))
        rn = F.row_number().over(W.partitionBy("sample", "scan").orderBy("t", "k")).cast("long")
        return df.select("sample", "scan", rn.alias("peak_id"), "mz", (10.0 * F.col("k")).alias("intensity"))

    @cached_property
    def peptides(self) -> DataFrame:
        """pid, sample, scan, seq, left_seq, right_seq: the planted hybrid of every spectrum."""
        return self.planted.select("pid", "sample", "scan", F.concat("left_seq", "right_seq").alias("seq"), "left_seq", "right_seq")

    @cached_property
    def table(self) -> DataFrame:
        """K-mers of the part proteins with masses and proteins."""
        from ..operators.kmers import kmer_table

        return kmer_table(self.parts, 6, 2)

    @cached_property
    def masses(self) -> DataFrame:
        """The same k-mers with masses alone."""
        from ..operators.kmers import kmer_masses

        return kmer_masses(self.parts, 6, 2)

    @cached_property
    def places(self) -> DataFrame:
        """The same k-mers with their places."""
        from ..operators.kmers import kmer_places

        return kmer_places(self.parts, 6, 2)


P, WATER = repr(PROTON_MASS), repr(WATER_MASS)


def sql_clean(text: str, drop: str = "[BJOUXZ]") -> str:
    return f"regexp_replace(upper(regexp_replace(coalesce({text}, ''), '[^A-Za-z]', '', 'g')), '{drop}', '', 'g')"


_CASE = " ".join(f"WHEN '{c}' THEN {round(m * 10**7)}" for c, m in RESIDUES.items())


def sql_mass(seq: str) -> str:
    return f"(coalesce(list_sum(list_transform(string_split({seq}, ''), lambda c: CASE c {_CASE} END)), 0)::BIGINT / 1e7)"


def sql_kmers(proteins: str, lo: int, hi: int, where: str = "true") -> str:
    return f"""(SELECT prot_id, name, substr(seq, s + 1, k) AS kmer, s AS start, k FROM (
      SELECT prot_id, name, seq, k, unnest(range(greatest(length(seq) - k + 1, 0))) AS s FROM {proteins}, range({lo}, {hi + 1}) r(k)
    ) WHERE {where})"""


PROTEINS = f"proteins AS (SELECT doc_id AS prot_id, 'doc|' || doc_id AS name, {sql_clean('text')} AS seq FROM documents)"
PROTEINS_RAW = f"proteins_raw AS (SELECT doc_id AS prot_id, 'doc|' || doc_id AS name, {sql_clean('text', '[^A-Z]')} AS seq FROM documents)"
PARTS = f"""parts AS (SELECT prot_id, 'part|' || prot_id AS name, seq, row_number() OVER (ORDER BY prot_id) - 1 AS i FROM (
    SELECT {sql_clean("p_name || p_type || p_brand")} AS seq, min(p_partkey) AS prot_id FROM part GROUP BY 1) WHERE seq <> '')"""
SPECTRA = "spectra AS (SELECT 's' || (o_orderkey % 4) AS sample, o_orderkey // 4 AS scan, round(300 + o_totalprice / 500, 6) AS precursor_mz, CAST(1 + o_orderkey % 3 AS INTEGER) AS precursor_charge FROM orders)"
PEAKS = "peaks AS (SELECT 's' || (l_orderkey % 4) AS sample, l_orderkey // 4 AS scan, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS peak_id, round(50 + l_extendedprice / 70, 6) AS mz, l_quantity AS intensity FROM lineitem)"
PSMS = f"""psms AS (SELECT event_id AS psm_id, 'u' || user_id AS sample, event_id % 500 AS scan, value AS score, event_type = 'error' AS is_decoy,
    {sql_clean("event_type || props")} AS seq,
    CASE event_id % 3 WHEN 0 THEN ['part|' || (event_id % 40)] WHEN 1 THEN ['part|' || (event_id % 40), 'part|' || (event_id % 7)] ELSE ['hybrid_' || event_type, 'hybrid_x'] END AS proteins,
    CAST(1 + event_id % 2 AS INTEGER) AS num, ((event_id * 7919) % 1000) / 100.0::DOUBLE AS eval, CAST(event_id % 23 AS INTEGER) AS ions_matched FROM events)"""
PLANTED = f"""{PARTS}, planted AS (SELECT s_suppkey AS pid, 's' || (s_suppkey % 2) AS sample, s_suppkey // 2 AS scan, substr(l.seq, 1 + s_suppkey % 3, 6) AS left_seq,
    CASE WHEN s_suppkey % 5 = 0 AND length(l.seq) >= 14 THEN substr(l.seq, 7 + s_suppkey % 3, 6) ELSE substr(r.seq, 4, 6) END AS right_seq
    FROM supplier, (SELECT count(*) AS n FROM parts) c, parts l, parts r WHERE l.i = s_suppkey % n AND r.i = (s_suppkey + 7) % n)"""
THEO = f"""{PLANTED}, spectra_theo AS (SELECT sample, scan, round(({sql_mass('left_seq')} + {sql_mass('right_seq')} + {WATER}) / 2 + {P}, 6) AS precursor_mz, 2 AS precursor_charge FROM planted),
  peaks_theo AS (SELECT sample, scan, row_number() OVER (PARTITION BY sample, scan ORDER BY t, k) AS peak_id, mz, 10.0 * k AS intensity FROM (
    SELECT sample, scan, 'b' AS t, k, round({sql_mass('left(left_seq, k)')} + {P}, 6) AS mz FROM planted, range(2, 6) r(k)
    UNION ALL SELECT sample, scan, 'y', k, round({sql_mass('right(right_seq, k)')} + {WATER} + {P}, 6) FROM planted, range(2, 6) r(k)))"""
TABLE = f"""tab AS MATERIALIZED (SELECT kmer, {sql_mass('kmer')} AS aa_mass, list_sort(list(DISTINCT name)) AS proteins FROM {sql_kmers('parts', 2, 6)} GROUP BY kmer)"""
MATCHES = f"""matches AS MATERIALIZED (SELECT q.*, kmer, proteins FROM (
    SELECT p.sample, p.scan, peak_id, mz, z.z AS charge, ion_type, z.z * (mz - mz * 20 / 1e6 - {P}) - off AS lo, z.z * (mz + mz * 20 / 1e6 - {P}) - off AS hi,
      precursor_charge * (precursor_mz - {P}) - {WATER} AS most
    FROM peaks_theo p JOIN spectra_theo s USING (sample, scan), range(1, 3) z(z), (VALUES ('b', 0.0::DOUBLE), ('y', {WATER}::DOUBLE)) t(ion_type, off) WHERE z.z <= precursor_charge
  ) q JOIN tab ON aa_mass BETWEEN lo AND hi AND aa_mass <= most)"""
#: Non-overlapping places, from the left, of every distinct (k-mer, protein).
PLACES = """places AS MATERIALIZED (SELECT kmer, protein, CAST(unnest(list_reduce([[]::INTEGER[]] || list_transform(
      list_filter(range(1, length(seq) - length(kmer) + 2), lambda i: substr(seq, i, length(kmer)) = kmer), lambda i: [CAST(i - 1 AS INTEGER)]),
      lambda a, x: CASE WHEN len(a) = 0 OR x[1] >= a[-1] + length(kmer) THEN a || x ELSE a END)) AS INTEGER) AS start
    FROM (SELECT DISTINCT kmer, unnest(proteins) AS protein FROM matches) m JOIN parts ON parts.name = protein)"""
IONS = """ions AS MATERIALIZED (SELECT m.sample, m.scan, m.peak_id, m.charge, m.ion_type, m.kmer, p.protein, p.start, CAST(p.start + length(m.kmer) AS INTEGER) AS "end"
    FROM (SELECT * EXCLUDE (proteins), unnest(proteins) AS protein FROM matches) m JOIN places p USING (kmer, protein))"""
CLUSTERS = """clus AS MATERIALIZED (SELECT sample, scan, ion_type, protein, CASE ion_type WHEN 'b' THEN start ELSE "end" END AS anchor, count(*) AS support,
    min(start) AS start, max("end") AS "end", CAST(min(length(kmer)) AS INTEGER) AS shortest, max("end") - min(start) AS length FROM ions GROUP BY ALL)"""
FILTERED = "filt AS (SELECT * FROM clus WHERE support >= 2 AND length >= 3)"
EXTENDED = f"""ext AS MATERIALIZED (
    SELECT sample, scan, ion_type, protein, anchor, support, start, "end", shortest, length, arg_max(cand, length(cand)) FILTER (WHERE ok) AS extended_seq FROM (
      SELECT f.*, cand, ({sql_mass('cand')} + {WATER} + precursor_charge * {P}) / precursor_charge < precursor_mz + 20.0 * precursor_mz / 1e6 AS ok FROM (
        SELECT f.*, unnest(CASE ion_type WHEN 'b' THEN list_transform(range("end", length(seq) + 1), lambda e: substr(seq, start + 1, e - start))
          ELSE list_transform(range(0, start + 1), lambda s: substr(seq, s + 1, "end" - s)) END) AS cand FROM filt f JOIN parts ON parts.name = protein) f
      JOIN spectra_theo USING (sample, scan)) GROUP BY ALL)"""
PIECES = """piec AS MATERIALIZED (SELECT sample, scan, CASE ion_type WHEN 'b' THEN 'L' ELSE 'R' END AS side,
      CASE ion_type WHEN 'b' THEN left(extended_seq, n) ELSE right(extended_seq, n) END AS piece, protein FROM (
    SELECT *, unnest(range(shortest, length(extended_seq) + 1)) AS n FROM ext WHERE extended_seq IS NOT NULL))"""
PAIRED = "sided AS MATERIALIZED (SELECT sample, scan, side, piece, list_sort(list(DISTINCT protein)) AS proteins FROM piec GROUP BY ALL)"
HYBRIDS = f"""hyb AS MATERIALIZED (SELECT l.sample, l.scan, l.piece AS left_seq, r.piece AS right_seq, l.proteins AS left_proteins, r.proteins AS right_proteins
    FROM (SELECT sided.*, precursor_mz AS m, precursor_charge AS z, ({sql_mass('piece')} + {WATER} + precursor_charge * {P}) / precursor_charge AS mz
          FROM sided JOIN spectra_theo USING (sample, scan)) l
    JOIN (SELECT sided.*, ({sql_mass('piece')} + {WATER} + precursor_charge * {P}) / precursor_charge AS rmz
          FROM sided JOIN spectra_theo USING (sample, scan)) r
    ON l.sample = r.sample AND l.scan = r.scan AND l.side = 'L' AND r.side = 'R' AND r.rmz BETWEEN m + {WATER} / z + {P} - mz - 20.0 * m / 1e6 AND m + {WATER} / z + {P} - mz + 20.0 * m / 1e6)"""
UP_TO_MATCHES = ", ".join([THEO, TABLE, MATCHES])
UP_TO_IONS = ", ".join([UP_TO_MATCHES, PLACES, IONS])
UP_TO_EXTENDED = ", ".join([UP_TO_IONS, CLUSTERS, FILTERED, EXTENDED])
UP_TO_HYBRIDS = ", ".join([UP_TO_EXTENDED, PIECES, PAIRED, HYBRIDS])
