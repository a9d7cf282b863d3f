"""The older engine's operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.masses import LEGACY_BASES, LEGACY_RESIDUES
from ..operators import legacy as L
from ..operators.dealing import dealt
from . import adapters as A
from . import query

_CASE = " ".join(f"WHEN '{c}' THEN {round(m * 10**6)}" for c, m in LEGACY_RESIDUES.items())
_MASS = f"(coalesce(list_sum(list_transform(string_split(kmer, ''), lambda c: CASE c {_CASE} END)), 0)::BIGINT / 1e6)"
_BASE = " ".join(f"WHEN ion_type = '{t}' AND charge = {z} THEN {v!r}" for (t, z), v in LEGACY_BASES.items())
KMERS = f"""lk AS MATERIALIZED (SELECT prot_id, kmer, start, start + k AS "end", ion_type, charge, (CASE {_BASE} END + {_MASS}) / charge AS mass, {_MASS} AS kmer_mass
  FROM {A.sql_kmers('parts', 2, 4)} k JOIN (SELECT prot_id, seq FROM parts) p USING (prot_id), (VALUES ('b'), ('y')) t(ion_type), range(1, 3) z(charge)
  WHERE CASE ion_type WHEN 'b' THEN kmer[1] IN ('S', 'D') OR (start > 0 AND substr(seq, start, 1) IN ('K', 'R')) ELSE kmer[-1] IN ('K', 'R') OR (start + k < length(seq) AND substr(seq, start + k + 1, 1) IN ('S', 'D')) END)"""
FRAGS = f"{A.PEAKS}, frag AS (SELECT sample || ':' || scan AS prec_id, precursor_mz, peak_id AS frag_id, mz FROM peaks JOIN spectra USING (sample, scan))"
MATCH = "lm AS MATERIALIZED (SELECT prec_id, precursor_mz, frag_id, lk.* FROM frag JOIN lk ON mass BETWEEN mz - abs(10.0 / 1e6 * mz) AND mz + abs(10.0 / 1e6 * mz))"
CLUS = """lc AS MATERIALIZED (SELECT prec_id, precursor_mz, prot_id, ion_type, CASE ion_type WHEN 'b' THEN start ELSE "end" END AS anchor,
  arg_max({'kmer': kmer, 'start': start, 'end': "end", 'kmer_mass': kmer_mass}, length(kmer) * 100000 - start) AS l, count(*) AS score FROM lm GROUP BY ALL)"""
ALL = f"WITH {A.PARTS}, {A.SPECTRA}, {KMERS}, {FRAGS}, {MATCH}, {CLUS}"


def _kmers(t):
    from ..functions.masses import legacy_mass

    return L.legacy_kmers(t.parts, 4, ["S", "D"], ["K", "R"]).withColumn("kmer_mass", legacy_mass(F.col("kmer")))


def _matches(t):
    prec = F.concat_ws(":", "sample", F.col("scan").cast("string"))
    frags = t.peaks.join(t.spectra, ["sample", "scan"]).select(prec.alias("prec_id"), "precursor_mz", F.col("peak_id").alias("frag_id"), "mz")
    return L.legacy_mass_join(frags, _kmers(t)).drop("mz")


def _clusters(t):
    return L.legacy_clusters(_matches(t))


@query(f'WITH {A.PARTS}, {KMERS} SELECT prot_id, kmer, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", ion_type, charge, round(mass, 6) AS mass FROM lk')
def legacy_kmers(t):
    return _kmers(t).select("prot_id", "kmer", "start", "end", "ion_type", F.col("charge").cast("long").alias("charge"), F.round("mass", 6).alias("mass"))


@query(f"WITH {A.PARTS}, {A.SPECTRA}, {KMERS}, {FRAGS}, {MATCH} SELECT prec_id, frag_id, prot_id, kmer, CAST(start AS INTEGER) AS start, ion_type, charge FROM lm")
def legacy_mass_join(t):
    return _matches(t).select("prec_id", "frag_id", "prot_id", "kmer", "start", "ion_type", F.col("charge").cast("long").alias("charge"))


#: Of every supplier a place, with the ions of all k-mers that begin or end there: clusters of several k-mers and charges.
CROWDED = """seeds AS (SELECT *, row_number() OVER (PARTITION BY ion_type ORDER BY prot_id, start, "end") - 1 AS i, count(*) OVER (PARTITION BY ion_type) AS n FROM lk WHERE charge = 1),
frag AS (SELECT 'c' || s_suppkey AS prec_id, round(a.kmer_mass + 500, 3) AS precursor_mz, CAST(k.charge * 100 + length(k.kmer) AS INTEGER) AS frag_id, k.mass AS mz
  FROM supplier JOIN seeds a ON a.i = s_suppkey * 7 % a.n JOIN lk k ON k.prot_id = a.prot_id AND k.ion_type = a.ion_type AND CASE a.ion_type WHEN 'b' THEN k.start = a.start ELSE k."end" = a."end" END)"""


def _crowded_clusters(t):
    own = Window.partitionBy("ion_type")
    kmers = _kmers(t)
    anchor = F.when(F.col("ion_type") == "b", F.col("start")).otherwise(F.col("end"))
    seeds = kmers.where("charge = 1").select("prot_id", "ion_type", anchor.alias("anchor"), "kmer_mass", (F.row_number().over(own.orderBy("prot_id", "start", "end")) - 1).alias("i"), F.count("*").over(own).alias("n"))
    sizes = seeds.select("ion_type", "n").distinct()  # two rows
    asked = t["supplier"].select("s_suppkey").join(F.broadcast(sizes)).withColumn("i", F.col("s_suppkey") * 7 % F.col("n"))
    asked = asked.join(seeds.drop("n"), ["ion_type", "i"])
    found = asked.join(kmers.select("prot_id", "ion_type", anchor.alias("anchor"), "kmer", "charge", "mass"), ["prot_id", "ion_type", "anchor"])
    frags = found.select(
        F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("prec_id"), F.round(F.col("kmer_mass") + 500, 3).alias("precursor_mz"),
        (F.col("charge") * 100 + F.length("kmer")).alias("frag_id"), F.col("mass").alias("mz"),
    )
    return L.legacy_clusters(L.legacy_mass_join(dealt(frags, t["supplier"].count(), "prec_id"), kmers).drop("mz"))


@query(f"WITH {A.PARTS}, {KMERS}, {CROWDED}, {MATCH}, {CLUS} SELECT prec_id, precursor_mz, prot_id, ion_type, CAST(anchor AS INTEGER) AS anchor, l.kmer AS kmer, CAST(l.start AS INTEGER) AS start, score FROM lc")
def legacy_clusters(t):
    return _crowded_clusters(t).select("prec_id", "precursor_mz", "prot_id", "ion_type", "anchor", "kmer", "start", "score")


@query(f"""{ALL}, step AS (
  SELECT prec_id, prot_id, ion_type, anchor, n, list_sum(list_transform(string_split(left(more, n), ''), lambda c: CASE c {_CASE} ELSE 0 END))::BIGINT + round(l.kmer_mass * 1e6)::BIGINT AS m, precursor_mz, more FROM (
    SELECT lc.*, CASE ion_type WHEN 'b' THEN substr(seq, l."end" + 1) ELSE reverse(left(seq, l.start)) END AS more FROM lc JOIN parts USING (prot_id)), range(1, 100) r(n) WHERE n <= length(more)
), best AS (SELECT prec_id, prot_id, ion_type, anchor, arg_max(left(more, n), n) AS e FROM step WHERE m / 1e6 <= precursor_mz GROUP BY ALL)
SELECT prec_id, prot_id, ion_type, CAST(anchor AS INTEGER) AS anchor, coalesce(CASE ion_type WHEN 'b' THEN e ELSE reverse(e) END, '') AS extension FROM lc LEFT JOIN best USING (prec_id, prot_id, ion_type, anchor)""")
def legacy_extend(t):
    return L.legacy_extend(_clusters(t), t.parts).select("prec_id", "prot_id", "ion_type", "anchor", "extension")


#: Fragments planted so that clusters of both types fit under a precursor: a b and a y k-mer for every supplier.
PLANTED = """seeds AS (SELECT *, row_number() OVER (PARTITION BY ion_type ORDER BY prot_id, start, "end") - 1 AS i, count(*) OVER (PARTITION BY ion_type) AS n FROM lk WHERE charge = 1),
pairs AS (SELECT 'p' || s_suppkey AS prec_id, b.mass AS bm, y.mass AS ym, round(b.kmer_mass + y.kmer_mass + 60 + s_suppkey % 200, 3) AS precursor_mz
  FROM supplier, seeds b, seeds y WHERE b.ion_type = 'b' AND y.ion_type = 'y' AND b.i = s_suppkey * 7 % b.n AND y.i = s_suppkey * 13 % y.n),
frag AS (SELECT prec_id, precursor_mz, 1 AS frag_id, bm AS mz FROM pairs UNION ALL SELECT prec_id, precursor_mz, 2, ym FROM pairs)"""
EXTENDED = f"""step AS (
  SELECT prec_id, prot_id, ion_type, anchor, n, list_sum(list_transform(string_split(left(more, n), ''), lambda c: CASE c {_CASE} ELSE 0 END))::BIGINT + round(l.kmer_mass * 1e6)::BIGINT AS m, precursor_mz, more FROM (
    SELECT lc.*, CASE ion_type WHEN 'b' THEN substr(seq, l."end" + 1) ELSE reverse(left(seq, l.start)) END AS more FROM lc JOIN parts USING (prot_id)), range(1, 100) r(n) WHERE n <= length(more)
), grown AS (SELECT prec_id, prot_id, ion_type, anchor, arg_max(left(more, n), n) AS e FROM step WHERE m / 1e6 <= precursor_mz GROUP BY ALL),
le AS MATERIALIZED (SELECT prec_id, prot_id, ion_type, anchor, precursor_mz, l, score, coalesce(CASE ion_type WHEN 'b' THEN e ELSE reverse(e) END, '') AS extension FROM lc LEFT JOIN grown USING (prec_id, prot_id, ion_type, anchor))"""
_BEST = """best AS MATERIALIZED (SELECT a.*, b.prot_id AS other_prot_id, b.anchor AS other_anchor, b.l AS other_l, b.score AS other_score, b.extension AS other_extension,
  row_number() OVER (PARTITION BY a.prec_id, a.ion_type, a.prot_id, a.anchor ORDER BY b.l.kmer_mass DESC, b.prot_id, b.anchor) AS r
  FROM le a JOIN le b ON a.prec_id = b.prec_id AND a.ion_type <> b.ion_type AND b.l.kmer_mass <= a.precursor_mz - a.l.kmer_mass)"""
PAIRED = f"WITH {A.PARTS}, {KMERS}, {PLANTED}, {MATCH}, {CLUS}, {EXTENDED}, {_BEST}"
ALIGNED = f"""{PAIRED}, al AS (SELECT prec_id, prot_id, CAST(anchor AS INTEGER) AS anchor, ion_type, precursor_mz, CASE WHEN prot_id = other_prot_id THEN 'n' ELSE 'h' END AS peptide_type,
  CASE ion_type WHEN 'b' THEN prot_id ELSE other_prot_id END AS lp, CASE ion_type WHEN 'b' THEN other_prot_id ELSE prot_id END AS rp,
  CASE ion_type WHEN 'b' THEN l.kmer || extension || other_extension || other_l.kmer ELSE other_l.kmer || other_extension || extension || l.kmer END AS sequence,
  CASE ion_type WHEN 'b' THEN score ELSE other_score END AS b_score, CASE ion_type WHEN 'b' THEN other_score ELSE score END AS y_score, score + other_score AS total_score,
  CASE ion_type WHEN 'b' THEN extension ELSE other_extension END AS bx, CASE ion_type WHEN 'b' THEN other_extension ELSE extension END AS yx,
  (length(l.kmer) + length(other_l.kmer)) / length(seq)::DOUBLE AS length_score FROM best JOIN (SELECT prot_id, seq FROM parts) USING (prot_id) WHERE r = 1)"""


def _planted_fragments(t):
    own = Window.partitionBy("ion_type")
    seeds = _kmers(t).where("charge = 1").withColumn("i", F.row_number().over(own.orderBy("prot_id", "start", "end")) - 1).withColumn("n", F.count("*").over(own))
    side = lambda kind: seeds.where(F.col("ion_type") == kind).select(F.col("i").alias(f"{kind}_i"), F.col("n").alias(f"{kind}_n"), F.col("mass").alias(f"{kind}_mz"), F.col("kmer_mass").alias(f"{kind}_mass"))
    k = F.col("s_suppkey")
    sizes = seeds.groupBy().agg(F.max(F.when(F.col("ion_type") == "b", F.col("n"))).alias("nb"), F.max(F.when(F.col("ion_type") == "y", F.col("n"))).alias("ny"))
    df = t["supplier"].crossJoin(F.broadcast(sizes)).select(k, (k * 7 % F.col("nb")).alias("b_i"), (k * 13 % F.col("ny")).alias("y_i"))
    df = df.join(side("b"), "b_i").join(side("y"), "y_i")
    mz = F.round(F.col("b_mass") + F.col("y_mass") + 60 + k % 200, 3)
    df = dealt(df.select(F.concat(F.lit("p"), k.cast("string")).alias("prec_id"), mz.alias("precursor_mz"), "b_mz", "y_mz"), t["supplier"].count(), "prec_id")
    return df.select("prec_id", "precursor_mz", F.posexplode(F.array("b_mz", "y_mz")).alias("frag_id", "mz"))


def _planted_clusters(t):
    return L.legacy_clusters(L.legacy_mass_join(_planted_fragments(t), _kmers(t)).drop("mz"))


def _peptides(t):
    found = L.legacy_extend(_planted_clusters(t), t.parts).join(t.parts.select("prot_id", F.length("seq").alias("seq_length")), "prot_id")
    return L.aligned_peptides(L.best_complement(found)), found


@query(f"{PAIRED} SELECT prec_id, ion_type, prot_id, CAST(anchor AS INTEGER) AS anchor, other_prot_id, CAST(other_anchor AS INTEGER) AS other_anchor FROM best WHERE r = 1")
def best_complement(t):
    return L.best_complement(_planted_clusters(t)).select("prec_id", "ion_type", "prot_id", "anchor", "other_prot_id", "other_anchor")


@query(f"""{ALIGNED} SELECT prec_id, prot_id, anchor, ion_type, peptide_type, lp AS left_prot_id, rp AS right_prot_id, sequence, b_score, y_score, total_score, bx AS b_extension, yx AS y_extension,
  round(length_score, 9) AS length_score FROM al""")
def aligned_peptide(t):
    return _peptides(t)[0].select("prec_id", "prot_id", "anchor", "ion_type", "peptide_type", "left_prot_id", "right_prot_id", "sequence", "b_score", "y_score", "total_score", "b_extension", "y_extension", F.round("length_score", 9).alias("length_score"))


@query(f"""{ALIGNED} SELECT prec_id AS spectrum_id, peptide_type AS hybrid, sequence, CAST(total_score AS VARCHAR) AS "total score", (total_score * length(sequence)) || '/' || length(sequence) AS "#peaks/length",
  'part|' || lp AS "left kmer", 'part|' || rp AS "right kmer", CAST(b_score AS VARCHAR) AS "b score", CAST(y_score AS VARCHAR) AS "y score",
  array_to_string(list_filter(string_split(bx, ''), lambda x: x <> ''), '/') AS "prev aa", array_to_string(list_filter(string_split(yx, ''), lambda x: x <> ''), '/') AS "next aa",
  round(length_score, 9) AS "total gaussian score", '0' AS "total mass error", round(precursor_mz, 6) AS "precursor mass", '1' AS "precursor charge" FROM al""")
def legacy_output(t):
    peptides, found = _peptides(t)
    precursors = found.select("prec_id", "precursor_mz", F.lit(1).alias("precursor_charge")).distinct()
    out = L.legacy_output(peptides.join(precursors, "prec_id"), t.parts)
    # engines write doubles in different ways
    return out.withColumns({c: F.round(F.col(c).cast("double"), n) for c, n in (("total gaussian score", 9), ("precursor mass", 6))})


@query(f"""{ALIGNED} SELECT 'p:' || substr(prec_id, 2) AS spectrum_id, peptide_type AS hybrid, sequence, CAST(total_score AS VARCHAR) AS total, 'part|' || lp AS left_kmer, 'part|' || rp AS right_kmer, round(precursor_mz, 6) AS precursor FROM al""")
def legacy_run(t):
    """The older engine in one call, on spectra with the planted fragments as peaks."""
    from ..plans.older import OlderConfig, run

    frags = _planted_fragments(t)
    peak = F.struct(F.col("frag_id").cast("int").alias("id"), "mz", F.lit(1.0).alias("intensity"))
    spectra = frags.groupBy("prec_id", "precursor_mz").agg(F.sort_array(F.collect_list(peak)).alias("peaks"))
    spectra = spectra.select(F.lit("p").alias("sample"), F.substring("prec_id", 2, 20).cast("long").alias("scan"), "precursor_mz", F.lit(1).alias("precursor_charge"), "peaks")
    out = run(spectra, t.parts, OlderConfig(max_k=4, decimals=12, digest_left=("S", "D"), digest_right=("K", "R")))
    return out.select(
        F.col("spectrum_id"), "hybrid", "sequence", F.col("total score").alias("total"), F.col("left kmer").alias("left_kmer"), F.col("right kmer").alias("right_kmer"),
        F.round(F.col("precursor mass").cast("double"), 6).alias("precursor"),
    )


@query(f"WITH {A.SPECTRA}, {A.PEAKS} SELECT sample, scan, CAST(row_number() OVER (PARTITION BY sample, scan ORDER BY mz, peak_id) - 1 AS INTEGER) AS frag_id, mz, intensity AS abundance, precursor_mz, precursor_charge FROM (SELECT *, row_number() OVER (PARTITION BY sample, scan ORDER BY intensity DESC, peak_id) AS r FROM peaks) JOIN spectra USING (sample, scan) WHERE r <= 3")
def legacy_precursors(t):
    return L.legacy_precursors(t.peak_lists, 6, num_peaks=3)


@query(f"WITH {A.PEAKS} SELECT sample, scan, peak_id FROM peaks WHERE intensity >= 10.0")
def legacy_fragment_filter(t):
    return L.legacy_fragment_filter(t.peaks.withColumnRenamed("intensity", "abundance"), 10.0).select("sample", "scan", "peak_id")


@query(f'WITH {A.PARTS}, {KMERS} SELECT kmer, ion_type, charge, round(mass, 6) AS mass FROM lk WHERE prot_id = (SELECT min(prot_id) FROM lk) AND start = 0 AND "end" = 3')
def sequence_lookup(t):
    k = _kmers(t)
    first = k.agg(F.min("prot_id")).first()[0]
    return L.sequence_lookup(k, -1 if first is None else first, 0, 3).select("kmer", "ion_type", F.col("charge").cast("long").alias("charge"), F.round("mass", 6).alias("mass"))


@query(f"""{ALL} SELECT c.prec_id, c.prot_id, c.ion_type, CAST(c.anchor AS INTEGER) AS anchor, k.kmer AS longer FROM lc c JOIN lk k ON k.prot_id = c.prot_id AND k.ion_type = 'b' AND k.charge = 2
  AND k.start = c.l.start AND k."end" = c.l."end" + 1 AND k.mass <= c.precursor_mz""")
def extensions_to_length(t):
    return L.extensions_to_length(_kmers(t), _clusters(t), 2).select("prec_id", "prot_id", "ion_type", "anchor", "longer")


@query(f"WITH {A.PARTS}, {KMERS} SELECT count(*) AS n FROM lk WHERE ion_type = 'b' AND mass BETWEEN 200.0 AND 300.0")
def count_ion_mass(t):
    return L.count_ion_mass(_kmers(t), 250.0, 50.0, "b")


@query(f"""{ALL} SELECT c.prec_id, c.prot_id, c.ion_type, CAST(c.anchor AS INTEGER) AS anchor, k.kmer AS longer FROM lc c JOIN lk k ON k.prot_id = c.prot_id AND k.ion_type = c.ion_type AND k.charge = 2
  AND CASE c.ion_type WHEN 'b' THEN k.start = c.l.start AND k."end" >= c.l."end" ELSE k."end" = c.l."end" AND k.start <= c.l.start END AND k.mass < c.precursor_mz""")
def extension_candidates(t):
    return L.extension_candidates(_kmers(t), _clusters(t)).select("prec_id", "prot_id", "ion_type", "anchor", "longer")
