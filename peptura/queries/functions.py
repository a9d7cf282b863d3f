"""Scalar and generator functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import masses as M
from ..functions import sequences as S
from . import adapters as A
from . import query

@query(f"WITH {A.PARTS} SELECT seq, round({A.sql_mass('seq')}, 6) AS mass FROM parts")
def aa_mass(t):
    return t.parts.select("seq", F.round(M.checked_aa_mass(F.col("seq")), 6).alias("mass"))


@query(f"""WITH {A.PARTS}, m AS (SELECT seq, {A.sql_mass('seq')} AS m FROM parts)
SELECT seq, z AS charge, round((m + z * {A.P}) / z, 6) AS b_mz, round((m + {A.WATER} + z * {A.P}) / z, 6) AS y_mz, round((m + {A.WATER} + z * {A.P}) / z, 6) AS precursor_mz FROM m, range(1, 4) r(z)""")
def ion_mz(t):
    df = t.parts.select("seq", M.aa_mass(F.col("seq")).alias("m"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("z"))
    m, z = F.col("m"), F.col("z")
    of = lambda kind: F.round(M.ion_mz(m, z, F.lit(kind)), 6)
    return df.select("seq", z.cast("long").alias("charge"), of("b").alias("b_mz"), of("y").alias("y_mz"), F.round(M.precursor_mz(m, z), 6).alias("precursor_mz"))


@query(f"""WITH {A.PEAKS} SELECT sample, scan, peak_id, round(20.0 * mz / 1e6, 9) AS tol, round(abs(mz - 500) / mz * 1e6, 4) AS ppm_diff, round((mz - 500) / mz, 9) AS mz_diff,
  round(2 * (mz - 20.0 * mz / 1e6 - {A.P}), 6) AS b_lo, round(2 * (mz + 20.0 * mz / 1e6 - {A.P}) - {A.WATER}, 6) AS y_hi FROM peaks""")
def ppm_functions(t):
    mz = F.col("mz")
    b, y = M.b_ion_bounds(mz, F.lit(2), 20.0), M.y_ion_bounds(mz, F.lit(2), 20.0)
    return t.peaks.select(
        "sample", "scan", "peak_id", F.round(M.ppm_to_dalton(20.0, mz), 9).alias("tol"), F.round(M.ppm_diff(mz, F.lit(500.0)), 4).alias("ppm_diff"),
        F.round(M.mz_diff(mz, F.lit(500.0)), 9).alias("mz_diff"), F.round(b[0], 6).alias("b_lo"), F.round(y[1], 6).alias("y_hi"),
    )


@query(f"""WITH {A.PARTS} SELECT prot_id, array_to_string(list_transform(range(1, length(seq) + 1), lambda i: left(seq, i)), ',') AS prefixes,
  array_to_string(list_transform(range(1, length(seq) + 1), lambda i: substr(seq, i)), ',') AS suffixes FROM parts""")
def prefixes_suffixes(t):
    s = F.col("seq")
    return t.parts.select("prot_id", F.array_join(S.prefixes(s), ",").alias("prefixes"), F.array_join(S.suffixes(s), ",").alias("suffixes"))


@query("""WITH p AS (SELECT p_partkey, p_brand, p_name, p_type, p_size FROM part)
SELECT p_partkey, replace(lower(p_name), ' ', '_') AS lowered, 'db|' || p_partkey AS short_name, 'hybrid_' || p_brand || '/' || p_type AS hybrid, p_brand || '-' || p_type AS hyphen,
  p_brand AS left_side, p_type AS right_side, CAST(floor(p_size / 10) + 1 AS BIGINT) * 10 AS next_ten FROM p""")
def name_functions(t):
    b, k = F.col("p_brand"), F.col("p_type")
    left, right = S.parse_hybrid_name(S.hybrid_name(b, k))
    return t["part"].select(
        "p_partkey", S.lower_underscore(F.col("p_name")).alias("lowered"), S.short_protein_name(F.concat(F.lit("db|"), F.col("p_partkey").cast("string"), F.lit("|x y"))).alias("short_name"),
        F.replace(S.hybrid_name(b, k), F.lit("-"), F.lit("/")).alias("hybrid"), S.hyphenated(b, k).alias("hyphen"), left.alias("left_side"), right.alias("right_side"),
        S.next_multiple_of_10(F.col("p_size")).cast("long").alias("next_ten"),
    )


@query("""SELECT o_orderkey, 's' || (o_orderkey % 4) AS sample, CAST(o_orderkey AS VARCHAR) AS scan, CASE o_orderstatus WHEN 'F' THEN 'decoy' ELSE 'target' END AS kind, o_orderkey AS scan_number FROM orders""")
def parse_result_file_name(t):
    k = F.col("o_orderkey").cast("string")
    kind = F.when(F.col("o_orderstatus") == "F", "decoy").otherwise("target")
    name = F.concat(F.lit("s"), (F.col("o_orderkey") % 4).cast("string"), F.lit(".comet."), k, F.lit("-"), k, F.lit("."), kind, F.lit(".txt"))
    sample, scan, kind = S.parse_result_file_name(name)
    return t["orders"].select("o_orderkey", sample.alias("sample"), scan.alias("scan"), kind.alias("kind"), S.scan_number(F.concat(F.lit("controller=0 scan="), k)).alias("scan_number"))


@query(f"""WITH {A.PLANTED} SELECT pid, (SELECT coalesce(max(i), 0) FROM range(1, 7) x(i) WHERE i <= least(length(left_seq), length(right_seq)) AND right(left_seq, i) = left(right_seq, i)) AS overlap,
  array_to_string(list_transform(range(1, length(right_seq) + 1), lambda i: left_seq || left(right_seq, i)), ',') AS jb,
  array_to_string(list_transform(range(1, length(left_seq)), lambda i: substr(left_seq, i + 1) || right_seq), ',') AS jy FROM planted""")
def junction_seqs(t):
    b, y = S.junction_seqs(F.col("left_seq"), F.col("right_seq"))
    over = S.kmer_overlap(F.col("left_seq"), F.col("right_seq")).cast("long")
    return t.planted.select("pid", over.alias("overlap"), F.array_join(b, ",").alias("jb"), F.array_join(y, ",").alias("jy"))


@query(f"""WITH {A.PARTS} SELECT prot_id, CASE WHEN length(seq) <= 2 THEN seq ELSE reverse(left(seq, length(seq) - 1)) || right(seq, 1) END AS decoy,
  left(seq, 3) AS sub0, substr(seq, 3, 4) AS sub3 FROM parts""")
def decoys(t):
    s = F.col("seq")
    return t.parts.select("prot_id", S.decoy(s).alias("decoy"), S.legacy_subsequence(s, F.lit(0), F.lit(3)).alias("sub0"), S.legacy_subsequence(s, F.lit(3), F.lit(6)).alias("sub3"))


@query("""WITH RECURSIVE words AS (SELECT DISTINCT lower(p_name) AS s FROM part), perm AS (SELECT s, '' AS made, s AS rest FROM words
  UNION ALL SELECT s, made || c, substr(rest, 2) FROM (
    SELECT *, unnest(CASE WHEN left(rest, 1) IN ('a', 'e') THEN ['a', 'e'] ELSE [left(rest, 1)] END) AS c FROM perm WHERE rest <> ''))
SELECT s, made FROM perm WHERE rest = ''""")
def permute_letters(t):
    names = t["part"].select(F.lower("p_name").alias("s")).distinct()
    return names.select("s", F.explode(S.permuted(F.col("s"), "ae")).alias("made"))


def _runs(t, where="true"):
    return t["orders"].where(where).select(F.concat(F.lit("s"), (F.col("o_orderkey") % 4).cast("string")).alias("sample"), F.col("o_orderkey").alias("scan"))


@query("SELECT o_orderkey, 's' || (o_orderkey % 4) || '.comet.' || o_orderkey || '-' || o_orderkey || '.' || k || '.txt' AS file FROM orders, (VALUES ('target'), ('decoy')) v(k)")
def expected_outputs(t):
    from ..sources.tables import expected_outputs as make

    return make(_runs(t)).select(F.col("scan").alias("o_orderkey"), "file")


@query("SELECT 's' || (o_orderkey % 4) || '.comet.' || o_orderkey || '-' || o_orderkey || '.' || k || '.txt' AS file FROM orders, (VALUES ('target'), ('decoy')) v(k) WHERE NOT (o_orderstatus = 'F' AND k = 'decoy')")
def missing_outputs(t):
    from ..sources.tables import expected_outputs as make
    from ..sources.tables import missing_outputs as missing

    done = make(_runs(t, "o_orderstatus = 'F'"))
    return missing(make(_runs(t)).select("file"), done.where("kind = 'decoy'"))


@query("""SELECT o_orderkey, round(s, 2) || ' secs = ' || round(s / 60, 2) || ' mins = ' || round(s / 3600, 2) || ' hrs' AS units, CASE t WHEN 'b' THEN 0 WHEN 'y' THEN 1 END AS code, t AS back,
  NOT contains(lower(o_orderpriority), 'f') AS flag, CAST(floor(100 * (o_orderkey % 77) / 77.0) AS INTEGER) AS percent, o_orderkey || '-' || o_custkey AS bounds
FROM (SELECT *, (2 * o_orderkey + 1)::DOUBLE AS s, CASE WHEN o_orderkey % 2 = 0 THEN 'b' ELSE 'y' END AS t FROM orders)""")
def small_functions(t):
    k = F.col("o_orderkey")
    code = S.ion_type_code(F.when(k % 2 == 0, "b").otherwise("y"))
    return t["orders"].select(
        "o_orderkey", S.time_units((2 * k + 1).cast("double")).alias("units"), code.alias("code"), S.ion_type_of(code).alias("back"),
        S.string_to_bool(F.col("o_orderpriority")).alias("flag"), S.to_percent(k % 77, F.lit(77)).alias("percent"), S.hashable_boundaries(F.array(k, "o_custkey")).alias("bounds"),
    )
