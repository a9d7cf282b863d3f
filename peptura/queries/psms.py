"""Peptide-spectrum matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequences import HYBRID_PREFIX
from ..operators import psms as P
from . import adapters as A
from . import query

_Q = """won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample, scan ORDER BY score DESC, is_decoy DESC, psm_id) AS r FROM psms) WHERE r = 1),
per AS (SELECT score, count(*) FILTER (WHERE is_decoy) AS d, count(*) FILTER (WHERE NOT is_decoy) AS t FROM won GROUP BY score),
f AS (SELECT score, least(1.0, (sum(d) OVER (ORDER BY score DESC) + 1) / greatest(sum(t) OVER (ORDER BY score DESC), 1)::DOUBLE) AS fdr FROM per),
q AS (SELECT score, min(fdr) OVER (ORDER BY score) AS q_value FROM f),
scored AS (SELECT won.*, q_value FROM won JOIN q USING (score) WHERE NOT is_decoy)"""


@query(f"WITH {A.PSMS}, {_Q} SELECT psm_id, sample, scan, score, round(q_value, 9) AS q_value FROM scored")
def tdc_q_value(t):
    return P.tdc_q_value(t.psms).select("psm_id", "sample", "scan", "score", F.round("q_value", 9).alias("q_value"))


@query(f"WITH {A.PSMS}, {_Q} SELECT psm_id, score FROM scored WHERE q_value <= 0.25")
def high_confidence(t):
    return P.high_confidence(P.tdc_q_value(t.psms), 0.25).select("psm_id", "score")


@query(f"WITH {A.PSMS} SELECT psm_id FROM psms WHERE len(list_filter(proteins, lambda p: NOT starts_with(p, 'hybrid_'))) = 0")
def is_hybrid(t):
    return P.hybrid_psms(t.psms).select("psm_id")


@query(f"WITH {A.PSMS} SELECT protein, count(*) AS n FROM (SELECT unnest(proteins) AS protein FROM psms) GROUP BY protein")
def protein_counts(t):
    return P.protein_counts(t.psms)


@query(f"WITH {A.PSMS} SELECT protein, count(*) AS n FROM (SELECT unnest(proteins) AS protein FROM psms) GROUP BY protein ORDER BY n DESC, protein LIMIT 10")
def top_n_proteins(t):
    return P.top_n_proteins(P.protein_counts(t.psms), 10)


@query(f"WITH {A.PSMS} SELECT length(prefix) AS length, prefix, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(seq) + 1), lambda i: left(seq, i))) AS prefix FROM psms) GROUP BY 2, 1")
def prefix_counts_by_length(t):
    return P.prefix_counts_by_length(t.psms).withColumn("length", F.col("length").cast("long"))


@query(f"WITH {A.PSMS} SELECT psm_id FROM psms WHERE (sample, scan) IN (SELECT ('u' || (o_custkey % 100), o_orderkey % 500) FROM orders WHERE o_orderstatus = 'P')")
def psms_for_scans(t):
    scans = t["orders"].where("o_orderstatus = 'P'").select(F.concat(F.lit("u"), (F.col("o_custkey") % 100).cast("string")).alias("sample"), (F.col("o_orderkey") % 500).alias("scan"))
    return P.psms_for_scans(t.psms, scans).select("psm_id")


@query(f"WITH {A.PSMS} SELECT psm_id, sample, score FROM psms JOIN (SELECT sample, max(score) AS m FROM psms GROUP BY sample) USING (sample) WHERE score = m")
def max_elements(t):
    return P.max_elements(t.psms.select("psm_id", "sample", "score"), "score", ["sample"])


@query(f"WITH {A.PSMS} SELECT psm_id, dense_rank() OVER (ORDER BY score DESC) AS rank FROM psms")
def dense_rank_desc(t):
    return P.dense_rank_desc(t.psms.select("psm_id", "score"), "score").select("psm_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {A.PSMS} SELECT round(50.0 * (count(*) FILTER (WHERE score < 12.31) + count(*) FILTER (WHERE score <= 12.31) + CASE WHEN count(*) FILTER (WHERE score = 12.31) > 0 THEN 1 ELSE 0 END) / count(score), 6) AS percentile FROM psms")
def percentile_of_score(t):
    return P.percentile_of_score(t.psms, "score", 12.31).withColumn("percentile", F.round("percentile", 6))


@query(f"""WITH {A.PSMS} SELECT psm_id, row_number() OVER w AS num, round((score - lead(score) OVER w) / greatest(score, 1.0), 6) AS delta_cn FROM psms
WINDOW w AS (PARTITION BY sample, scan ORDER BY score DESC, psm_id)""")
def delta_cn(t):
    return P.delta_cn(t.psms).select("psm_id", F.col("num").cast("long").alias("num"), F.round("delta_cn", 6).alias("delta_cn"))


_SIDES = f"""WITH {A.PSMS}, h AS (SELECT sample, scan, max(score) AS h, max(ions_matched) AS hi, count(*) AS hn FROM psms WHERE starts_with(proteins[1], 'hybrid_') GROUP BY ALL),
n AS (SELECT sample, scan, max(score) AS n, max(eval) AS e, min(eval) AS le, max(ions_matched) AS ni, count(*) AS nn FROM psms WHERE NOT starts_with(proteins[1], 'hybrid_') GROUP BY ALL)"""


def _native_and_hybrid(t):
    hybrid = F.col("proteins")[0].startswith(HYBRID_PREFIX)
    return t.psms.where(~hybrid), t.psms.where(hybrid)


@query(f"""{_SIDES} SELECT sample, scan, n AS native_score, e AS native_eval, le AS native_least_eval, ni AS native_ions, nn AS native_n, h AS hybrid_score, hi AS hybrid_ions, hn AS hybrid_n,
  round(h - n, 6) AS change, round((h - n) / nullif(n, 0), 6) AS rel_change, hi - ni AS ions_change FROM n JOIN h USING (sample, scan)""")
def native_hybrid_change(t):
    df = P.native_hybrid_change(*_native_and_hybrid(t))
    return df.withColumn("change", F.round("change", 6)).withColumn("rel_change", F.round("rel_change", 6))


@query(f"""WITH {A.PSMS}, h AS (SELECT sample, scan, max(score) AS h FROM psms WHERE num = 1 AND starts_with(proteins[1], 'hybrid_') GROUP BY ALL),
n AS (SELECT sample, scan, max(score) AS n FROM psms WHERE num = 1 AND NOT starts_with(proteins[1], 'hybrid_') GROUP BY ALL)
SELECT sample, scan, round(n - h, 6) AS change, round((n - h) / CASE WHEN n = 0 THEN 1e-5 ELSE n END, 6) AS rel_change FROM n JOIN h USING (sample, scan)""")
def rank_change(t):
    df = P.rank_change(*_native_and_hybrid(t))
    return df.select("sample", "scan", F.round("change", 6).alias("change"), F.round("rel_change", 6).alias("rel_change"))


@query(f"WITH {A.PSMS} SELECT psm_id FROM psms WHERE num = 1")
def top_ranked(t):
    return P.top_ranked(t.psms).select("psm_id")


@query(f"WITH {A.PSMS} SELECT psm_id FROM psms WHERE (sample, scan) = (SELECT (sample, scan) FROM psms ORDER BY psm_id LIMIT 1)")
def for_sample_scan(t):
    first = t.psms.orderBy("psm_id").first()
    return P.for_sample_scan(t.psms, first["sample"] if first else "", first["scan"] if first else 0).select("psm_id")


@query(f"WITH {A.PSMS} SELECT sample, scan, string_agg(psm_id, ',' ORDER BY num, psm_id) AS ids FROM psms GROUP BY ALL")
def psm_groups(t):
    df = P.psm_groups(t.psms.select("sample", "scan", "num", "psm_id"))
    return df.select("sample", "scan", F.array_join(F.transform("group", lambda g: g["psm_id"].cast("string")), ",").alias("ids"))


@query(f"WITH {A.PSMS} SELECT sample, min(score) AS score FROM psms GROUP BY sample")
def fcn_of_psms(t):
    return P.fcn_of_psms(t.psms, "score", F.min, ["sample"])


@query(f"WITH {A.PSMS} SELECT psm_id, sample, score FROM psms JOIN (SELECT sample, min(score) AS m FROM psms GROUP BY sample) USING (sample) WHERE score = m")
def arg_fcn_of_psms(t):
    return P.arg_fcn_of_psms(t.psms.select("psm_id", "sample", "score"), "score", F.min, ["sample"])


@query(f"""WITH {A.PSMS} SELECT psm_id, CASE WHEN len(list_filter(proteins, lambda p: NOT starts_with(p, 'hybrid_'))) = 0
  THEN array_to_string(list_sort(list_distinct(list_transform(proteins, lambda p: substr(p, 8)))), ',') ELSE seq END AS forms FROM psms""")
def seq_with_hyphen(t):
    return P.seq_with_hyphen(t.psms).select("psm_id", F.array_join("forms", ",").alias("forms"))


@query(f"""WITH {A.PLANTED}, {A.TABLE}, m AS (SELECT pid AS psm_id, sample, scan, left_seq || right_seq AS seq FROM planted WHERE pid % 3 <> 0 AND pid % 5 <> 0)
SELECT psm_id, sample, scan, left(seq, n) AS left_seq, substr(seq, n + 1) AS right_seq FROM m, range(2, 11) r(n)
WHERE n <= length(seq) - 2 AND left(seq, n) IN (SELECT kmer FROM tab) AND substr(seq, n + 1) IN (SELECT kmer FROM tab)""")
def save_hybrids(t):
    p = F.col("pid")
    name = F.when(p % 3 == 0, F.array(F.lit("part|1"), F.lit("hybrid_A-B"))).otherwise(F.array(F.lit("hybrid_A-B")))
    psms = t.peptides.select(p.alias("psm_id"), "sample", "scan", "seq", name.alias("proteins"), F.when(p % 5 == 0, 0.02).otherwise(0.01).alias("q_value"))
    return P.save_hybrids(psms, t.table, 0.01, 2).select("psm_id", "sample", "scan", "left_seq", "right_seq")


@query(f"""WITH {A.PARTS}, h AS (SELECT s_suppkey AS hybrid_id, [s_suppkey % 50, s_suppkey % 77, -1] AS l, [s_suppkey % 91] AS r FROM supplier)
SELECT hybrid_id, (SELECT coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') FROM parts WHERE list_contains(l, prot_id)) AS left_proteins,
  (SELECT coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') FROM parts WHERE list_contains(r, prot_id)) AS right_proteins FROM h""")
def concat_protein_names(t):
    k = F.col("s_suppkey")
    ids = t["supplier"].select(k.alias("hybrid_id"), F.array(k % 50, k % 77, F.lit(-1).cast("long")).alias("left_ids"), F.array(k % 91).alias("right_ids"))
    df = P.concat_protein_names(ids, t.parts)
    return df.select("hybrid_id", *[F.array_join(c, ",").alias(c) for c in ("left_proteins", "right_proteins")])


@query(f"WITH {A.PSMS} SELECT DISTINCT sample, scan FROM psms")
def distinct_scans(t):
    return t.psms.select("sample", "scan").distinct()


@query(f"WITH {A.PSMS} SELECT count(*) FILTER (WHERE score > 50.0) AS n FROM psms")
def number_greater_than(t):
    return t.psms.agg(F.count_if(F.col("score") > 50.0).alias("n"))


@query(f"WITH {A.PSMS}, {A.PARTS} SELECT DISTINCT name FROM parts WHERE name IN (SELECT protein FROM (SELECT protein, count(*) AS n FROM (SELECT unnest(proteins) AS protein FROM psms) GROUP BY protein ORDER BY n DESC, protein LIMIT 10))")
def abundant_proteins(t):
    top = P.top_n_proteins(P.protein_counts(t.psms), 10).select(F.col("protein").alias("name"))
    return t.parts.join(top, "name", "left_semi").select("name")


def _deviation(values):
    """The median of the distances from the median."""
    import numpy as np

    own = values.to_numpy(zero_copy_only=False)
    return float(np.median(np.abs(own - np.median(own))))


@query(f"WITH {A.PSMS} SELECT sample, round(mad(score), 9) AS deviation FROM psms GROUP BY sample")
def fold_of_psms(t):
    """A fold that Spark lacks, through SQL."""
    from ..operators.folds import register_fold

    register_fold(t.spark, "peptura_deviation", _deviation, "double")
    t.psms.createOrReplaceTempView("peptura_fold_psms")
    return t.spark.sql("SELECT sample, round(peptura_deviation(score), 9) AS deviation FROM peptura_fold_psms GROUP BY sample")


@query(f"WITH {A.PSMS}, low AS (SELECT sample, quantile_disc(ions_matched, 0.5) AS m FROM psms GROUP BY sample) SELECT psm_id, sample, ions_matched FROM psms JOIN low USING (sample) WHERE ions_matched = m")
def arg_fold_of_psms(t):
    """The matches whose value is their sample's lower median."""
    from ..operators.folds import arg_fold_of

    middle = lambda v: sorted(v.to_pylist())[(len(v) - 1) // 2]
    return arg_fold_of(t.psms, ["sample"], "ions_matched", middle, "int").select("psm_id", "sample", "ions_matched")


@query(f"WITH {A.PSMS} SELECT psm_id, sample, scan, score, seq, num, eval FROM psms")
def sqlite_scan(t):
    """Matches written to a SQLite file and read back in ranges of rows."""
    from ..sources import sqlite

    at = t.folder("psms.db")
    sqlite.write_sqlite(t.psms.select("psm_id", "sample", "scan", "score", "seq", "num", "eval"), at, "psms", ["sample"])
    return sqlite.sqlite_scan(t.spark, at, "psms").withColumn("num", F.col("num").cast("int"))


@query(f"""WITH {A.PSMS}, p AS (SELECT *, 1 + psm_id % 3 AS charge FROM psms), won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample, scan, charge ORDER BY score DESC, is_decoy DESC, psm_id) AS r FROM p) WHERE r = 1),
f AS (SELECT score, least(1.0::DOUBLE, (count(*) FILTER (WHERE is_decoy) OVER w + 1)::DOUBLE / greatest(count(*) FILTER (WHERE NOT is_decoy) OVER w, 1)) AS fdr FROM won WINDOW w AS (ORDER BY score DESC RANGE UNBOUNDED PRECEDING)),
q AS (SELECT score, min(m) AS q FROM (SELECT score, min(fdr) OVER (ORDER BY score RANGE UNBOUNDED PRECEDING) AS m FROM f) GROUP BY score)
SELECT psm_id, charge, round(q, 9) AS q_value FROM won JOIN q USING (score) WHERE NOT is_decoy""")
def tdc_q_value_by_charge(t):
    """Competition among the matches of a spectrum and charge."""
    df = P.tdc_q_value(t.psms.withColumn("charge", 1 + F.col("psm_id") % 3))
    return df.select("psm_id", "charge", F.round("q_value", 9).alias("q_value"))
