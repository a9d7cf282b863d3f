"""A corpus pipeline over ``documents``: toxicity, near-dedup, decontamination, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its decisions take effect on the rows or texts that it
returns. All but the last return the columns of ``documents``, other columns as they came whatever their names.

Cases, for all stages: an empty table stays empty. A null or empty text is a document without words: it is scored like any
other, has no near-duplicate, is not contaminated, holds no secret, stays null or empty, and has no ids. Nulls in other
columns are kept. Null and repeated doc_ids name rows of their own: toxicity, decontamination and secrets judge every row by
its text, near-dedup tells rows apart by doc_id and text, and of equal rows, as of any other group, keeps one. Of a group the
row of the least doc_id stays, one without an id only if all are. Very long texts are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptura.llm.common import cut, ensure_checkpoint_dir
from peptura.llm.decontaminate import find_contamination
from peptura.llm.minhash import near_duplicates
from peptura.llm.secrets import mask_secrets, scan_secrets
from peptura.llm.sentencepieces import encode_documents
from peptura.llm.toxicity import score_toxicity

REST, ROW, NULL = "_rest_of_document", "_row_of_document", "_null_text_of_document"


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns as one struct, so that their names cannot clash with an operator's."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("none"))
    return docs.select("doc_id", "text", rest.alias(REST))


def _unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col(REST).getField(c).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _unpacked(score_toxicity(_packed(docs), labels, keep=(REST,)).where("predicted = 0"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates one row stays, of the least doc_id; rows without words all stay.

    Rows go by doc_id and text, so equal or null doc_ids are told apart; of rows that are equal in both, one stays.
    """
    keyed = docs.select(F.xxhash64("doc_id", "text").alias(ROW), *[F.col(f"`{c}`") for c in docs.columns])
    found = near_duplicates(keyed.select(ROW, "text"), id_col=ROW).where("n_shingles > 0")
    found = cut(found.groupBy(F.col("doc_id").alias(ROW)).agg(F.first("component_id").alias("comp"), F.count("*").alias("copies")))
    named = found.join(keyed.select(ROW, "doc_id").distinct(), ROW)
    best = named.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("best"))
    best = best.select(F.col("best").getField(ROW).alias(ROW))
    # the one that stays of several equal rows is added again
    marked = found.join(best.withColumn("stays", F.lit(True)), ROW, "left").where("stays is null or copies > 1")
    marked = cut(marked.select(ROW, F.col("stays").isNotNull().alias("stays")))
    out = keyed.join(marked, ROW, "left_anti")
    again = marked.where("stays")
    if not again.isEmpty():
        out = out.unionByName(keyed.join(again, ROW, "left_semi").dropDuplicates([ROW]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which at least a twentieth of the words lies in benchmark windows."""
    found = find_contamination(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=(REST,))
    return _unpacked(found.where("not (n_hit > 0 and 20 * n_hit >= n_words)"), docs.columns)


def mask_found_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars follows."""
    found = scan_secrets(_packed(docs).withColumn(NULL, F.col("text").isNull()), keep=(REST, NULL))
    some = F.size("found") > 0
    text = F.when(~F.col(NULL), F.col("text"))  # a null text stays null
    out = found.withColumn("masked", mask_secrets("found", "text"))
    columns = []
    for c in docs.columns:
        old = F.col("doc_id") if c == "doc_id" else text if c == "text" else F.col(REST).getField(c)
        new = {"text": F.col("masked"), "n_chars": F.length("masked").cast("long")}.get(c)
        columns.append((old if new is None else F.when(some, new).otherwise(old)).alias(c))
    return out.select(*columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every text."""
    import public_tokenizers

    ids = encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), as_array=True)
    return ids.select("doc_id", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_found_secrets),
    ("encode", encode),
]

#: The toxicity model is trained, which SQL cannot express; the tests hold the run against brute-force stages.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
        if i:  # what the stage read is not needed any more; the last stage's input stays, as its result is read lazily
            _remove(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
