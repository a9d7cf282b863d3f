"""FASTA files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _records(spark: SparkSession, path: str) -> DataFrame:
    """header, seq, file and place of each record: files are split at the line that begins a record."""
    text = spark.read.option("lineSep", "\n>").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")
    )
    value = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "")
    header = F.regexp_extract(value, r"^([^\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace(value, r"^[^\n]*\n?", ""), r"\s", "")
    return text.select(header.alias("header"), seq.alias("seq"), "file", "block", "place").where("header <> '' or seq <> ''")


def scan_fasta(spark: SparkSession, path: str) -> DataFrame:
    """prot_id, name, description, seq. prot_id is the 0-based place in the file (files in the order of their names).

    Places are global in two levels, counts per split and numbers within it, so a large file is not one task.
    """
    rows = _records(spark, path)
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n"))  # a row per file split
    base = counts.withColumn("base", F.sum("n").over(W.orderBy("file", "block")) - F.col("n")).drop("n")
    rows = rows.join(base, ["file", "block"]).withColumn("prot_id", F.col("base") + F.row_number().over(W.partitionBy("file", "block").orderBy("place")) - 1)
    space = F.instr("header", " ")
    return rows.select(
        F.col("prot_id").cast("long").alias("prot_id"), F.substring_index("header", " ", 1).alias("name"),
        F.when(space > 0, F.substring("header", space + 1, F.length("header"))).otherwise("").alias("description"), "seq",
    )


def scan_fasta_legacy(spark: SparkSession, path: str) -> DataFrame:
    """identifier (2nd field), name (3rd field up to a space), readable_name (up to OS=), seq of ``>db|id|name ...``."""
    third = F.split_part("header", F.lit("|"), F.lit(3))
    readable = F.trim(F.regexp_extract(third, r"^\S+\s+(.*?)\s*(?:OS=|$)", 1))
    return _records(spark, path).select(
        F.split_part("header", F.lit("|"), F.lit(2)).alias("identifier"), F.substring_index(third, " ", 1).alias("name"), readable.alias("readable_name"), "seq"
    )


def fasta_lines(proteins: DataFrame) -> DataFrame:
    """One text per record; missing parts are left out."""
    blank = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    header = F.concat_ws(" ", blank("name"), blank("description"))
    return proteins.select(F.concat(F.lit(">"), header, F.lit("\n"), F.col("seq")).alias("value"))


def write_fasta(proteins: DataFrame, path: str) -> None:
    fasta_lines(proteins).write.mode("overwrite").text(path)


def write_fasta_legacy(proteins: DataFrame, path: str) -> None:
    """``>sp|id{prot_id}|name`` headers."""
    value = F.concat(F.lit(">sp|id"), F.col("prot_id").cast("string"), F.lit("|"), F.col("name"), F.lit("\n"), F.col("seq"))
    proteins.select(value.alias("value")).write.mode("overwrite").text(path)
