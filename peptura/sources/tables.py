"""Result tables, lists and the writers of every output."""

from __future__ import annotations

import dataclasses
import typing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed column names of result files, and ours.
RENAMED = {
    "xcorr score": "xcorr", "xcorr rank": "num", "b/y ions matched": "ions_matched", "b/y ions total": "ions_total", "protein id": "proteins",
    "sequence": "seq", "tdc q-value": "q_value", "e-value": "eval", "protein": "proteins", "plain_peptide": "seq",
}
KINDS = {
    "scan": "long", "charge": "int", "num": "int", "ions_matched": "int", "ions_total": "int", "xcorr": "double", "eval": "double",
    "delta_cn": "double", "q_value": "double",
}


def scan_psms(spark: SparkSession, path, sample: str | None = None) -> DataFrame:
    """Matches of result files (tab-separated, or the search program's own form with a version line first). Files of one
    call have one form. sample: from the ``file`` column if there is one, else as given or from the file's name."""
    first = spark.read.text(path).limit(1).collect()
    native = bool(first) and "comet" in first[0][0].split("\t")[0].lower() and "\t" in first[0][0] and "scan" not in first[0][0].split("\t")
    raw = spark.read.option("sep", "\t").option("quote", "")
    if native:
        lines = spark.read.text(path).where(~F.col("value").rlike("^(?i:comet)")).select("value", F.col("_metadata.file_name").alias("__file"))
        names = lines.limit(1).collect()[0][0].split("\t")
        cells = F.split("value", "\t")
        df = lines.where(cells[0] != names[0]).select(*[cells[i].alias(n) for i, n in enumerate(names) if n], "__file")
    else:
        df = raw.option("header", "true").csv(path).withColumn("__file", F.col("_metadata.file_name"))
    stem = lambda c: F.split_part(F.element_at(F.split(c, "/"), -1), F.lit("."), F.lit(1))
    given = F.lit(sample) if sample else stem(F.col("__file"))
    df = df.withColumn("sample", stem(F.col("file")) if "file" in df.columns else given)
    df = df.select(*[F.col(f"`{c}`").alias(RENAMED.get(c, c.replace(" ", "_").replace("/", "_"))) for c in df.columns if c != "__file"])
    for c, kind in KINDS.items():
        df = df.withColumn(c, F.col(c).cast(kind)) if c in df.columns else df
    return df.withColumn("proteins", F.split("proteins", ",")) if "proteins" in df.columns else df


def header_lines(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """Second and third line (column names and first match) of a result file in the search program's own form, else None."""
    first = [r[0] for r in spark.read.text(path).limit(3).collect()]
    return (first[1], first[2]) if len(first) == 3 and "comet" in first[0].lower() else None


def load_comet_psms(spark: SparkSession, folder: str, most_q: float | None = None, top_n: int | None = None) -> DataFrame:
    """Matches of a results folder: those of ``assign-confidence.target.txt`` with a q-value of at most most_q, or the top_n
    ranks of every spectrum of all ``*.comet.target.txt``."""
    folder = folder.rstrip("/")
    if most_q is not None:
        return scan_psms(spark, f"{folder}/assign-confidence.target.txt").where(F.col("q_value") <= most_q)
    if top_n is not None:
        return scan_psms(spark, f"{folder}/*.comet.target.txt").where(F.col("num") <= top_n)
    raise ValueError("either most_q or top_n is needed")


def get_scan_results(spark: SparkSession, native: str, hybrid: str, sample: str, scan: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Matches of a native and of a hybrid result file, of all scans or of one."""
    both = [scan_psms(spark, p, sample) for p in (native, hybrid)]
    native_psms, hybrid_psms = both if scan is None else [df.where(F.col("scan") == scan) for df in both]
    return native_psms, hybrid_psms


def union_scan_results(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Targets and decoys of all one-scan result files of a folder; files without any line are nothing."""
    target, decoy = (scan_psms(spark, f"{folder.rstrip('/')}/*.comet.*-*.{kind}.txt") for kind in ("target", "decoy"))
    return target, decoy


def combine_scan_files(spark: SparkSession, paths, out: str) -> None:
    """One text file per partition in a folder: the header of the files and all their lines but the headers. Every output
    file begins with the header, so that readers take the folder as one table."""
    lines = spark.read.text(paths).where("value <> ''")
    header = lines.first()
    if header is None:
        raise ValueError("all files are empty")
    lines.where(F.col("value") != header[0]).select(F.col("value").alias(header[0])).write.mode("overwrite").option("header", "true").option("quote", "").option("escape", "").option("sep", "\x01").csv(out)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("value <> ''")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def _whole_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.option("wholetext", "true").text(path).collect())


def read_yaml(spark: SparkSession, path: str) -> dict:
    """A settings file. Needs a YAML package, which is imported only here."""
    import yaml

    return yaml.safe_load(_whole_text(spark, path)) or {}


def write_yaml(spark: SparkSession, settings: dict, path: str) -> None:
    import yaml

    spark.createDataFrame([(yaml.safe_dump(settings, sort_keys=False).rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def find_setting(settings: dict, key: str, default=None):
    """The first value of a key at any depth, in the order of the file."""
    if key in settings:
        return settings[key]
    for value in settings.values():
        if isinstance(value, dict) and (found := find_setting(value, key, ...)) is not ...:
            return found
    return default


def save_kmer_map(table: DataFrame, path: str) -> None:
    """kmer, proteins as Parquet or, where the path ends in .json, as JSON lines; other endings are an error."""
    kind = "json" if path.endswith(".json") else "parquet" if path.endswith(".parquet") else None
    write_table(table, path, kind or path.rpartition(".")[2] + " as a k-mer map")


def load_kmer_map(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema("kmer string, proteins array<string>").json if path.endswith(".json") else spark.read.parquet)(path)


def table_rows(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def read_query(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)


def row_count(spark: SparkSession, table: str) -> int:
    return spark.table(table).count()


def prefix_counts_json(counts: DataFrame, path: str) -> None:
    """prefix_counts_by_length as one record per length with its prefixes and counts, the most frequent first. There are as
    many prefixes of a length as distinct ones in the matches."""
    row = F.struct((-F.col("n")).alias("down"), "prefix")
    sorted_rows = F.transform(F.sort_array(F.collect_list(row)), lambda x: F.struct(x["prefix"].alias("prefix"), (-x["down"]).alias("n")))
    write_table(counts.groupBy("length").agg(sorted_rows.alias("prefixes")), path, "json")


def benchmark_scan(spark: SparkSession, path: str) -> DataFrame:
    """``<mzml>.<scan>.log`` tables of run times, with mzml and scan from the file's name."""
    df = spark.read.option("sep", "\t").option("header", "true").option("pathGlobFilter", "*.log").csv(path)
    name = F.col("_metadata.file_name")
    return df.select("*", F.regexp_extract(name, r"^(.+?)\.(\d+)\.log$", 1).alias("mzml"), F.regexp_extract(name, r"^(.+?)\.(\d+)\.log$", 2).cast("long").alias("scan"))


def file_hash(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path"), F.sha2("content", 256).alias("sha256"))


def schema_of(cls: type) -> T.StructType:
    """Columns of a dataclass: int, float and str fields, others are an error; names with a leading _ are left out."""
    kinds = {int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
    fields, hints = [], typing.get_type_hints(cls)
    for f in dataclasses.fields(cls):
        if not f.name.startswith("_"):
            if hints[f.name] not in kinds:
                raise TypeError(f"no column type for {f.name}: {hints[f.name]}")
            fields.append(T.StructField(f.name, kinds[hints[f.name]]))
    return T.StructType(fields)


def insert_dataclasses(spark: SparkSession, rows: list, table: str, cls: type | None = None) -> None:
    """Appends rows to a table, made if need be; no rows are no change."""
    if rows:
        schema = schema_of(cls or type(rows[0]))
        spark.createDataFrame([tuple(getattr(r, n) for n in schema.names) for r in rows], schema).write.mode("append").saveAsTable(table)


def table_info(spark: SparkSession, table: str) -> list[tuple[str, str]]:
    return [(c.name, c.dataType) for c in spark.catalog.listColumns(table)]


def write_table(df: DataFrame, path: str, kind: str) -> None:
    """kind: json, csv, tsv, parquet, lines. Arrays become texts joined by / in csv and tsv."""
    if kind in ("csv", "tsv"):
        flat = [F.array_join(F.col(c).cast("array<string>"), "/").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", "true").option("sep", "," if kind == "csv" else "\t").csv(path)
    elif kind == "lines":
        df.write.mode("overwrite").text(path)
    elif kind in ("json", "parquet"):
        getattr(df.write.mode("overwrite"), kind)(path)
    else:
        raise ValueError(f"no such kind: {kind}")


def hybrids_json(hybrids: DataFrame, path: str) -> None:
    """One record per spectrum and sequence with its hybrids."""
    pair = F.struct("left_seq", "right_seq", "left_proteins", "right_proteins")
    df = hybrids.groupBy("sample", "scan", F.concat("left_seq", "right_seq").alias("seq")).agg(F.sort_array(F.collect_list(pair)).alias("hybrids"))
    write_table(df, path, "json")


def missing_outputs(expected: DataFrame, present: DataFrame) -> DataFrame:
    """expected (file) that are not present (file)."""
    return expected.join(present.select("file"), "file", "left_anti")


def expected_outputs(scans: DataFrame) -> DataFrame:
    """scans (sample, scan) to the target and decoy files of each."""
    kinds = F.explode(F.array(F.lit("target"), F.lit("decoy")))
    return scans.select("sample", "scan", kinds.alias("kind")).select(
        "*", F.concat_ws(".", "sample", F.lit("comet"), F.concat_ws("-", F.col("scan").cast("string"), F.col("scan").cast("string")), "kind", F.lit("txt")).alias("file")
    )
