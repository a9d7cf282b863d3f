"""Command line: ``python -m peptura COMMAND ...``. Paths are Spark paths; lists and tables are written as folders."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import kmers, psms, xcorr
from .operators.hybrids import hybrids_fasta
from .plans import older
from .plans.older import OlderConfig
from .plans.search import SearchConfig, find_hybrids
from .plans.settings import ScorerSettings
from .sources import fasta, mzml, tables


def _matches(spark: SparkSession, a: argparse.Namespace):
    return tables.load_comet_psms(spark, a.results, a.q_value, a.top_n_psms)


def create_db(spark: SparkSession, a: argparse.Namespace) -> None:
    """The k-mer table of a FASTA file's proteins, all or those of a list of names."""
    proteins = fasta.scan_fasta(spark, a.fasta)
    if a.protein_names:
        proteins = kmers.proteins_by_name(proteins, tables.read_lines(spark, a.protein_names).toDF("name"))
    kmers.write_kmer_table(kmers.kmer_table(proteins, a.max_k, a.min_k), a.out)


def form_hybrids(spark: SparkSession, a: argparse.Namespace) -> None:
    """Hybrids of the spectra of an mzML file or folder, as JSON and, with --fasta_out, as FASTA."""
    spectra = mzml.scan_mzml(spark, a.mzml)
    spectra = spectra if a.scan is None else spectra.where(F.col("scan") == a.scan)
    config = SearchConfig(min_k=a.min_k, max_k=a.max_k, peak_ppm=a.peak_ppm, precursor_ppm=a.precursor_ppm)
    stored = spark.read.parquet(a.database).select("kmer", "aa_mass") if a.database else None
    found = find_hybrids(spectra.drop("peaks"), mzml.exploded_peaks(spectra), fasta.scan_fasta(spark, a.fasta), config, stored)
    tables.hybrids_json(found, a.out)
    if a.fasta_out:
        fasta.write_fasta(hybrids_fasta(found).distinct(), a.fasta_out)


def protein_abundances(spark: SparkSession, a: argparse.Namespace) -> None:
    """The most frequent proteins of a results folder, a name a line."""
    top = psms.top_n_proteins(psms.protein_counts(_matches(spark, a)), a.top_n_proteins)
    tables.write_table(top.select("protein"), a.out, "lines")


def prefix_abundances(spark: SparkSession, a: argparse.Namespace) -> None:
    """Counts of all prefixes of a results folder's sequences, by length, as JSON."""
    tables.prefix_counts_json(psms.prefix_counts_by_length(_matches(spark, a)), a.out)


def uniq_kmers(spark: SparkSession, a: argparse.Namespace) -> None:
    """The distinct k-mers of a FASTA file, one a line."""
    tables.write_table(kmers.unique_kmers(fasta.scan_fasta(spark, a.fasta), a.max_k, a.min_k), a.out, "lines")


def kmer_counts(spark: SparkSession, a: argparse.Namespace) -> None:
    """How often each k-mer stands in each protein of a FASTA file, as Parquet; a folder that is there stays as it is
    unless --overwrite is given."""
    at = spark._jvm.org.apache.hadoop.fs.Path(a.out)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) and not a.overwrite:
        print(f"{a.out} is there, nothing done")
        return
    tables.write_table(kmers.kmer_counts_by_protein(fasta.scan_fasta(spark, a.fasta), a.k, a.k), a.out, "parquet")


def search(spark: SparkSession, a: argparse.Namespace) -> None:
    """Cross-correlation of the MS2 spectra of an mzML file or folder with all peptides of a FASTA file and their decoys, as
    Parquet by sample; samples that have results are skipped."""
    settings = ScorerSettings(precursor_ppm=a.precursor_ppm, top_n=a.top_n_psms)
    spectra = mzml.scan_mzml(spark, a.mzml)
    peptides = kmers.unique_kmers(fasta.scan_fasta(spark, a.fasta), settings.most_length, settings.least_length).withColumnRenamed("kmer", "seq")
    print("searched:", *xcorr.search_missing(spectra.drop("peaks"), mzml.exploded_peaks(spectra), peptides, a.out, settings))


def older_run(spark: SparkSession, a: argparse.Namespace) -> None:
    """The older engine's result table of an mzML file or folder and a FASTA file, as tab-separated text."""
    config = OlderConfig(max_k=a.max_k, ppm=a.ppm, decimals=a.decimals, num_peaks=a.num_peaks, digest_left=tuple(a.digest_left), digest_right=tuple(a.digest_right))
    tables.write_table(older.run(mzml.scan_mzml(spark, a.mzml), fasta.scan_fasta(spark, a.fasta), config), a.out, "tsv")


def mzml_info(spark: SparkSession, a: argparse.Namespace) -> None:
    """Number of spectra and peaks of each sample."""
    spectra = mzml.scan_mzml(spark, a.mzml)
    spectra.groupBy("sample").agg(F.count("*").alias("spectra"), F.sum(F.size("peaks")).alias("peaks")).orderBy("sample").show(1000, False)


def benchmark_data(spark: SparkSession, a: argparse.Namespace) -> None:
    """The run times of a folder of logs as one CSV table."""
    tables.write_table(tables.benchmark_scan(spark, a.folder), a.out, "csv")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="peptura")
    sub = p.add_subparsers(dest="command", required=True)

    def command(function, *flags: tuple) -> None:
        c = sub.add_parser(function.__name__.replace("_", "-"), help=function.__doc__)
        c.set_defaults(run=function)
        for name, options in flags:
            c.add_argument(f"--{name}", **options)

    need = lambda name, **k: (name, {"required": True, **k})
    may = lambda name, default=None, kind=str: (name, {"default": default, "type": kind})
    d = SearchConfig()
    k = (may("min_k", d.min_k, int), may("max_k", d.max_k, int))
    results = (need("results"), may("q_value", None, float), may("top_n_psms", None, int))
    command(create_db, need("fasta"), need("out"), may("protein_names"), *k)
    command(form_hybrids, need("mzml"), need("fasta"), need("out"), may("database"), may("fasta_out"), may("scan", None, int), may("peak_ppm", d.peak_ppm, float), may("precursor_ppm", d.precursor_ppm, float), *k)
    command(protein_abundances, *results, need("top_n_proteins", type=int), need("out"))
    command(prefix_abundances, *results, need("out"))
    command(uniq_kmers, need("fasta"), need("out"), *k)
    command(kmer_counts, need("fasta"), need("k", type=int), need("out"), ("overwrite", {"action": "store_true"}))
    w, o = ScorerSettings(), OlderConfig()
    command(search, need("mzml"), need("fasta"), need("out"), may("precursor_ppm", w.precursor_ppm, float), may("top_n_psms", w.top_n, int))
    command(older_run, need("mzml"), need("fasta"), need("out"), may("max_k", o.max_k, int), may("ppm", o.ppm, float), may("decimals", o.decimals, int), may("num_peaks", 0, int), may("digest_left", "-"), may("digest_right", "-"))
    command(mzml_info, need("mzml"))
    command(benchmark_data, need("folder"), need("out"))
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(SparkSession.builder.appName("peptura").getOrCreate(), a)


if __name__ == "__main__":
    main()
