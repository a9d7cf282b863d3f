"""The k-mer database on disk: a catalog of masses that the peak join reads in place, and posting blocks of proteins.

The catalog is a table partitioned by ranges of mass, bucketed by mass bin and sorted by mass within a bucket. The peak join
shuffles its probes to the buckets; k-mers are read where they lie, and only from the ranges that some probe touches.

A k-mer's proteins are blocks of at most ``BLOCK_NAMES`` of them, so that a k-mer which all proteins hold is many rows. Proteins
are dealt to blocks before k-mers are made of them, so a block's k-mers are counted where they are made: the letters are
shuffled, the k-mers are not. Ids within a block are the first one and then gaps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.masses import DEFAULT_PPM
from .ions import peak_probes
from .kmers import by_protein, holders, kmer_masses, together

BLOCK_NAMES = 256


@dataclass(frozen=True)
class Catalog:
    """A table of k-mers by mass: bins of ``width`` Da in ``buckets`` buckets, and partitions of ``part`` Da."""

    name: str
    width: float = 0.1
    part: float = 100.0
    buckets: int = 64

    def binned(self, df: DataFrame, mass: str) -> DataFrame:
        return df.withColumn("mass_bin", F.floor(F.col(mass) / self.width)).withColumn("mass_part", F.floor(F.col(mass) / self.part).cast("int"))

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)


def write_catalog(table: DataFrame, catalog: Catalog) -> None:
    """table: kmer, aa_mass and whatever goes with them. Rows are dealt as the buckets are, so each bucket of a partition is
    one file."""
    df = catalog.binned(table.where("aa_mass is not null"), "aa_mass").repartition(catalog.buckets, "mass_bin")
    writer = df.write.mode("overwrite").partitionBy("mass_part").bucketBy(catalog.buckets, "mass_bin").sortBy("mass_bin", "aa_mass")
    writer.format("parquet").saveAsTable(catalog.name)


def create_catalog(proteins: DataFrame, catalog: Catalog, max_k: int, min_k: int = 1) -> None:
    """The catalog of the distinct k-mers of proteins."""
    write_catalog(kmer_masses(proteins, max_k, min_k), catalog)


def touched_parts(probes: DataFrame, catalog: Catalog) -> list[int]:
    """The partitions that some probe touches, a list no longer than the heaviest precursor's mass over ``part``."""
    spans = probes.select(F.floor(F.col("lo") / catalog.part).cast("int").alias("a"), F.floor(F.least("hi", "most") / catalog.part).cast("int").alias("b")).distinct()
    return sorted(r[0] for r in spans.where("a <= b").select(F.explode(F.sequence("a", "b"))).distinct().collect())


def catalog_ion_match(peaks: DataFrame, spectra: DataFrame, catalog: Catalog, ppm: float = DEFAULT_PPM) -> DataFrame:
    """peak_ion_match against a catalog: its k-mers are not shuffled, and partitions that no probe touches are not read."""
    probes = peak_probes(peaks, spectra, ppm).where("hi > 0 and lo <= most")
    table = catalog.rows(peaks.sparkSession).where(F.col("mass_part").isin(touched_parts(probes, catalog))).drop("mass_part")
    bins = F.sequence(F.floor(F.col("lo") / catalog.width), F.floor(F.least("hi", "most") / catalog.width))
    asked = probes.where(F.col("lo") <= F.least("hi", "most")).withColumn("mass_bin", F.explode(bins))
    return asked.join(table.hint("merge"), "mass_bin").where("aa_mass between lo and hi and aa_mass <= most").drop("mass_bin", "lo", "hi", "most")


def kmer_postings(proteins: DataFrame, max_k: int, min_k: int = 1, names: int = BLOCK_NAMES) -> DataFrame:
    """kmer, block, piece, n, first, gaps: the proteins (prot_id, any integers) that hold a k-mer, in rows of at most
    ``names``. A row's ids are ``first`` and then the sums of the gaps."""
    blocks = max(1, -(-proteins.count() // names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, before = None, 0  # pieces that a k-mer may have already, where a block has more letters than are taken together
        for rows, texts, owners in together(batches):
            block, before = rows[0][0], before if rows[0][0] == block else 0
            every = np.array([r[1] for r in rows], np.int64)
            for words, offsets, held in holders(texts, owners, max_k, min_k):
                pieces = -(-np.diff(offsets) // names)
                word = np.repeat(np.arange(len(words)), pieces)
                piece = np.arange(len(word)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begins = offsets[:-1][word] + piece * names
                sizes = np.diff(begins, append=offsets[-1])
                ids = every[held]
                gaps = np.delete(np.diff(ids, prepend=0), begins)
                columns = [pa.array(words).take(pa.array(word)), pa.array(np.full(len(word), block, np.int64)), pa.array((before + piece).astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(ids[begins])]
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes - 1)), pa.int32()), pa.array(gaps)))
                yield pa.RecordBatch.from_arrays(columns, names=["kmer", "block", "piece", "n", "first", "gaps"])
            before += -(-len(rows) // names)

    dealt = proteins.where("prot_id is not null and seq is not null").withColumn("block", F.pmod(F.xxhash64("prot_id"), F.lit(blocks)))
    dealt = by_protein(dealt, "block").select("block", F.col("prot_id").cast("long").alias("prot_id"), "seq").sortWithinPartitions("block", "prot_id")
    return dealt.mapInArrow(run, "kmer string, block long, piece int, n int, first long, gaps array<long>")


def posting_ids(postings: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """kmer, prot_id, and kept columns: a row for each protein."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, gaps = b.column(0).to_numpy(), b.column(1)
            offsets = gaps.offsets.to_numpy()
            more = gaps.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_numpy()
            sizes = np.diff(offsets) + 1
            begins = np.cumsum(sizes) - sizes
            sums = np.empty(len(more) + len(first), np.int64)
            steps = np.ones(len(sums), bool)
            steps[begins] = False
            sums[steps] = more
            sums[begins] = np.diff(first, prepend=0)
            # a row's begin is reached from the last id of the row before
            sums[begins[1:]] -= np.add.reduceat(np.where(steps, sums, 0), begins)[:-1] if len(begins) > 1 else 0
            rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([b.column(2).take(rows), pa.array(np.cumsum(sums)), *[c.take(rows) for c in b.columns[3:]]], names=["kmer", "prot_id", *keep])

    kinds = ", ".join(["kmer string", "prot_id long", *[f"`{c}` {postings.schema[c].dataType.simpleString()}" for c in keep]])
    return postings.select("first", "gaps", "kmer", *keep).mapInArrow(run, kinds)


def proteins_of(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """kmer, prot_id of the k-mers asked for (kmer)."""
    return posting_ids(postings.join(asked.select("kmer").distinct(), "kmer", "left_semi"))


def merged_postings(postings: DataFrame, most: int) -> DataFrame:
    """kmer, prot_ids (sorted) of the k-mers that no more than ``most`` proteins hold: the rest have no list, see posting_ids."""
    few = postings.groupBy("kmer").agg(F.sum("n").alias("n")).where(F.col("n") <= most).select("kmer")
    return posting_ids(postings.join(few, "kmer", "left_semi")).groupBy("kmer").agg(F.sort_array(F.collect_list("prot_id")).alias("prot_ids"))


def write_database(proteins: DataFrame, catalog: Catalog, postings: str, max_k: int, min_k: int = 1, names: int = BLOCK_NAMES) -> None:
    """Both parts: the catalog as a table, and the postings as Parquet in a folder, sorted by k-mer in every file."""
    create_catalog(proteins, catalog, max_k, min_k)
    kmer_postings(proteins, max_k, min_k, names).sortWithinPartitions("kmer").write.mode("overwrite").parquet(postings)
