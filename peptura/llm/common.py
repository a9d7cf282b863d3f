"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, everything ASCII that is not a letter or digit to a space; bytes above 0x7F stay.
ALNUM_TABLE = bytes(
    (c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256)
)


def ws_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8 bytes; null has none. ``lower`` maps A-Z only."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_TABLE).split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, kept for the distinct words seen; ``trim`` bounds it."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))

    def trim(self, most: int = 400_000) -> None:
        if len(self) > most:
            self.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) on uint64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams of word hashes; empty when there are fewer than n words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    r = np.uint64(0x9E3779B97F4A7C15)
    for i in range(n):
        out = out * r + h[i : i + m]
    return mix(out + np.uint64(n))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The session's spark.checkpoint.dir is used as it is. Where it is unset, a local session gets a folder of its own, which
    goes with it; on a cluster, where driver and executors share no local folder, that is an error."""
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not where:
            where = tempfile.mkdtemp(prefix="peptura-ckpt-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(where)


def cut(df: DataFrame, rows: int | None = None, per: int = 100_000) -> DataFrame:
    """The rows written to the shared checkpoint folder, with their lineage cut.

    rows: an upper bound of their number, if known: then no more partitions are written than ``rows / per`` (8 at least),
    so that small tables don't leave thousands of tiny files in this and every later shuffle.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return few(df, rows, per).checkpoint(eager=True)


def few(df: DataFrame, rows: int | None, per: int = 100_000) -> DataFrame:
    """No more partitions than rows / per, 8 at least; partitions are merged, not shuffled."""
    return df if rows is None else df.coalesce(max(8, -(-rows // per)))


#: Keys of this part of all rows or more are hot; there are no more than HOT of them.
HOT = 4_096


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str], weight: str, total: int, spread: str) -> DataFrame:
    """rows with the values that table has for their keys, nulls where it has none or the first key is null.

    table: one row per keys, with the number of rows that have them in ``weight``; total: the number of rows. Hot keys are
    broadcast, and their rows are dealt by the column ``spread`` in the join of the others, so no task gets all rows of one.
    """
    hot = F.col(weight) * HOT >= max(total, 1)
    some = table.where(hot).select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)], F.struct(*values).alias("__hot"))
    rest = table.where(~hot).select(*[F.col(k).alias(f"__c{i}") for i, k in enumerate(keys)], F.struct(*values).alias("__cold"))
    on = [F.col(k) == F.col(f"__h{i}") for i, k in enumerate(keys)]
    df = rows.join(F.broadcast(some), on, "left")
    first = F.when(F.col("__hot").isNotNull() | F.col(keys[0]).isNull(), F.xxhash64(F.lit(9), spread)).otherwise(F.col(keys[0]))
    on = [F.col("__key") == F.col("__c0"), *[F.col(k) == F.col(f"__c{i}") for i, k in enumerate(keys) if i]]
    df = df.withColumn("__key", first).join(rest, on, "left")
    found = F.when(F.col(keys[0]).isNotNull(), F.coalesce("__hot", "__cold"))
    return df.select(*rows.columns, *[found.getField(v).alias(v) for v in values])


def least_of_components(nodes: DataFrame, comp: DataFrame, salts: int = 16) -> DataFrame:
    """(node, least) of the nodes in components of more than one: the least ``rep`` of each component's nodes.

    nodes: (node, rep); comp: as shared_components gives it. A large component's nodes are salted, as one row per component
    goes to all of them.
    """
    linked = cut(comp.union(comp.select(F.col("comp").alias("node"), "comp").distinct()).toDF("node", "comp"))
    least = linked.join(nodes.select("node", "rep"), "node").groupBy("comp").agg(F.min("rep").alias("least"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = linked.withColumn("salt", F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(salts)).cast("int"))
    return salted.join(least, ["comp", "salt"]).select("node", "least")


def input_bytes(df: DataFrame, column: str) -> int:
    """Size of the input: the optimizer's estimate for files; where it knows none, the bytes of a text column."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def shared_components(spark: SparkSession, edges: DataFrame, most_rounds: int = 60, settle: bool = True) -> DataFrame:
    """Connected components by alternating large-star and small-star steps: every round is shuffles, nothing is gathered.

    edges: (a, b) of any order. Returns (node, comp), comp the smallest node reachable, for nodes that have an edge and
    are not the smallest. Rounds grow with the log of the diameter. Groups are reduced by min with map-side combining, so
    a hub does not land whole in one task. settle=False stops after ``most_rounds`` with labels that may be too fine.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    rows, before = e.count(), None
    for _ in range(most_rounds):
        # large star: neighbours larger than the node move to the node's smallest neighbour
        both = few(e.select("a", "b").union(e.select(F.col("b"), F.col("a"))), 2 * rows).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c"))
        large = lookup(both.where("v > u"), low, ["u"], ["m"], "c", 2 * rows, "v")
        large = cut(large.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b"), rows)
        # small star: every smaller neighbour moves to the smallest one
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
        small = lookup(large, low, ["a"], ["m"], "c", rows, "b").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(few(small.union(low.select("a", F.col("m").alias("b"))).where("a <> b"), 2 * rows).distinct(), 2 * rows)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
    else:
        if settle:
            raise RuntimeError("components did not settle")
        e = e.groupBy("a").agg(F.min("b").alias("b"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
