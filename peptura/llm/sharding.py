"""Sharding by a minimax contiguous partition. DataFrame functions only.

Documents of equal text form an atomic group. Groups stand in the order of their smallest doc_id; contiguous runs of
them are dealt to ``n_shards`` shards so that the largest shard is as small as possible: the smallest capacity is
found by binary search, each capacity is checked greedily, and the cuts of the last feasible one are used.

Scale: up to ``max_atoms`` groups, the atoms are the groups. Beyond, the ordered groups are first folded into stretches
of equal width in the order key. Two bounds of the capacity follow from the stretches' sums, one by cutting before each
stretch, one by cutting through it; only stretches in which a cut of a capacity between the bounds can fall are split
further, until none is left that holds more than one group. So the capacity and the cuts are those of the groups at
every size, after at most 64 passes (two or three where keys are spread evenly). Only the atoms' byte sums reach the
driver: ``max_atoms`` at first, and in each pass as many again or two for each stretch split.
Slots number a shard's rows in the order of doc_id, text_crc32 and size: the rows are sorted by range, and a row's slot is
its place in its partition plus the rows before that. So neither a shard nor a group of copies is one task. Texts that make
up a 4,096th of the rows or more, 4,096 of them at most, get their shard from a broadcast table, all others by a join.

Cases: a null text has size 1 and is a group of its own, an empty text has size 1, equal doc_ids are rows like others,
an empty table gives an empty result, one group larger than the mean stays whole and sets the capacity. Other columns
of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut

HOT = 4_096


def minimax_cuts(sizes: list[int], n_shards: int) -> list[int]:
    """First index of every shard after the first, for the smallest feasible capacity; fewer if shards stay empty."""

    def greedy(cap: int) -> list[int]:
        cuts, held = [], 0
        for i, s in enumerate(sizes):
            if held and held + s > cap:
                cuts.append(i)
                held = 0
            held += s
        return cuts

    lo, hi = max([0, *sizes, -(-sum(sizes) // n_shards)]), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if len(greedy(mid)) < n_shards else (mid + 1, hi)
    return greedy(lo)


def _walk(starts: list[int], whole: list[bool], cap: int, n_shards: int, loose: bool) -> list[int]:
    """Byte places that the shards of one capacity reach, up to the first at the end: if it is not there, it is too small.

    starts: byte places of the atoms' starts, and the end. A place inside an atom is moved back to the atom's start;
    ``loose`` leaves it where it is unless the atom is ``whole``.
    """
    at, out = 0, []
    while len(out) < n_shards:
        out.append(at + cap)
        if out[-1] >= starts[-1]:
            break
        i = bisect_right(starts, out[-1]) - 1
        at = out[-1] if loose and not whole[i] else starts[i]
    return out


def open_atoms(sizes: list[int], whole: list[bool], n_shards: int, biggest: int) -> list[int]:
    """Atoms to be split, as a cut of the smallest capacity can fall inside; biggest: size of the largest group."""
    starts = [0, *accumulate(sizes)]

    def smallest(loose: bool) -> int:
        lo, hi = max(biggest, -(-starts[-1] // n_shards)), starts[-1]
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if _walk(starts, whole, mid, n_shards, loose)[-1] >= starts[-1] else (mid + 1, hi)
        return lo

    # places grow with the capacity and with looseness, so those of the smallest capacity lie between these two
    early = _walk(starts, whole, smallest(True), n_shards, False)
    late = _walk(starts, whole, smallest(False), n_shards, True)
    late += [starts[-1]] * (len(early) - len(late))
    found = set()
    for x, y in zip(early, late, strict=False):
        found.update(i for i in range(bisect_right(starts, x) - 1, bisect_left(starts, min(y, starts[-1]))) if not whole[i])
    return sorted(found)


def shard_documents(
    docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", max_atoms: int = 32_768
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per input row."""
    spark, text = docs.sparkSession, F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        # 96 hash bits and the length name the text; a null is equal to nothing
        F.when(text.isNull(), F.xxhash64(F.lit("null"), F.col(id_col))).otherwise(F.xxhash64(text)).alias("g1"),
        F.when(text.isNull(), F.lit(-1)).otherwise(F.hash(text)).alias("g2"),
    )
    rows = cut(rows)  # the texts are read once
    groups = rows.groupBy("g1", "g2", "size").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"), F.count("*").alias("n"))
    stats = groups.agg(
        F.count("*").alias("groups"), F.sum("n").alias("rows"), F.min("first").alias("least"), F.max("first").alias("most")
    ).first()
    if not stats["groups"]:
        empty = rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
        return empty.withColumn("grown_shard", F.lit(None).cast("int"))
    least, most = (0, 0) if stats["least"] is None else (stats["least"], stats["most"])
    least = max(least - 1, -(1 << 63))  # groups without an id stand first
    key = F.coalesce(F.col("first"), F.lit(least))
    keys = groups.groupBy(key.alias("key")).agg(F.sum("bytes").alias("bytes"))
    # an atom: the keys that are equal but for their last ``shift`` bits
    shift = 0 if stats["groups"] <= max_atoms else _shift(most - least, max_atoms)
    keys = keys if shift == 0 else cut(keys, int(stats["groups"]))
    table = _atoms(keys, [(least, most, shift)])
    biggest = max(r[3] for r in table)
    while todo := open_atoms([r[1] for r in table], [r[2] == 1 for r in table], n_shards, biggest):
        bits = 64 if sum(table[i][2] for i in todo) <= max_atoms else max(1, (max_atoms // len(todo)).bit_length() - 1)
        ranges: list[tuple[int, int, int]] = []
        for i in todo:
            lo, s = table[i][0], table[i][4]
            hi, finer = lo + (1 << s) - 1, max(0, s - bits)
            if ranges and ranges[-1][1] + 1 == lo and ranges[-1][2] == finer:
                lo = ranges.pop()[0]
            ranges.append((lo, hi, finer))
        gone = set(todo)
        table = sorted([r for i, r in enumerate(table) if i not in gone] + _atoms(keys, ranges))
    starts = [table[i][0] for i in minimax_cuts([r[1] for r in table], n_shards)]
    shard = F.lit(0)
    for i, s in enumerate(starts, 1):
        shard = F.when(key >= F.lit(s), F.lit(i)).otherwise(shard)
    where = groups.select("g1", "g2", "size", shard.cast("int").alias("shard"), "n")
    # the few texts that make up much of the rows are looked up, so that no task gets all copies of one
    text_key, n = ["g1", "g2", "size"], int(stats["rows"])
    hot = F.broadcast(where.where(F.col("n") * HOT >= n).drop("n"))  # HOT rows at most
    cold = rows.join(hot, text_key, "left_anti").join(where.where(F.col("n") * HOT < n).drop("n"), text_key)
    order = ["shard", "doc_id", "text_crc32", "size"]
    out = cut(rows.join(hot, text_key).unionByName(cold).select(*order))
    # numbers in the order of shard and doc_id: the rows before each partition of a range sort, and the place in it
    parts = max(8, min(1 << 14, n // 100_000))
    out = cut(out.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    placed = out.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    counts = placed.groupBy("part").agg(F.count("*").alias("c"))  # a row per partition
    base = counts.select("part", (F.sum("c").over(W.orderBy("part")) - F.col("c")).alias("base"))
    firsts = out.groupBy("shard").agg(F.count("*").alias("c"))  # a row per shard
    firsts = firsts.select("shard", (F.sum("c").over(W.orderBy("shard")) - F.col("c")).alias("first"))
    return placed.join(F.broadcast(base), "part").join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _shift(width: int, atoms: int) -> int:
    """Last bits to leave out so that keys of this width fall into no more than so many atoms."""
    shift = 0
    while (width >> shift) + 2 > max(atoms, 3):  # so that 63 is the most
        shift += 1
    return shift


def _atoms(keys: DataFrame, ranges: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Atoms of key ranges (first, last, shift): first key possible, bytes, number of keys, most bytes of a key, shift."""
    key, shift = F.col("key"), F.lit(None).cast("int")
    for lo, hi, s in ranges:
        shift = F.when(key.between(F.lit(lo), F.lit(hi)), F.lit(s)).otherwise(shift)
    part = keys.withColumn("shift", shift).where("shift is not null").withColumn("start", F.expr("shiftleft(shiftright(key, shift), shift)"))
    found = part.groupBy("start", "shift").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.max("bytes").alias("most"))
    return sorted((r["start"], r["bytes"], r["n"], r["most"], r["shift"]) for r in found.collect())
