"""K-mers of proteins, their masses and the k-mer table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masses import mass_units
from ..functions.sequences import DISALLOWED, counted
from .settle import settled

CHUNK, PARTITION_BYTES = 128, 16 << 20
#: Letters that are looked at together, or those of one protein if they are more.
LETTERS = 4 << 20
#: Of contains_seq. A query longer than WINDOW has a key of KEY letters at one of the first STRIDE places: WINDOW >= KEY + STRIDE - 2.
WINDOW, KEY, STRIDE, FEW_QUERIES = 16, 8, 8, 500_000
#: Bytes that are looked at together for few queries, and an odd number that spreads prints.
STRETCH, ODD = 256 << 10, np.uint64(0x9E3779B97F4A7C15)
GAP = "\x01"  # stands for a letter that no k-mer may hold


def kmers(proteins: DataFrame, max_k: int, min_k: int = 1, keep: tuple[str, ...] = ("prot_id",), with_mass: bool = False) -> DataFrame:
    """One row per place: kept columns, kmer, start, k, and mass_e7 on request. K-mers with a letter of BXUZOJ are left out.

    Long proteins are cut into overlapping chunks. Of a chunk, each start gives the letters up to max_k or to the next
    letter left out, so a row carries these few letters only and no k-mer is made to be tested and dropped.
    """
    n = F.length("seq")
    df = proteins.select(*keep, "seq", F.explode(counted(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))).alias("c"))
    chunk = F.translate(F.substring("seq", F.col("c") * CHUNK + 1, F.lit(CHUNK + max_k - 1)), DISALLOWED, GAP * len(DISALLOWED))
    df = df.select(*keep, chunk.alias("chunk"), (F.col("c") * CHUNK).alias("base"))
    starts = counted(F.lit(0), F.least(F.length("chunk"), F.lit(CHUNK)) - 1)
    word = lambda s: F.substring_index(F.substring("chunk", s + 1, F.lit(max_k)), GAP, 1)
    words = F.transform(starts, lambda s: F.struct((F.col("base") + s).alias("start"), word(s).alias("word")))
    df = df.select(*keep, F.inline(words)).where(F.length("word") >= min_k)
    df = df.select(*keep, "word", "start", F.explode(F.sequence(F.lit(min_k), F.length("word"))).alias("k"))
    df = df.select(*keep, F.left("word", F.col("k")).alias("kmer"), "start", "k")
    return df.withColumn("mass_e7", mass_units(F.col("kmer"))) if with_mass else df


def by_protein(proteins: DataFrame, key: str) -> DataFrame:
    """Proteins dealt by their key before k-mers are made of them: what is then grouped by k-mer and key is in one place
    already, and the letters are shuffled in place of the k-mers, which are many times as much.

    One partition for each PARTITION_BYTES, within what suits the session.
    """
    spark = proteins.sparkSession
    size = int(str(proteins._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return proteins.repartition(min(max(least, size // PARTITION_BYTES), 20_000) if size < 1 << 50 else least, key)


def unique_kmers(proteins: DataFrame, max_k: int, min_k: int = 1) -> DataFrame:
    return kmers(proteins, max_k, min_k, keep=()).select("kmer").distinct()


def holders(texts: list[str], owners: np.ndarray, max_k: int, min_k: int = 1) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """For each k the distinct k-mers of some texts, and who holds them: offsets of each k-mer's part of the last array, which
    has owners in ascending order, each once. owners: a number from 0 on for each text."""
    every = np.frombuffer((GAP.join(texts) + GAP).encode("utf-32-le"), "<u4")
    seen = np.zeros(int(every.max()) + 1, bool)
    seen[every] = True
    alphabet = np.flatnonzero(seen)
    letter = (np.cumsum(seen) - 1)[every]
    gaps = np.flatnonzero(np.isin(alphabet, [ord(c) for c in GAP + DISALLOWED])[letter])
    run = np.repeat(gaps, np.diff(gaps, prepend=-1)) - np.arange(len(every))  # letters up to the next gap
    owner = np.repeat(owners, [len(t) + 1 for t in texts])
    a, n = len(alphabet), int(owners.max()) + 1
    # a code: the number of the k-mer's begin, which has ``whole`` letters and stands at ``stands``, and then a digit a letter
    code, bound, whole, stands = np.zeros(len(every), np.int64), 1, 0, np.zeros(1, np.int64)
    for k in range(1, max_k + 1):
        if bound * a * n >= 1 << 62:
            at = np.flatnonzero(run[: len(code)] >= k - 1)
            _, stands, code[at] = np.unique(code[at], return_index=True, return_inverse=True)
            stands, bound, whole = at[stands], max(1, len(stands)), k - 1
        code, bound = code[: len(every) - k + 1] * a + letter[k - 1 :], bound * a
        at = np.flatnonzero(run[: len(code)] >= k)
        if k < min_k or not len(at):
            continue
        both = np.sort(code[at] * n + owner[at])
        both = both[np.diff(both, prepend=-1) != 0]
        codes = both // n
        offsets = np.flatnonzero(np.diff(codes, prepend=-1) != 0)
        left, columns = codes[offsets], []
        for _ in range(k - whole):
            left, digit = np.divmod(left, a)
            columns.append(alphabet[digit])
        columns += [every[stands[left] + i] for i in range(whole - 1, -1, -1)]
        word = np.stack(columns[::-1], axis=1).astype("<u4").tobytes().decode("utf-32-le")
        yield [word[i : i + k] for i in range(0, len(word), k)], np.append(offsets, len(both)), both - codes * n


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], np.ndarray]]:
    """Rows (..., key, seq) of equal keys one after another, LETTERS or more at a time: the first rows of keys, texts, and for each
    text the number of its key. Rows of a key are not parted."""
    rows, texts, owners, size = [], [], [], 0
    for b in batches:
        *keys, seqs = (c.to_pylist() for c in b.columns)
        for key, text in zip(zip(*keys, strict=True), seqs, strict=True):
            new = not rows or key != rows[-1]
            if new and (size >= LETTERS or (rows and key[:-1] != rows[-1][:-1])):
                yield rows, texts, np.array(owners)
                rows, texts, owners, size = [], [], [], 0
            if new:
                rows.append(key)
            texts.append(text)
            owners.append(len(rows) - 1)
            size += len(text)
    if rows:
        yield rows, texts, np.array(owners)


def kmer_to_proteins(proteins: DataFrame, max_k: int, min_k: int = 1, attribute: str = "name") -> DataFrame:
    """kmer, proteins: the sorted names (or ids) of the proteins that hold it.

    Tasks make lists for LETTERS letters at a time, and lists are shuffled, not pairs of a k-mer and a name.
    """
    kind = proteins.schema[attribute].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, owners in together(batches):
            names = pa.array([r[0] for r in rows], arrow)
            for words, offsets, held in holders(texts, owners, max_k, min_k):
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(pa.array(held)))
                yield pa.RecordBatch.from_arrays([pa.array(words), lists], names=["kmer", "proteins"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    dealt = by_protein(proteins.where("seq is not null"), attribute).sortWithinPartitions(attribute).select(attribute, "seq")
    lists = dealt.mapInArrow(run, f"kmer string, proteins array<{kind.simpleString()}>")
    return lists.groupBy("kmer").agg(F.sort_array(F.array_compact(F.flatten(F.collect_list("proteins")))).alias("proteins"))


def kmer_counts_by_protein(proteins: DataFrame, max_k: int, min_k: int = 1) -> DataFrame:
    """kmer, prot_id, n: places, not distinct."""
    return kmers(by_protein(proteins, "prot_id"), max_k, min_k).groupBy("kmer", "prot_id").agg(F.count("*").alias("n"))


def kmer_table(proteins: DataFrame, max_k: int, min_k: int = 1) -> DataFrame:
    """kmer, aa_mass, proteins: the searchable table. Masses are computed once per distinct k-mer."""
    return kmer_to_proteins(proteins, max_k, min_k).select("kmer", (mass_units(F.col("kmer")) / F.lit(1e7)).alias("aa_mass"), "proteins")


def kmer_places(proteins: DataFrame, max_k: int, min_k: int = 1) -> DataFrame:
    """kmer, protein, starts: 0-based places in a protein, from the left and not overlapping. A row per k-mer and protein,
    so a k-mer that all proteins hold is many rows, not one long list."""
    df = kmers(by_protein(proteins, "name"), max_k, min_k, keep=("name",)).groupBy("kmer", F.col("name").alias("protein")).agg(F.sort_array(F.collect_list("start")).alias("s"))
    k = F.length("kmer")
    apart = F.forall(F.zip_with(F.slice("s", 2, F.size("s")), F.slice("s", 1, F.size("s") - 1), lambda b, a: b - a), lambda gap: gap >= k)
    picked = F.aggregate("s", F.array().cast("array<int>"), lambda out, x: F.when((F.size(out) == 0) | (x >= F.element_at(out, -1) + k), F.concat(out, F.array(x))).otherwise(out))
    return df.select("kmer", "protein", F.when((F.size("s") == 1) | apart, F.col("s")).otherwise(picked).alias("starts"))


def kmer_masses(proteins: DataFrame, max_k: int, min_k: int = 1) -> DataFrame:
    """kmer, aa_mass of the distinct k-mers: what peaks are matched with."""
    return unique_kmers(proteins, max_k, min_k).withColumn("aa_mass", mass_units(F.col("kmer")) / F.lit(1e7))


def write_kmer_table(table: DataFrame, path: str, width: float = 1.0) -> None:
    """Parquet, partitioned by mass bin and sorted by mass within it: scans of a mass window prune files and row groups."""
    binned = table.withColumn("mass_bin", F.floor(F.col("aa_mass") / width))
    binned.repartition("mass_bin").sortWithinPartitions("mass_bin", "aa_mass").write.mode("overwrite").partitionBy("mass_bin").parquet(path)


def prints(letters: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size, ascending, a number for each window of so many bytes (last axis). Equal windows have equal ones; up to 8 bytes
    different ones differ, beyond that they are told by their first and last 8."""
    wide = letters.astype(np.uint64)
    code, k = wide, 1
    for size in sizes:
        while k < min(size, 8):
            code, k = code[..., :-1] << np.uint64(8) | wide[..., k:], k + 1
        n = max(0, letters.shape[-1] - size + 1)
        yield size, (code[..., :n] if size <= 8 else code[..., :n] * ODD + code[..., size - 8 :]) * ODD


def stretches(batches: Iterator[pa.RecordBatch], step: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of texts, those of ``step`` starts and of windows up to ``most`` there, and where texts end among them."""
    for b in batches:
        seq = b.column(0).cast(pa.large_binary())
        if not len(seq):
            continue
        _, ends, data = seq.buffers()
        ends = np.frombuffer(ends, np.int64)[seq.offset : seq.offset + len(seq) + 1]
        data = np.frombuffer(data or b"", np.uint8)
        for at in range(int(ends[0]), int(ends[-1]), step):
            yield data[at : min(at + step + most - 1, int(ends[-1]))], ends - at


def in_one(at: np.ndarray, size: int, ends: np.ndarray) -> np.ndarray:
    """The starts from which ``size`` bytes stand in one text."""
    return at[at + size <= ends[np.searchsorted(ends, at, "right")]]


def windows_at(letters: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The distinct windows at some starts, sorted."""
    return np.unique(np.lib.stride_tricks.sliding_window_view(letters, size)[at].view(f"S{size}").ravel()) if len(at) else np.zeros(0, f"S{size}")


def as_batch(words: np.ndarray) -> pa.RecordBatch:
    n, size = len(words), words.dtype.itemsize
    made = pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(words.tobytes()))
    return pa.RecordBatch.from_arrays([made], names=["query"])


def by_size(queries: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Size in bytes, ascending: the queries of that size, sorted, and their prints."""
    made, sets = [q.encode() for q in queries], {}
    for size in sorted({len(q) for q in made}):
        words = np.sort(np.array([q for q in made if len(q) == size], f"S{size}"))
        sets[size] = words, next(prints(words.view(np.uint8).reshape(-1, size), [size]))[1].ravel()
    return sets


def held(batches: Iterator[pa.RecordBatch], sets: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The queries that stand in some text, each once. Windows whose print is none of a query's are passed over by a table of bits
    of prints; the others are compared byte by byte. A query that was found is looked for no more."""
    left = {size: np.ones(len(words), bool) for size, (words, _) in sets.items()}
    shift = {size: np.uint64(64 - min(max(len(words).bit_length() + 4, 8), 24)) for size, (words, _) in sets.items()}

    def table(size: int) -> np.ndarray:
        t = np.zeros(1 << (64 - int(shift[size])), bool)
        t[sets[size][1][left[size]] >> shift[size]] = True
        return t

    tables = {size: table(size) for size in sets}
    for letters, ends in stretches(batches, STRETCH, max(sets)):
        for size, made in prints(letters, list(tables)):
            at = np.flatnonzero(tables[size].take((made[:STRETCH] >> shift[size]).view(np.int64)))
            some, words = windows_at(letters, in_one(at, size, ends), size), sets[size][0]
            i = np.minimum(np.searchsorted(words, some), len(words) - 1)
            i = i[(words[i] == some) & left[size][i]]
            if len(i):
                yield as_batch(words[i])
                left[size][i] = False
                tables[size] = table(size)
        tables = {size: t for size, t in tables.items() if left[size].any()}


def windows(batches: Iterator[pa.RecordBatch], sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """The windows of whole letters that have one of the sizes (bytes), each once for LETTERS bytes, or fewer if sizes are large."""
    step = LETTERS * WINDOW // max(WINDOW, *sizes)
    for letters, ends in stretches(batches, step, max(sizes) + 1):
        inside = np.append(letters & 0xC0 == 0x80, False)  # of a letter, not its first byte
        for size in sizes:
            at = np.arange(min(step, max(0, len(letters) - size + 1)))
            at = in_one(at[~inside[at]], size, ends)
            whole = ~inside[at + size]
            yield as_batch(windows_at(letters, at[whole], size))


def contains_seq(proteins: DataFrame, queries: DataFrame) -> DataFrame:
    """Distinct queries (query) that some protein holds, the empty one if there is any protein; a null is held by none.

    Equi-joins, not a loop over pairs, and no text is repeated for its places. Queries of up to WINDOW letters are met by windows
    of the texts, which are as long as such queries are and are looked at as arrays of bytes: where these queries are no more than
    FEW_QUERIES they are sent to all tasks, and only those found are shuffled; otherwise the distinct windows are. Longer ones are
    met through letters of KEY: every STRIDE-th place of a text gives one with the number of its chunk, and so do a query's first
    STRIDE places. Chunks are then fetched by number, and the rest is compared there; chunks of one number are all compared.
    """
    queries = settled(queries.select("query").distinct())
    seqs = proteins.select("seq").where("seq is not null")
    n = F.length("query")
    out = queries.where("query = ''").join(seqs.limit(1), how="left_semi")
    # for each size in bytes up to WINDOW letters, and for longer ones together: how many, and the most letters
    kinds = queries.where(n > 0).groupBy(F.when(n <= WINDOW, F.octet_length("query")).alias("size")).agg(F.count("*").alias("n"), F.max(n).alias("most")).collect()
    sizes = sorted(r["size"] for r in kinds if r["size"] is not None)
    most = max((r["most"] for r in kinds if r["size"] is None), default=0)

    short = queries.where(n.between(1, WINDOW))
    if sizes and sum(r["n"] for r in kinds if r["size"] is not None) <= FEW_QUERIES:
        sent = proteins.sparkSession.sparkContext.broadcast(by_size([r[0] for r in short.collect()]))
        out = out.union(seqs.mapInArrow(lambda batches: held(batches, sent.value), "query string").distinct())
    elif sizes:
        out = out.union(short.join(seqs.mapInArrow(lambda batches: windows(batches, sizes), "query string").distinct(), "query", "left_semi"))
    if not most:
        return out

    texts = seqs.withColumn("c", F.explode(counted(F.lit(0), F.floor((F.length("seq") - 1) / CHUNK).cast("int"))))
    texts = texts.select(F.substring("seq", F.col("c") * CHUNK + 1, F.lit(most + CHUNK)).alias("chunk")).distinct().withColumn("number", F.xxhash64("chunk"))
    places = counted(F.lit(0), F.floor((F.least(F.length("chunk"), F.lit(CHUNK + STRIDE)) - KEY) / STRIDE).cast("int"))
    keys = texts.select("number", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring("chunk", i * STRIDE + 1, F.lit(KEY))))).alias("key"))
    seeds = queries.where(n > WINDOW).select("query", F.explode(F.array_distinct(F.array(*[F.substring("query", o + 1, KEY) for o in range(STRIDE)]))).alias("key"))
    return out.union(seeds.join(keys, "key").select("query", "number").distinct().join(texts, "number").where(F.contains("chunk", F.col("query"))).select("query").distinct())


def proteins_by_name(proteins: DataFrame, names: DataFrame) -> DataFrame:
    return proteins.join(names.select("name"), "name", "left_semi")
