"""Benchmark decontamination by winnowing.

Items and documents are fingerprinted alike: of every ``window - k + 1`` consecutive k-gram hashes (one window of
words) the minimum is kept. Two equal windows keep the same k-gram, so every shared span of a window's length meets in
a fingerprint. A document's fingerprints are looked up in the items' fingerprints; around each hit the windows that
hold it are hashed whole and looked up among the items' windows, which extends the hit or drops it. Items shorter than
a window are one window each, found by their first word and then by their whole hash.

The items' index is broadcast if it is of no more than ``index_bytes`` of text, which is counted first; documents are then
never shuffled. Beyond, fingerprints of documents and items meet in an equi-join, and so do the windows around those that
met; texts that met nothing take no further part, and nothing that grows with the benchmark is held in one place. First
words of short items are looked up in a broadcast list while there are no more than ``word_most`` different ones, and
are joined like fingerprints beyond.

Cases: null and empty texts, or texts without words, have no words, no hits and are clean; items without words match
nothing; an item without an id makes hits but is not listed; equal items all count; repeated rows are judged each; empty tables give empty or clean results; very long
texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .arrow import over_slices
from .common import WordHashes, alnum_words, cut, ngram_hashes

MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the minimum of some w consecutive grams (all of equal minima)."""
    m = len(grams) - w + 1
    if m <= 0:
        return np.empty(0, np.int64)
    low = grams[:m].copy()
    for j in range(1, w):
        np.minimum(low, grams[j : j + m], out=low)
    keep = np.zeros(len(grams), bool)
    for j in range(w):
        keep[j : j + m] |= grams[j : j + m] == low
    return np.flatnonzero(keep)


def _grams_at(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """As ngram_hashes, only at some positions."""
    from .common import mix

    out, r = np.zeros(len(at), np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for i in range(n):
        out = out * r + h[at + i]
    return mix(out + np.uint64(n))


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in a sorted table, -1 if absent."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[i] == keys, i, -1)


class Index:
    """Fingerprints and windows of some items. grams: window length -> (sorted hashes, offsets, item numbers)."""

    def __init__(self, items: list[tuple[str, str | None]], window: int, k: int):
        self.window, self.k, hashes = window, k, WordHashes()
        self.ids = [i for i, _ in items]
        prints, first, grams = [], [], {}
        for number, (_, text) in enumerate(items):
            h = hashes.of(alnum_words(text))
            if len(h) >= window:
                kg = ngram_hashes(h, k)
                prints.append(kg[winnow(kg, window - k + 1)])
                g = np.unique(ngram_hashes(h, window))
            elif len(h):
                first.append(h[:1])
                g = ngram_hashes(h, len(h))
            else:
                continue
            grams.setdefault(min(len(h), window), []).append((g, np.full(len(g), number, np.int64)))
        cat = lambda xs: np.unique(np.concatenate(xs)) if xs else np.empty(0, np.uint64)
        self.prints, self.first, self.grams = cat(prints), cat(first), {}
        for n, xs in grams.items():
            g, num = np.concatenate([x[0] for x in xs]), np.concatenate([x[1] for x in xs])
            order = np.lexsort((num, g))
            g, num = g[order], num[order]
            keys, start = np.unique(g, return_index=True)
            self.grams[n] = (keys, np.append(start, len(g)), num)

    def hits(self, h: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words h of texts laid end to end (ends: per word, where its text ends; doc: its text's number):
        a mask of hit words, and unique (text, item) rows."""
        n, mask, pairs = len(h), np.zeros(len(h) + 1, np.int64), []

        def look(at: np.ndarray, size: int) -> None:
            at = at[at + size <= ends[at]]
            keys, offsets, items = self.grams[size]
            i = _find(keys, _grams_at(h, at, size))
            at, i = at[i >= 0], i[i >= 0]
            np.add.at(mask, at, 1)
            np.add.at(mask, at + size, -1)
            both = np.unique(np.stack([doc[at], i], 1), axis=0)
            many = offsets[both[:, 1] + 1] - offsets[both[:, 1]]
            flat = np.repeat(offsets[both[:, 1]] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum()) if len(both) else np.empty(0, np.int64)
            pairs.append(np.stack([np.repeat(both[:, 0], many), items[flat]], 1))

        if self.window in self.grams and n >= self.window:
            kg = ngram_hashes(h, self.k)
            here = np.arange(len(kg))
            kg[here + self.k > ends[: len(kg)]] = MAX  # k-grams that cross texts are never the minimum of a whole window
            at = winnow(kg, self.window - self.k + 1)
            at = at[_find(self.prints, kg[at]) >= 0]
            span = self.window - self.k + 1
            starts = np.unique((at[:, None] - np.arange(span)[None, :]).ravel()) if len(at) else at
            starts = starts[starts >= 0]
            look(starts, self.window)
        if len(self.first) and n:
            at = np.flatnonzero(_find(self.first, h) >= 0)
            for size in [s for s in self.grams if s < self.window]:
                look(at, size)
        found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.int64)
        return np.cumsum(mask[:-1]) > 0, found


def _runs(mask: np.ndarray) -> list[int]:
    """start, end, start, end ... of the runs of True."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).tolist()


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    k: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    index_bytes: int = 16 << 20,
    word_most: int = 1 << 20,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, text, n_words, n_hit, items (sorted strings), spans (start, end, start, end ... in words), and the columns
    of the input named in keep."""
    bench = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    total = bench.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep)
    schema = StructType([
        StructField("doc_id", LongType()), StructField("text", StringType()), StructField("n_words", LongType()),
        StructField("items", ArrayType(StringType())), StructField("spans", ArrayType(IntegerType())), *[base.schema[k] for k in keep],
    ])
    if total <= index_bytes:
        index = docs.sparkSession.sparkContext.broadcast(Index([(r[0], r[1]) for r in bench.collect()], window, k))
        out = base.mapInArrow(over_slices(_matcher(index), 1), schema)
    else:
        out = _met(base, bench, window, k, word_most, keep).mapInArrow(over_slices(_told, 1), schema)
    hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0), lambda a, x: a + x)
    return out.select("doc_id", "text", "n_words", hit.cast("long").alias("n_hit"), "items", "spans", *keep)


PRINT, FIRST = 0, 1  # kinds of keys that bring a text and an item together


def _met(base: DataFrame, bench: DataFrame, window: int, k: int, word_most: int, keep: tuple[str, ...]) -> DataFrame:
    """doc_id, text, items, places (first word * 64 + words of each window that an item has) and the kept columns."""
    spark = base.sparkSession
    item_keys = cut(bench.mapInArrow(over_slices(_keys(window, k, None, True), 1), "kind int, key long").distinct())
    windows = cut(bench.mapInArrow(over_slices(_item_windows(window), 1), "item_id string, size int, hash long").distinct())
    sizes = [r[0] for r in windows.select("size").distinct().collect()]  # window at most
    first = item_keys.where(f"kind = {FIRST}").select("key")
    words = first.limit(word_most + 1).count()
    firsts = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in first.collect()], np.int64).view(np.uint64))) if words <= word_most else None
    # results go by text, so equal texts are looked at once
    named = base.select("text", F.xxhash64("text").alias("u1"), F.xxhash64(F.lit(7), "text").alias("u2")).where("text is not null")
    keys = named.mapInArrow(over_slices(_keys(window, k, firsts, False), 0), "u1 long, u2 long, kind int, key long")
    met = keys.join(item_keys, ["kind", "key"], "left_semi").groupBy("u1", "u2").agg(
        F.collect_set(F.when(F.col("kind") == PRINT, F.col("key"))).alias("prints"), F.collect_set(F.when(F.col("kind") == FIRST, F.col("key"))).alias("firsts")
    )
    texts = named.groupBy("u1", "u2").agg(F.first("text").alias("text")).join(met, ["u1", "u2"])
    looked = cut(texts.select("text", "u1", "u2", "prints", "firsts").mapInArrow(over_slices(_looked(window, k, sizes), 0), "u1 long, u2 long, place long, size int, hash long"))
    places = looked.join(windows.select("size", "hash").distinct(), ["size", "hash"], "left_semi").groupBy("u1", "u2").agg(F.collect_list("place").alias("places"))
    items = looked.select("u1", "u2", "size", "hash").distinct().join(windows, ["size", "hash"]).groupBy("u1", "u2").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    found = places.join(items, ["u1", "u2"])
    out = base.withColumn("__u1", F.xxhash64("text")).withColumn("__u2", F.xxhash64(F.lit(7), "text"))
    out = out.join(found.toDF("__u1", "__u2", "places", "items"), ["__u1", "__u2"], "left")
    return out.select("doc_id", "text", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("places", F.array().cast("array<long>")).alias("places"), *keep)


def _prints(h: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints of one text."""
    grams = ngram_hashes(h, k)
    at = winnow(grams, window - k + 1)
    return at, grams[at]


def _keys(window: int, k: int, firsts, of_items: bool):
    """Rows (item_id, text) to (kind, key), or (text, u1, u2) to (u1, u2, kind, key): fingerprints, and first words, of
    items shorter than a window or all those of a text (that stand in ``firsts``, if given)."""

    def make():
        hashes = WordHashes()

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            hashes.trim()
            rows, kinds, keys = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.uint64)]
            for i, t in enumerate(part.column(1 if of_items else 0).to_pylist()):
                h = hashes.of(alnum_words(t))
                some = np.unique(h) if not of_items else h[:1] if len(h) < window else h[:0]
                if firsts is not None:
                    some = some[_find(firsts.value, some) >= 0]
                for kind, found in ((PRINT, np.unique(_prints(h, window, k)[1])), (FIRST, some)):
                    rows.append(np.full(len(found), i))
                    kinds.append(np.full(len(found), kind, np.int32))
                    keys.append(found)
            row, names = np.concatenate(rows), [] if of_items else ["u1", "u2"]
            cols = [part.column(c).take(pa.array(row)) for c in names]
            return pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(kinds)), pa.array(np.concatenate(keys).view(np.int64))], names=[*names, "kind", "key"])

        return step

    return make


def _item_windows(window: int):
    def make():
        hashes = WordHashes()

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            hashes.trim()
            rows, sizes, keys = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.uint64)]
            for i, t in enumerate(part.column(1).to_pylist()):
                h = hashes.of(alnum_words(t))
                size = min(window, len(h))
                g = np.unique(ngram_hashes(h, size)) if size else keys[0]
                rows.append(np.full(len(g), i))
                sizes.append(np.full(len(g), size, np.int32))
                keys.append(g)
            cols = [part.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(keys).view(np.int64))]
            return pa.RecordBatch.from_arrays(cols, names=["item_id", "size", "hash"])

        return step

    return make


def _looked(window: int, k: int, sizes: list[int]):
    """Rows (text, u1, u2, prints, firsts) to (u1, u2, place, size, hash) of the windows that hold a fingerprint that met, and
    of the shorter ones that begin with a word that did."""

    def make():
        hashes = WordHashes()
        told = lambda xs: np.sort(np.array(xs, np.int64).view(np.uint64))

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            hashes.trim()
            rows, places, of, keys = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.uint64)]
            for i, (t, prints, firsts) in enumerate(zip(*(part.column(c).to_pylist() for c in (0, 3, 4)), strict=True)):
                h = hashes.of(alnum_words(t))
                at, grams = _prints(h, window, k)
                at = at[_find(told(prints), grams) >= 0]
                at = np.unique((at[:, None] - np.arange(window - k + 1)[None, :]).ravel())
                begin = np.flatnonzero(_find(told(firsts), h) >= 0)
                for size in sizes:
                    starts = at if size == window else begin
                    starts = starts[(starts >= 0) & (starts + size <= len(h))]
                    rows.append(np.full(len(starts), i))
                    places.append(starts * 64 + size)
                    of.append(np.full(len(starts), size, np.int32))
                    keys.append(_grams_at(h, starts, size))
            row = pa.array(np.concatenate(rows))
            cols = [part.column(1).take(row), part.column(2).take(row), pa.array(np.concatenate(places)), pa.array(np.concatenate(of)), pa.array(np.concatenate(keys).view(np.int64))]
            return pa.RecordBatch.from_arrays(cols, names=["u1", "u2", "place", "size", "hash"])

        return step

    return make


def _told():
    """Rows (doc_id, text, items, places, kept ...) to the rows of find_contamination."""

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        n, spans = [], []
        for t, places in zip(part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True):
            n.append(len(alnum_words(t)))
            cover = np.zeros(n[-1] + 1, np.int64)
            at, size = np.divmod(np.array(places, np.int64), 64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + size, -1)
            spans.append(_runs(np.cumsum(cover[:-1]) > 0))
        cols = [part.column(0), part.column(1), pa.array(n, pa.int64()), part.column(2), pa.array(spans, pa.list_(pa.int32())), *part.columns[4:]]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", "n_words", "items", "spans", *part.schema.names[4:]])

    return step


def _matcher(index):
    def make():
        hashes, ix = WordHashes(), index.value

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            hashes.trim()
            words = [alnum_words(t) for t in part.column(1).to_pylist()]
            n = np.array([len(w) for w in words], np.int64)
            h = hashes.of([x for w in words for x in w])
            stop = np.cumsum(n)
            doc = np.repeat(np.arange(len(n)), n)
            mask, pairs = ix.hits(h, stop[doc], doc)
            items, spans = [[] for _ in n], [[] for _ in n]
            for d in np.unique(pairs[:, 0]).tolist():
                spans[d] = _runs(mask[stop[d] - n[d] : stop[d]])
                items[d] = sorted({ix.ids[i] for i in pairs[pairs[:, 0] == d, 1]} - {None})
            return pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int32())), *part.columns[2:]],
                names=["doc_id", "text", "n_words", "items", "spans", *part.schema.names[2:]],
            )

        return step

    return make
