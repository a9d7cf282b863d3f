"""Ranked search by an index of bit-sliced impacts.

A document's impact for a term is ``(10^9 tf) div (1000 tf + 8 m)``, an integer below 2^20 that the query's weight of the term
multiplies. Documents are dealt to blocks as they are read; of a block and a term the index holds one bitmap over the block's
documents for each bit of the impact, in words of 64 documents, and only the words in which the term stands. A search
multiplies such slices by a term's weight and adds them up in slices of scores with bitwise carry arithmetic, 64 documents at
once for all items that hold the term; the best k of a block are found from the most significant slice down. Blocks give k
rows an item at most, of which the best k stay.

What is where: the index is made where texts are read, without a shuffle, and written to the shared folder. A task of the
search holds one block (``BLOCK_BYTES`` of text and ``BLOCK_DOCS`` documents, or one longer text) and one batch of about
``BATCH`` items. The items' distinct terms are sent to the indexing tasks, which then skip other terms, as long as they take no
more than ``VOCABULARY_BYTES``; beyond that all terms are indexed, and the search joins them with the items' terms.

Cases: a null or empty text, or one without terms, is no document of N and is in no result; very long texts are one
document; repeated rows are documents of their own with ranks of their own, and so are null doc_ids, which come after others
of an equal score; items repeat likewise, each row with its own ranks; an item without terms or without a match has no
rows; empty tables give an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import alnum_words, cut, ensure_checkpoint_dir

BLOCK_DOCS, BLOCK_BYTES, BATCH, VOCABULARY_BYTES = 1 << 15, 32 << 20, 256, 8 << 20
RUN, SALTS = 1 << 16, 16
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """N: documents with a term, L: all their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [k for t in b.column(0) if (k := len(alnum_words(t.as_py())))]
            yield pa.RecordBatch.from_arrays([pa.array([len(n)], pa.int64()), pa.array([sum(n)], pa.int64())], names=["docs", "terms"])

    row = docs.selectExpr(f"`{text_col}` text").mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


# ---- slices ----


def add(total: np.ndarray, x: np.ndarray, shift: int = 0) -> None:
    """total += x << shift, both as slices (..., bit, word), the least bit first. total has bits enough."""
    carry = None
    for s in range(x.shape[-2]):
        a, b = total[..., s + shift, :], x[..., s, :]
        half = a ^ b
        if carry is None:
            total[..., s + shift, :], carry = half, a & b
        else:
            both = a & b
            total[..., s + shift, :] = half ^ carry
            carry = both | (half & carry)
    s = x.shape[-2] + shift
    while carry is not None and carry.any():
        a = total[..., s, :].copy()
        total[..., s, :] = a ^ carry
        carry, s = a & carry, s + 1


def times(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Slices (bit, word) times a weight of each word, by shifts and adds."""
    out = np.zeros((x.shape[0] + int(weights.max(initial=0)).bit_length(), x.shape[1]), np.uint64)
    for j in range(int(weights.max(initial=0)).bit_length()):
        keep = np.where((weights >> j) & 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        if keep.any():
            add(out, x & keep, j)
    return out


def best(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of slices (item, bit, word): the documents that are surely among an item's best k, as bitmaps (item, word), and
    those tied for the places left over. Documents of score 0 are neither."""
    tied = np.bitwise_or.reduce(total, axis=1)
    sure = np.zeros_like(tied)
    for s in range(total.shape[1] - 1, -1, -1):
        high = tied & total[:, s]
        n = np.bitwise_count(sure | high).sum(axis=1, dtype=np.int64)
        few, many = (n <= k)[:, None], (n >= k)[:, None]
        sure = np.where(few, sure | high, sure)
        # with k or more above, no one below can enter; with fewer, those above are in and the places left go below
        tied = np.where(many, np.where(few, np.uint64(0), high), tied & ~high)
    return sure, tied


def members(bits: np.ndarray) -> np.ndarray:
    """Places of the ones of a bitmap in words."""
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def scores_at(total: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Values of slices (bit, word) at some places."""
    got = (total[:, places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)
    return (got.astype(np.int64) << np.arange(len(total), dtype=np.int64)[:, None]).sum(axis=0)


def sliced(term: np.ndarray, place: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings in order of (term, place) to slices: the first column of each term, the word of each column, and the
    slices (bit, column)."""
    word = place >> 6
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (word[1:] != word[:-1])
    starts = np.flatnonzero(new)
    bit = np.uint64(1) << (place & 63).astype(np.uint64)
    planes = np.zeros((int(impact.max(initial=0)).bit_length(), len(starts)), np.uint64)
    for s in range(len(planes)):
        planes[s] = np.bitwise_or.reduceat(np.where((impact >> s) & 1, bit, np.uint64(0)), starts)
    return np.flatnonzero(np.diff(term[starts], prepend=-1)), word[starts], planes


def _pack(words: np.ndarray, planes: np.ndarray, small) -> bytes:
    while len(planes) and not planes[-1].any():
        planes = planes[:-1]
    return small.compress(np.array([len(words), len(planes)], "<u4").tobytes() + words.astype("<u4").tobytes() + np.ascontiguousarray(planes).tobytes())


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(raw)
    n, bits = np.frombuffer(raw, "<u4", 2).tolist()
    return np.frombuffer(raw, "<u4", n, 8).astype(np.int64), np.frombuffer(raw, "<u8", n * bits, 8 + 4 * n).reshape(bits, n)


# ---- index ----


class _Block:
    """Documents of one block, and their postings of the terms wanted."""

    def __init__(self, n_docs: int, n_terms: int, wanted: dict[str, int] | None):
        self.all, self.length, self.fixed = n_docs, n_terms, wanted
        self.numbers = {} if wanted is None else wanted
        self.ids, self.held, self.parts = [], 0, []

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = alnum_words(text)
        if not words:
            return
        found, n, numbers = Counter(words), len(words), self.numbers
        if self.fixed is None:
            for t in found.keys() - numbers.keys():
                numbers[t] = len(numbers)
        own = list(found.keys() & numbers.keys()) if self.fixed is not None else list(found)
        m = 100 - 75 + (75 * n * self.all) // self.length
        tf = np.fromiter((found[t] for t in own), np.int64, len(own))
        term = np.fromiter((numbers[t] for t in own), np.int64, len(own))
        self.parts.append((term, np.full(len(own), len(self.ids), np.int64), (10**9 * tf) // (1000 * tf + 8 * m)))
        self.ids.append(doc_id)
        self.held += len(text)

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        """The row of the documents (without a term), then one for each term."""
        small = zstandard.ZstdCompressor(level=1)
        ids = np.array([i or 0 for i in self.ids], "<i8").tobytes() + np.array([i is None for i in self.ids], np.uint8).tobytes()
        yield self._batch(block, [None], [len(self.ids)], [small.compress(ids)])
        term, place, impact = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(term, kind="stable")
        term, place, impact = term[order], place[order], impact[order]
        names = list(self.numbers)
        firsts = np.flatnonzero(np.diff(term, prepend=-1))
        edges, at = np.append(firsts, len(term)), 0
        while at < len(firsts):  # terms by runs of about RUN postings
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + RUN, "right")) - 1)
            own = slice(edges[at], edges[to])
            first, word, planes = sliced(term[own], place[own], impact[own])
            ends = np.append(first, len(word))
            found = [(term[edges[i]], edges[i + 1] - edges[i], _pack(word[s:e], planes[:, s:e], small)) for i, s, e in zip(range(at, to), ends[:-1], ends[1:], strict=True)]
            yield self._batch(block, [names[t].decode("utf-8", "surrogatepass") for t, _, _ in found], [n for _, n, _ in found], [p for _, _, p in found])
            at = to

    @staticmethod
    def _batch(block, terms, df, payload) -> pa.RecordBatch:
        cols = [pa.array([block] * len(terms), pa.int64()), pa.array(terms, pa.string()), pa.array(df, pa.int64()), pa.array(payload, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["block", "term", "df", "payload"])


def impact_index(docs: DataFrame, size: tuple[int, int], vocabulary: set[str] | None = None, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """block, term, df, payload: the slices of each block's terms, and a row without a term that holds its doc_ids. size: as
    corpus_size gives it; vocabulary: the terms to index, all if not given."""
    sent = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(sorted(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        wanted = None if sent is None else {t.encode("utf-8", "surrogatepass"): i for i, t in enumerate(sent.value)}
        at, block = TaskContext.get().partitionId() << 24, _Block(*size, wanted)
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                block.add(i, t.as_py())
                if len(block.ids) >= block_docs or block.held >= BLOCK_BYTES:
                    yield from block.rows(at)
                    at, block = at + 1, _Block(*size, wanted)
        if block.ids:
            yield from block.rows(at)

    df = docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text")
    return df.mapInArrow(run, "block long, term string, df long, payload binary")


# ---- search ----


def _found(k: int):
    """All rows of one block and batch to (item, doc_id, score) of the best k documents of each item."""

    def run(table: pa.Table) -> pa.Table:
        rows = {c: table.column(c).to_pylist() for c in ("item", "term", "weight", "payload")}
        texts, terms, ids = {}, {}, None
        for item, term, weight, payload in zip(*rows.values(), strict=True):
            if item is not None:
                texts[item] = Counter(alnum_words(term))
            elif term is None:
                raw = zstandard.decompress(payload)
                n = len(raw) // 9
                ids = [None if gone else i for i, gone in zip(np.frombuffer(raw, "<i8", n).tolist(), raw[8 * n :], strict=True)]
            elif weight > 0:
                terms[term.encode("utf-8", "surrogatepass")] = (weight, payload)
        items = sorted(i for i, own in texts.items() if own.keys() & terms.keys())
        out = ([], [], [])
        if items:
            most = max(sum(r * terms[t][0] for t, r in texts[i].items() if t in terms) for i in items)
            total = np.zeros((len(items), int(most).bit_length() + 20, -(-len(ids) // 64)), np.uint64)
            _accumulate(total, [texts[i] for i in items], terms)
            sure, tied = best(total, k)
            for n, item in enumerate(items):
                at = members(sure[n])
                left = members(tied[n])
                if len(left) and len(at) < k:  # equal scores go by doc_id
                    left = sorted(left.tolist(), key=lambda p: (ids[p] is None, ids[p] or 0))[: k - len(at)]
                    at = np.concatenate([at, np.array(left, np.int64)])
                out[0].extend([item] * len(at))
                out[1].extend(ids[p] for p in at.tolist())
                out[2].extend(scores_at(total[n], at).tolist())
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("item", "doc_id", "score"), out, strict=True)})

    return run


def _accumulate(total: np.ndarray, items: list[Counter], terms: dict[bytes, tuple[int, bytes]]) -> None:
    """Adds the weighted slices of all terms to the scores of the items that hold them, repeats included."""
    holders: dict[bytes, dict[int, list[int]]] = {}
    for n, own in enumerate(items):
        for t, r in own.items():
            if t in terms:
                holders.setdefault(t, {}).setdefault(r, []).append(n)
    run: list[tuple[bytes, np.ndarray, np.ndarray]] = []
    held = 0

    def flush() -> None:
        planes = np.zeros((20, held), np.uint64)
        ends = np.cumsum([len(w) for _, w, _ in run])
        for (_, w, p), e in zip(run, ends.tolist(), strict=True):
            planes[: len(p), e - len(w) : e] = p
        weights = np.repeat(np.array([terms[t][0] for t, _, _ in run], np.int64), [len(w) for _, w, _ in run])
        weighted = times(planes, weights)
        for (t, w, p), e in zip(run, ends.tolist(), strict=True):
            x = weighted[: len(p) + int(terms[t][0]).bit_length(), e - len(w) : e]
            for r, who in holders[t].items():
                at = np.ix_(who, range(total.shape[1]), w)
                part = total[at]
                for j in range(r.bit_length()):
                    if r >> j & 1:
                        add(part, x, j)
                total[at] = part

    for t in sorted(holders):
        words, planes = _unpack(terms[t][1])
        run.append((t, words, planes))
        held += len(words)
        if held >= RUN:
            flush()
            run, held = [], 0
    if run:
        flush()


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", batch: int = BATCH, vocabulary_bytes: int = VOCABULARY_BYTES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The item's id, rank (from 1), the document's id as doc_id, and score: the k best documents of every item."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    asked = cut(items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text")))
    batches = max(1, -(-asked.count() // batch))
    asked = asked.withColumn("batch", F.pmod(F.xxhash64("item"), F.lit(batches)))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = cut(asked.select("batch", F.explode(F.regexp_extract_all(lower, F.lit(WORDS), F.lit(0))).alias("term")).distinct())
    known = terms.select("term").distinct()
    bounded = (known.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0) <= vocabulary_bytes
    size = corpus_size(docs, text_col)
    index = impact_index(docs, size, {r["term"] for r in known.collect()} if bounded else None, id_col, text_col, block_docs)
    path = f"{spark.sparkContext.getCheckpointDir()}/impacts-{uuid.uuid4().hex}"
    index.write.parquet(path)
    index = spark.read.schema("block long, term string, df long, payload binary").parquet(path)
    # weights: one row for each term asked for
    weight = F.floor(1000 * F.log((2 * F.lit(size[0]) + 2) / (2 * F.col("df") + 1)))
    df = index.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    weights = cut(terms.join(df, "term").select("batch", "term", weight.alias("weight")))
    if bounded:
        hits = index.join(F.broadcast(weights), "term")
    else:  # a frequent term stands in every block: its rows are dealt by block
        salted = weights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = index.where("term is not null").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"])
    blocks = index.where("term is null").withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))).withColumn("batch", F.col("batch").cast("long"))
    none = F.lit(None)
    rows = hits.select("block", "batch", none.cast("long").alias("item"), "term", "weight", "payload")
    rows = rows.unionByName(blocks.select("block", "batch", none.cast("long").alias("item"), "term", none.cast("long").alias("weight"), "payload"))
    # the stated items against all documents, block by block
    rows = rows.unionByName(blocks.select("block", "batch").join(asked, "batch").select("block", "batch", "item", F.coalesce("text", F.lit("")).alias("term"), none.cast("long").alias("weight"), none.cast("binary").alias("payload")))
    found = rows.groupBy("block", "batch").applyInArrow(_found(k), "item long, doc_id long, score long")
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
