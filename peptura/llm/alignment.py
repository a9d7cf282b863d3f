"""Alignment of two tokenizers' tokens, and how common the linked pairs of ids are, by a cogroup of postings.

Both tokenizers cut the same bytes (a space and the text); tokens whose bytes overlap are linked. Of every document the
linked id pairs with their multiplicities become postings. Postings go by the id of the first side: a row holds those of
one id in one slice of the texts, so rows follow the input and a row is bounded by a slice. A reader of one id gets a row
with the counts of all its pairs first, no longer than the second vocabulary, then its postings, slice by slice, in the order of
Spark's sort, which spills; so it knows every pair's count and the id's highest one when postings come, and holds one batch of
them. It adds up what they contribute to documents, in bounded memory, and slices sum the contributions by document.

Counts are added up per slice before they are shuffled. Ids with more than ``SPLIT`` postings are dealt by slice to several
readers, each of which gets the counts; the table of such ids is bounded by the vocabulary. Nothing grows with the square of
the input: a slice sends no more rows than it has distinct ids, and gets no more back than it sent.

Cases: texts that are null or empty, or whose bytes a tokenizer does not give back (as with U+2581 in a text), have no tokens:
zeros and empty groups; special tokens' strings are plain text; very long texts are aligned whole, in one task; repeated
rows are documents of their own, each counted; null and equal doc_ids are rows of their own; an empty table gives an empty
result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytepairs import Ids, Pieces, byte_of, load_json, splits_by_pattern
from .common import ensure_checkpoint_dir
from .sentencepieces import MARK, chunks_of

SLICE, STEP, SLICE_DOCS = 16 << 20, 2 << 20, 1 << 16
SPLIT, READER, HELD = 1 << 24, 1 << 24, 1 << 21
_loaded: dict[tuple[str, str], tuple[Side, Side]] = {}


class Side:
    """ids of lists of pieces; sizes: the bytes of each id; a piece that is not given back byte by byte has the id -1."""

    def __init__(self, table: list[bytes], encode, sent):
        self.table, self.sizes = table, np.array([len(b) for b in table], np.int64)

        def ids(pieces: list[str]) -> list[list[int]]:
            found, own = encode(pieces), [sent(p).encode("utf-8", "surrogatepass") for p in pieces]
            flat = np.fromiter(chain.from_iterable(found), np.int64)
            total = np.concatenate([[0], np.cumsum(self.sizes[flat])])[np.cumsum([0, *map(len, found)])]
            # equal sizes piece by piece, and equal bytes altogether
            if (np.diff(total) == [len(x) for x in own]).all() and b"".join(map(table.__getitem__, flat.tolist())) == b"".join(own):
                return found
            return [f if b"".join(map(table.__getitem__, f)) == x else [-1] for f, x in zip(found, own, strict=True)]

        self.of = Ids(ids).of


def byte_side(path: str) -> tuple[Side, Pieces]:
    if not splits_by_pattern(path):
        raise ValueError(f"{path} does not split by the pattern of byte-level tokenizers")
    tok = load_json(path, special_as_text=True)
    names = [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())]
    added = tok.get_added_tokens_decoder()
    table = [b"" if i in added else bytes(map(byte_of, n)) for i, n in enumerate(names)]
    encode = lambda pieces: [e.ids for e in tok.encode_batch_fast(pieces, add_special_tokens=False)]
    return Side(table, encode, lambda p: p), Pieces(tok)


def piece_side(path: str) -> Side:
    from .sentencepieces import Segmenter

    sp = Segmenter(path).sp
    mark = [sp.piece_to_id(MARK)]
    table = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace(MARK, " ").encode() for i in range(sp.get_piece_size()) for p in [sp.id_to_piece(i)]]
    return Side(table, lambda chunks: [f if c else mark for c, f in zip(chunks, sp.encode(chunks, num_threads=1), strict=True)], lambda c: " " + c)


class Aligner:
    """Texts to n_a, n_b, n_groups, n_links, the groups' text, and postings (pair of ids, document, multiplicity)."""

    def __init__(self, first: str, second: str):
        (self.a, self.pieces), self.b = byte_side(first), piece_side(second)
        self.wide = len(self.b.table)
        n, m = len(self.a.table), self.wide
        # ids as decimal text with what follows: A in a run, A at its end, B in a run, at its end, at the text's end
        self.words = np.array([f"{i}{c}" for k, c in ((n, ","), (n, "|"), (m, ","), (m, ";"), (m, "")) for i in range(k)], object)
        self.at = np.cumsum([0, n, n, m, m])

    def __call__(self, texts: list[str | None]):
        count = len(texts)
        a, na = self.a.of([self.pieces(" " + t) if t else [] for t in texts])
        b, nb = self.b.of([chunks_of(t) if t else [] for t in texts])
        doc_a, doc_b = np.repeat(np.arange(count), na), np.repeat(np.arange(count), nb)
        bad = np.array([bool(t) and MARK in t for t in texts], bool)
        bad[doc_a[a < 0]] = bad[doc_b[b < 0]] = True
        if bad.any():
            a, b = a[~bad[doc_a]], b[~bad[doc_b]]
            doc_a, doc_b = doc_a[~bad[doc_a]], doc_b[~bad[doc_b]]
            na, nb = np.where(bad, 0, na), np.where(bad, 0, nb)
        end_a, end_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        if len(a) and (end_a[np.cumsum(na)[na > 0] - 1] != end_b[np.cumsum(nb)[nb > 0] - 1]).any():
            raise RuntimeError("tokens of the two sides differ in their bytes")
        # every stretch between neighbouring ends is one link
        in_a, in_b = (np.zeros(int(end_a[-1]) + 1 if len(a) else 1, bool) for _ in "ab")
        in_a[end_a] = in_b[end_b] = True
        ends, common = np.flatnonzero(in_a | in_b), np.flatnonzero(in_a & in_b)
        upto_a, upto_b, upto_both = (np.cumsum(x, dtype=np.int32) for x in (in_a, in_b, in_a & in_b))
        ia, ib = upto_a[ends] - in_a[ends], upto_b[ends] - in_b[ends]
        doc = doc_a[ia]
        links, groups = np.bincount(doc, minlength=count), np.bincount(doc_a[upto_a[common] - 1], minlength=count)
        key, times = np.unique((a[ia].astype(np.int64) * self.wide + b[ib]) * count + doc, return_counts=True)
        texts = self._texts(a, b, na, nb, upto_both[end_a] - (in_a & in_b)[end_a], upto_both[end_b] - (in_a & in_b)[end_b], upto_a[common], upto_b[common])
        return na, nb, groups, links, texts, key // max(count, 1), key % max(count, 1), times

    def _texts(self, a, b, na, nb, ga, gb, ends_a, ends_b) -> list[str]:
        """The groups of each text: runs of A, then of B. ga, gb: the group of every token; ends_a, ends_b: how many tokens
        there are up to each group's end."""
        out = np.empty(len(a) + len(b), np.int64)
        last = lambda g: np.diff(g, append=len(ends_a)) > 0
        out[np.arange(len(a)) + np.concatenate([[0], ends_b])[ga]] = self.at[0] + a + (self.at[1] - self.at[0]) * last(ga)
        final = np.zeros(len(b), bool)
        final[np.cumsum(nb)[nb > 0] - 1] = True
        out[np.arange(len(b)) + ends_a[gb]] = b + np.where(final, self.at[4], np.where(last(gb), self.at[3], self.at[2]))
        words, edges = self.words[out], np.concatenate([[0], np.cumsum(na + nb)]).tolist()
        return ["".join(words[s:e].tolist()) for s, e in zip(edges, edges[1:], strict=False)]


def _packed(doc: np.ndarray, times: np.ndarray) -> bytes:
    """Numbers below 2**32 by byte planes, as most are small, without the planes that are empty."""
    out = []
    for x in (doc, times):
        planes = x.astype("<u4").view(np.uint8).reshape(-1, 4).T
        n = max(1, int(x.max(initial=0)).bit_length() + 7 >> 3)
        out += [bytes([n]), planes[:n].tobytes()]
    return b"".join(out)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    """Documents and multiplicities of n postings."""
    out, at = np.zeros((2, n, 4), np.uint8), 0
    for row in out:
        k = raw[at]
        row[:, :k] = np.frombuffer(raw, np.uint8, k * n, at + 1).reshape(k, n).T
        at += 1 + k * n
    return out.view("<u4")[:, :, 0].astype(np.int64)


def _ragged(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values))


#: Rows of documents have doc and what follows it, rows of postings what stands before.
_KINDS = {
    "slice": pa.int64(), "a": pa.int32(), "n": pa.int64(), "bs": pa.list_(pa.int32()), "ns": pa.list_(pa.int32()), "postings": pa.binary(),
    "doc": pa.int32(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups": pa.string(),
}
_SCHEMA = (
    "slice long, a int, n long, bs array<int>, ns array<int>, postings binary, "
    "doc int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"
)


def _rows(rows: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(c) if c in columns else pa.nulls(rows, kind) for c, kind in _KINDS.items()], names=list(_KINDS))


def _aligned(first: str, second: str, most: int):
    """Rows (doc_id, text) to a row for each document and one for each slice and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if (first, second) not in _loaded:
            _loaded[first, second] = Aligner(first, second)
        align = _loaded[first, second]
        at, made, chars, parts = TaskContext.get().partitionId() << 32, 0, 0, []

        def documents(ids: list, texts: list) -> pa.RecordBatch:
            *numbers, groups, pair, doc, times = align(texts)
            parts.append((pair, doc + made, times))
            counts = {c: pa.array(x, pa.int64()) for c, x in zip(("n_a", "n_b", "n_groups", "n_links"), numbers, strict=True)}
            own = pa.array(np.arange(made, made + len(ids)), pa.int32())
            return _rows(len(ids), slice=pa.array(np.full(len(ids), at)), doc=own, doc_id=pa.array(ids, pa.int64()), groups=pa.array(groups, pa.string()), **counts)

        def postings() -> Iterator[pa.RecordBatch]:
            pair, doc, times = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(pair * made + doc, kind="stable")
            pair, doc, times = pair[order], doc[order], times[order]
            heads = np.flatnonzero(np.diff(pair, prepend=-1))  # of pairs
            a, b = pair[heads] // align.wide, pair[heads] % align.wide
            firsts = np.flatnonzero(np.diff(a, prepend=-1))  # of ids, among pairs
            if not len(firsts):
                return
            edges = np.append(heads[firsts], len(pair))
            step = np.diff(doc, prepend=0)  # documents of a pair ascend: gaps between them, and the first one
            step[heads] = doc[heads]
            packed = [_packed(step[s:e], times[s:e]) for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            ns = np.diff(np.append(heads, len(pair))).astype(np.int32)
            yield _rows(
                len(firsts), slice=pa.array(np.full(len(firsts), at)), a=pa.array(a[firsts], pa.int32()), n=pa.array(np.diff(edges), pa.int64()),
                bs=_ragged(b.astype(np.int32), firsts), ns=_ragged(ns, firsts), postings=pa.array(packed, pa.binary()),
            )

        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py()
                n = len(t or "")
                if ids and (held + n > STEP or chars + held + n > most or made + len(ids) >= SLICE_DOCS):
                    yield documents(ids, texts)
                    made, chars, ids, texts, held = made + len(ids), chars + held, [], [], 0
                if made and (chars + n > most or made >= SLICE_DOCS):
                    yield from postings()
                    at, made, chars, parts = at + 1, 0, 0, []
                ids.append(i)
                texts.append(t)
                held += n
        if ids:
            yield documents(ids, texts)
            made += len(ids)
        if made:
            yield from postings()

    return run


def _contributed(wide: int):
    """A sorted stream, of each id the counts of its pairs and then its postings by slice, to rows (slice, sums): what the
    postings add to a slice's documents. Sums are held for HELD documents before they are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        sums: dict[int, list[np.ndarray]] = {}
        held = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for at, parts in sums.items():
                doc, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                # int64 sums: weights of bincount would be doubles
                total = np.zeros((2, len(doc)), np.int64)
                for k in (0, 1):
                    np.add.at(total[k], which, np.concatenate([p[k + 1] for p in parts]))
                raw = zstandard.compress(np.concatenate([[len(doc)], doc, *total]).astype("<i8").tobytes(), 3)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([raw], pa.binary())], names=["slice", "sums"])

        for batch in batches:
            a, at, raws, n = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(5), batch.column(6).to_numpy(zero_copy_only=False)
            is_post = np.asarray(batch.column(1).is_valid())
            # counts of this batch follow those of the last id of the batch before
            own = np.flatnonzero(~is_post)
            lists = [(batch.column(c).take(pa.array(own))) for c in (2, 4)]
            sizes = np.diff(lists[0].offsets.to_numpy())
            key = np.repeat(a[own].astype(np.int64), sizes) * wide + lists[0].flatten().to_numpy()
            new = lists[1].flatten().to_numpy()
            pairs, counts = np.concatenate([pairs, key]), np.concatenate([counts, new])
            pairs, where = np.unique(pairs, return_index=True)
            counts = counts[where]
            heads = np.flatnonzero(np.diff(pairs // wide, prepend=-1)) if len(pairs) else np.empty(0, np.int64)
            best = np.repeat(np.maximum.reduceat(counts, heads), np.diff(np.append(heads, len(pairs)))) if len(pairs) else counts
            rows = np.flatnonzero(is_post)
            if len(rows):
                taken = [batch.column(c).take(pa.array(rows)) for c in (2, 3)]
                each = np.diff(taken[0].offsets.to_numpy())
                bs, ns = taken[0].flatten().to_numpy().astype(np.int64), taken[1].flatten().to_numpy().astype(np.int64)
                place = np.searchsorted(pairs, np.repeat(a[rows].astype(np.int64), each) * wide + bs)
                post = [_unpacked(raws[int(r)].as_py(), int(n[r])) for r in rows]
                step, times = np.concatenate(post, axis=1)
                first = np.concatenate([[0], np.cumsum(ns)[:-1]])
                run_sum = np.cumsum(step)
                doc = run_sum - np.repeat(run_sum[first] - step[first], ns)
                count = np.repeat(counts[place], ns)
                top = np.where(np.repeat(counts[place] == best[place], ns), times, 0)
                at_of = np.repeat(at[rows].astype(np.int64), n[rows].astype(np.int64))
                order = np.argsort(at_of, kind="stable")
                at_of, doc, top, count = at_of[order], doc[order], top[order], (count * times)[order]
                edges = np.append(np.flatnonzero(np.diff(at_of, prepend=-1)), len(at_of))
                for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    sums.setdefault(int(at_of[s]), []).append((doc[s:e], top[s:e], count[s:e]))
                held += len(doc)
            if len(pairs):
                keep = pairs // wide == a[-1]
                pairs, counts = pairs[keep], counts[keep]
            if held > HELD:
                yield from sent()
                sums, held = {}, 0
        yield from sent()

    return run


def _summed(docs: pa.Table, sums: pa.Table) -> pa.Table:
    """Rows of one slice's documents, with n_best and count_sum."""
    doc = docs.column("doc").to_numpy()
    total = np.zeros((2, int(doc.max(initial=-1)) + 1), np.int64)
    for raw in sums.column("sums"):
        x = np.frombuffer(zstandard.decompress(raw.as_py()), "<i8")
        n = int(x[0])
        total[:, x[1 : n + 1]] += x[n + 1 :].reshape(2, n)
    out = docs.drop_columns(["slice", "doc"])
    return out.append_column("n_best", pa.array(total[0][doc])).append_column("count_sum", pa.array(total[1][doc]))


def align_documents(
    docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", derive: dict[str, Column] | None = None, slice_chars: int = SLICE, split: int = SPLIT
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum of every row.

    first: a byte-level tokenizer's file, which gets a space and the text; second: a sentencepiece model's, which gets the
    text. groups: ``a1,a2|b1;a3|b2,b3``. derive: columns made of these that stand in place of ``groups``, so that such long texts
    need not be written.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    df = docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text").mapInArrow(_aligned(first, second, slice_chars), _SCHEMA)
    if derive:
        df = df.withColumns({c: F.when(F.col("doc").isNotNull(), x) for c, x in derive.items()}).drop("groups")
    # written once: numbers of slices and documents then hold whatever is lost or read again
    path = f"{spark.sparkContext.getCheckpointDir()}/alignment-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    rows = table.where("a is not null").select("a", "slice", "bs", "ns", "postings", "n")
    found = table.where("doc is not null").drop("a", "n", "bs", "ns", "postings")
    size = rows.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum("n"), F.max("a")).first()
    readers = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size[0] or 0) // READER))
    shares = rows.groupBy("a").agg(F.ceil(F.sum("n") / split).cast("int").alias("shares")).where("shares > 1")  # no more ids than the vocabulary has
    counts = rows.select("a", F.explode(F.arrays_zip("bs", "ns")).alias("p")).groupBy("a", F.col("p.bs").alias("b")).agg(F.sum("p.ns").alias("c"))
    counts = counts.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("b", "c"))).alias("p"))
    counts = counts.join(F.broadcast(shares), "a", "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)))
    rows = rows.join(F.broadcast(shares), "a", "left").withColumn("share", F.when(F.col("shares").isNull(), 0).otherwise(F.pmod(F.xxhash64("slice"), "shares")).cast("int"))
    none = F.lit(None)
    stream = counts.select("a", none.cast("long").alias("slice"), F.col("p.b").alias("bs"), none.cast("array<int>").alias("ns"), F.col("p.c").alias("counts"), none.cast("binary").alias("postings"), none.cast("long").alias("n"), "share")
    stream = stream.unionByName(rows.select("a", "slice", "bs", "ns", none.cast("array<long>").alias("counts"), "postings", "n", "share"))
    stream = stream.repartition(readers, "a", "share").sortWithinPartitions("a", "share", F.asc_nulls_first("slice")).drop("share")
    wide = _width(second)
    sums = stream.mapInArrow(_contributed(wide), "slice long, sums binary")
    kinds = [(f.name, f.dataType.simpleString()) for f in found.schema if f.name not in ("slice", "doc")]
    schema = ", ".join(f"`{n}` {k}" for n, k in [*kinds, ("n_best", "bigint"), ("count_sum", "bigint")])
    return found.groupBy("slice").cogroup(sums.groupBy("slice")).applyInArrow(_summed, schema)


def _width(model: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()
