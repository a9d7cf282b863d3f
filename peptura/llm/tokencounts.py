"""Token counts by a map-side lookup in two tiers.

Tokens never cross the pieces that a tokenizer splits a text into first, so a text's count is the sum of its pieces' counts.
The first tier is a table of frequent pieces and their counts, sent to every worker once; the second is a bounded cache of
the pieces that a worker has met and had the library encode. Texts are read where they lie: nothing is shuffled.

The table has ``ENTRIES`` pieces of at most ``LONGEST`` characters, so its size is bounded whatever the corpus. It is fitted on
a sample: of ``SAMPLE_PARTS`` input partitions, evenly spaced, texts of about ``SAMPLE_BYTES`` each. The sample decides only which
pieces need no encoding; a piece outside the table is encoded by the library, so counts do not depend on it.

Byte-level files that split by pattern and sentencepiece models without pieces across whitespace markers go by pieces.
Texts that hold an added token's string, and all texts of other tokenizer files, are encoded whole by the library.

Cases: null and empty texts have no bytes and no tokens; very long texts are counted whole; repeated rows are repeated; null
and equal doc_ids are rows of their own; an empty table gives an empty result; other columns are ignored whatever their
names.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from .arrow import over_slices, slices
from .bytepairs import LONGEST, Pieces, load_json, splits_by_pattern

ENTRIES, KEPT = 1 << 16, 1 << 18
SAMPLE_PARTS, SAMPLE_BYTES, SAMPLE_ENTRIES = 4, 8 << 20, 1 << 15
#: Of this worker, by file: they outlive a task.
_loaded: dict[str, Tokenizer] = {}
_met: dict[str, dict[str, int]] = {}


class Tokenizer:
    """split: text -> pieces, or None where only ``whole`` counts right; sizes: pieces -> the number of ids of each."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            tok = load_json(path)
            plain = load_json(path, special_as_text=True)
            added = [t.content for t in tok.get_added_tokens_decoder().values()]
            pieces = Pieces(tok) if splits_by_pattern(path) else None
            self.split = lambda text: None if pieces is None or any(a in text for a in added) else pieces(text)
            self.sizes = lambda found: [len(e) for e in plain.encode_batch_fast(found, add_special_tokens=False)]
            self.whole = lambda text: len(tok.encode(text, add_special_tokens=False))
        else:
            from .sentencepieces import Segmenter, chunks_of

            ids = Segmenter(path)
            self.split = chunks_of
            self.sizes = lambda found: [ids(chunk)[0].count(",") + 1 for chunk in found]
            self.whole = lambda text: len(ids.sp.encode(text))


def _tokenizer(path: str) -> Tokenizer:
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


class Lengths(dict):
    """First tier: the table. Second: ``met``, pieces met before, ``kept`` of them before a new call at most. What neither has
    is encoded, once for all texts of a call."""

    def __init__(self, table: dict[str, int], sizes: Callable[[list[str]], list[int]], kept: int = KEPT, met: dict[str, int] | None = None):
        super().__init__(table)
        self.sizes, self.kept, self.met, self.misses = sizes, kept, {} if met is None else met, 0

    def __missing__(self, piece: str) -> int:
        return self.met[piece]

    def totals(self, texts: list[list[str]]) -> list[int]:
        """The number of ids of each list of pieces."""
        if len(self.met) > self.kept:
            self.met.clear()
        new = list(set().union(*texts) - self.keys() - self.met.keys())
        self.met.update(zip(new, self.sizes(new) if new else (), strict=True))
        self.misses += len(new)
        out = [sum(map(self.__getitem__, t)) for t in texts]
        for piece in new:
            if len(piece) > LONGEST:
                del self.met[piece]
        return out


def pack(table: dict[str, int]) -> bytes:
    """Sizes of the keys in UTF-8, counts, and the keys in a row."""
    keys = [k.encode("utf-8", "surrogatepass") for k in table]
    head = np.array([[len(k) for k in keys], list(table.values())], "<u2") if keys else np.empty((2, 0), "<u2")
    return zstandard.compress(np.uint32(len(keys)).tobytes() + head.tobytes() + b"".join(keys), 9)


def unpack(raw: bytes) -> dict[str, int]:
    raw = zstandard.decompress(raw)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    sizes, counts = np.frombuffer(raw, "<u2", 2 * n, 4).reshape(2, n).astype(np.int64)
    ends = (np.cumsum(sizes) + 4 + 4 * n).tolist()
    return {raw[e - s : e].decode("utf-8", "surrogatepass"): c for e, s, c in zip(ends, sizes.tolist(), counts.tolist(), strict=True)}


def _most(found: Counter, n: int) -> list[tuple[str, int]]:
    """The n most frequent, the lesser piece first of equals."""
    return heapq.nsmallest(n, found.items(), key=lambda x: (-x[1], x[0]))


def _sampled(path: str, step: int):
    """Of every step-th partition, the most frequent pieces of its first SAMPLE_BYTES; others are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if TaskContext.get().partitionId() % step:
            return
        tok, found, held = _tokenizer(path), Counter(), 0
        for batch in batches:
            for part in slices(batch, 0):
                texts = [t for t in part.column(0).to_pylist() if t]
                for t in texts:
                    found.update(p for p in tok.split(t) or () if len(p) <= LONGEST)
                held += sum(map(len, texts))
                if held >= SAMPLE_BYTES:
                    break
            if held >= SAMPLE_BYTES:
                break
        most = _most(found, SAMPLE_ENTRIES)
        yield pa.RecordBatch.from_arrays([pa.array([[m[0] for m in most]], pa.list_(pa.string())), pa.array([[m[1] for m in most]], pa.list_(pa.int64()))], names=["pieces", "counts"])

    return run


def frequent_lengths(docs: DataFrame, tokenizer: str, text_col: str = "text", entries: int = ENTRIES) -> dict[str, int]:
    """piece -> count of ids, of the sample's most frequent pieces: at most SAMPLE_PARTS rows of SAMPLE_ENTRIES are gathered."""
    texts = docs.selectExpr(f"`{text_col}` text")
    step = max(1, -(-texts.rdd.getNumPartitions() // SAMPLE_PARTS))
    found: Counter = Counter()
    for r in texts.mapInArrow(_sampled(tokenizer, step), "pieces array<string>, counts array<long>").collect():
        for piece, n in zip(*r, strict=True):
            found[piece] += n
    most = [p for p, _ in _most(found, entries)]
    return dict(zip(most, _tokenizer(tokenizer).sizes(most) if most else (), strict=True))


def count_tokens(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, table: dict[str, int] | None = None, kept: int = KEPT
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every row. tokenizer: the file's path, the same on
    all workers. table: counts of frequent pieces, made from a sample if not given."""
    df = docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text")
    table = frequent_lengths(docs, tokenizer, text_col) if table is None else table
    sent = docs.sparkSession.sparkContext.broadcast(pack(table))

    def make():
        tok = _tokenizer(tokenizer)
        lengths = Lengths(unpack(sent.value), tok.sizes, kept, _met.setdefault(tokenizer, {}))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            pieces = [tok.split(t) if t else [] for t in texts]
            counts = lengths.totals([p or [] for p in pieces])
            n = np.array([tok.whole(t) if p is None else c for t, p, c in zip(texts, pieces, counts, strict=True)], np.int64)
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return step

    return df.mapInArrow(over_slices(make, 1), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
