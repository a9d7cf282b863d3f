"""SentencePiece encoding and decoding over a table of distinct chunks.

No piece of the model holds a whitespace marker after another character (checked when the model is loaded), so merges
never cross from a word into the next marker and a text's ids are those of its chunks, a marker run with the word that
follows, one after another. Texts are read in slices. A slice becomes its distinct chunks and, for every text, the numbers
of its chunks in order. The chunks of all slices make one table, dealt to parts by hash, in which each distinct chunk is
segmented and decoded once by the library; the ids go back to the slices that hold the chunk, and texts take theirs by
position.

What is sent is a packed list per slice and part, and a packed answer to it: a word found everywhere adds one entry a slice,
not one a text. There is a part for every ``PART_BYTES`` of texts, but no more than ``MOST_PARTS``, so that a slice sends a
bounded number of lists however large the input is. A task holds a slice of ``SLICE`` characters (or one longer text), or one
list and the chunks that its part has seen, ``KNOWN`` at most; a part with more than that segments some of them again. Both
branches read the slices from one exchange. A slice's number follows from its place in its
input partition, which files give again if an executor is lost; rows of any other plan are sliced once and written.

Cases: null and empty texts have no ids and decode to the empty text; very long texts are encoded whole; repeated rows
are repeated; null and equal doc_ids are rows of their own; an empty table gives an empty result; other columns are
ignored. A text that holds the marker character itself decodes to a space there, as with the library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from .common import cut, input_bytes

MARK = "▁"
SLICE, PART_BYTES, MOST_PARTS, KNOWN = 16 << 20, 32 << 20, 4096, 1_000_000
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_loaded: dict[str, Segmenter] = {}


class Segmenter:
    """chunk (without its first marker, others as spaces) -> ids as decimal text, and the decoded text if it differs."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        crossing = [p for i in range(sp.get_piece_size()) if MARK in (p := sp.id_to_piece(i)).lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces cross whitespace markers: {crossing[:3]}")

    def __call__(self, chunk: str) -> tuple[str, str | None]:
        ids = self.sp.encode(chunk) if chunk else [self.sp.piece_to_id(MARK)]
        back = self.sp.decode(ids)
        return ",".join(map(str, ids)), None if back == chunk else back


def chunks_of(text: str) -> list[str]:
    """The chunks of a text that is not empty, each without its first marker."""
    if MARK not in text and "  " not in text and text[-1] != " " and text[0] != " ":
        return text.split(" ")
    return [c[1:].replace(MARK, " ") for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]


class _Numbers(dict):
    """chunk -> its number, in the order of first sight."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        return n


def _packed(x: np.ndarray | list[str]) -> bytes:
    """Numbers below 2**32 by byte planes, as most are small; or texts that do not hold the marker, one at least."""
    if isinstance(x, list):
        return zstandard.compress(MARK.join(x).encode("utf-8", "surrogatepass"), 3)
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _texts(raw: bytes) -> list[str]:
    return zstandard.decompress(raw).decode("utf-8", "surrogatepass").split(MARK)


def _slices(most: int, parts: int):
    """Rows (doc_id, text) to one row per slice. Its payload: doc_ids, the number of chunks of each text, the chunks of all
    texts as ranks by frequency, the place of each rank in the list of chunks, that list (by part, then by text), and how
    many of it are of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, base = 0, TaskContext.get().partitionId() << 32
        numbers, ids, counts, places, held = _Numbers(), [], [], [], 0

        def row() -> pa.RecordBatch:
            chunks, flat = list(numbers), np.concatenate([np.empty(0, np.uint32), *places])
            part = [xxhash.xxh64_intdigest(c.encode("utf-8", "surrogatepass")) % parts for c in chunks]
            order = sorted(range(len(chunks)), key=lambda i: (part[i], chunks[i]))
            place = np.empty(len(chunks), np.int64)
            place[order] = np.arange(len(chunks))
            frequent = np.argsort(-np.bincount(flat, minlength=len(chunks)), kind="stable")
            rank = np.empty(len(chunks), np.uint32)
            rank[frequent] = np.arange(len(chunks))
            of_part = np.bincount(np.array(part, np.int64), minlength=parts)
            lists = [np.array(counts), rank[flat], place[frequent], [chunks[i] for i in order], of_part]
            payload = pa.array([_packed(x) for x in lists], pa.binary())
            cols = [pa.array([base + made], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(payload)], pa.int32()), payload)]
            return pa.RecordBatch.from_arrays(cols, names=["slice", "doc_ids", "payload"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py()
                if ids and held + len(t or "") > most:
                    yield row()
                    made, numbers, ids, counts, places, held = made + 1, _Numbers(), [], [], [], 0
                chunks = chunks_of(t) if t else []
                ids.append(i)
                counts.append(len(chunks))
                places.append(np.fromiter(map(numbers.__getitem__, chunks), np.uint32, len(chunks)))
                held += len(t or "")
        if ids:
            yield row()

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices to rows (part, slice, chunks): what each part is asked by a slice."""
    for b in batches:
        for at, payload in zip(b.column(0), b.column(2), strict=True):
            own = payload.as_py()
            count, chunks = _numbers(own[4]), _texts(own[3])
            ends = np.cumsum(count)
            which = np.flatnonzero(count)
            lists = [_packed(chunks[ends[p] - count[p] : ends[p]]) for p in which.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(np.full(len(which), at.as_py())), pa.array(lists, pa.binary())], names=["part", "slice", "chunks"])


def _segmented(model: str, most: int = KNOWN):
    """Rows (part, slice, chunks), those of a part in one partition, to rows (slice, part, ids, at, back): ids of the chunks
    in their order, and the places and decoded texts of those that differ from their chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _loaded:
            _loaded[model] = Segmenter(model)
        segment, known = _loaded[model], {}
        for b in batches:
            for part, at, raw in zip(b.column(0), b.column(1), b.column(2), strict=True):
                chunks = _texts(raw.as_py())
                if len(known) > most:
                    known = {}
                for c in chunks:
                    if c not in known:
                        known[c] = segment(c)
                found = [known[c] for c in chunks]
                changed = [i for i, f in enumerate(found) if f[1] is not None]
                answer = [at.as_py()], [part.as_py()], [_packed([f[0] for f in found])], [changed], [[found[i][1] for i in changed]]
                kinds = pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(answer, kinds, strict=True)], names=["slice", "part", "ids", "at", "back"])

    return run


def _rebuilt(slices: pa.Table, rows: pa.Table) -> pa.Table:
    """One slice and the answers of all parts to (doc_id, n_tokens, ids, decoded)."""
    if slices.num_rows != 1:
        raise RuntimeError("answers without their slice")
    payload, doc_ids = slices.column("payload")[0].as_py(), slices.column("doc_ids")[0].values
    counts, ranks, place = (_numbers(payload[i]) for i in range(3))
    words, codes = _texts(payload[3])[: len(place)], []
    for i in np.argsort(rows.column("part").to_numpy()).tolist() if rows.num_rows else []:
        for n, text in zip(rows.column("at")[i].as_py(), rows.column("back")[i].as_py(), strict=True):
            words[len(codes) + n] = text
        codes += _texts(rows.column("ids")[i].as_py())
    if len(codes) != len(words):
        raise RuntimeError("a slice without its answers")
    order = place.tolist()
    codes, words = [codes[p] for p in order], [words[p] for p in order]
    size = np.array([c.count(",") + 1 for c in codes], np.int64)
    total, out, start = [], ([], []), 0
    for count in counts.tolist():
        own = ranks[start : start + count]
        total.append(int(size[own].sum()) if count else 0)
        own = own.tolist()
        out[0].append(",".join([codes[p] for p in own]))
        out[1].append(" ".join([words[p] for p in own]))
        start += count
    return pa.table({"doc_id": doc_ids, "n_tokens": pa.array(total, pa.int64()), "ids": pa.array(out[0], pa.string()), "decoded": pa.array(out[1], pa.string())})


def _of_files(df: DataFrame) -> bool:
    """Whether the rows are read from files and only projected or filtered, so that a partition read again is the same."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName() not in ("Project", "Filter") and not plan.nodeName().startswith(("LogicalRelation", "Relation")):
            return False
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return True


def parts_of(size: int, part_bytes: int = PART_BYTES, most: int = MOST_PARTS) -> int:
    return min(most, max(16, -(-size // part_bytes)))


def encode_documents(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", as_array: bool = False, slice_bytes: int = SLICE, part_bytes: int = PART_BYTES, most_parts: int = MOST_PARTS
) -> DataFrame:
    """doc_id, n_tokens, ids (decimal ids joined by commas, or an array of int), decoded."""
    df = docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text")
    size = input_bytes(df, "text")
    parts = parts_of(size, part_bytes, most_parts)
    slices = df.mapInArrow(_slices(slice_bytes, parts), "slice long, doc_ids array<long>, payload array<binary>")
    slices = slices if _of_files(df) else cut(slices)
    slices = slices.repartition(max(32, -(-size // slice_bytes)), "slice")
    asked = slices.mapInArrow(_asked, "part int, slice long, chunks binary").repartition(parts, "part")
    answers = asked.mapInArrow(_segmented(model), "slice long, part int, ids binary, at array<int>, back array<string>")
    both = slices.groupBy("slice").cogroup(answers.groupBy("slice"))
    out = both.applyInArrow(_rebuilt, "doc_id long, n_tokens long, ids string, decoded string")
    if as_array:
        out = out.selectExpr("doc_id", "n_tokens", "if(n_tokens = 0, cast(array() as array<int>), cast(split(ids, ',') as array<int>)) ids", "decoded")
    return out
