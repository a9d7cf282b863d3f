"""Substring dedup by recompression: words in windows of ``WINDOW`` words that occur more than once are removed.

Every text is recompressed in three rounds. A round names runs or pairs of symbols; a name is a hash of what it stands
for, so it is the same in every text and on every machine. Pairs are formed where a symbol of the left half of the
alphabet (one hash bit) meets one of the right half, runs where a symbol is repeated. Whether a symbol is formed depends
on its neighbours only, so equal passages get equal symbols but near their ends. With the size limits below a round can
change at most 1, 4 and 4 words at either end, so of 35 equal words at least 17 keep their symbols; a stretch of whole
symbols of at least 10 words (an anchor; never more than 17) that starts at the first of them is shared.

1. Anchors of all texts meet by hash; those seen twice are told to their texts.
2. Windows that start at most 9 words before a shared anchor may be repeats; their full hashes meet in the same way.
3. A text drops the words under windows seen twice.

A window is told by a hash of 64 bits and, by the part it is sent to, by the log2(parts) bits of a second one; words are
not compared again. As parts grow with the input, the number of different windows expected to be taken for equal grows
in proportion to it and not with its square: with six bytes a word and every window a candidate, 2.5 pairs in 100 TB.

Anchors and windows travel as byte strings, one for each part of the hash space and slice of texts. What repeats within
a slice is settled there and sent on twice only, so a passage found everywhere adds two entries a slice, not one a text.
There is one part for every PART_BYTES of input, 12 at least. With more than FAN of them entries are dealt in two steps, by
ranges of parts and then, many slices together, by part: a slice sends FAN rows at most, and a row of the second step holds
the entries of thousands of slices, about 2,000 at 100 TB. The shuffled texts are one exchange that all three steps reuse.

Cases: null and word-less texts keep nothing and lose nothing; texts under a window's length lose nothing; a text may
repeat itself, overlapping too; equal rows and equal ids are rows of their own; an empty table gives an empty result;
very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import over_slices
from .common import WordHashes, input_bytes, mix, ws_words

WINDOW = 35
RUN_MOST, LOST, ANCHOR_LEAST = 4, 9, 10  # words: a named run, lost at either end, an anchor
PART_BYTES, FAN = 32 << 20, 1024
_R = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 18)
        inverse = np.uint64(pow(int(_R), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.append(np.uint64(1), np.full(size, x, np.uint64)), dtype=np.uint64) for x in (_R, inverse)]
    return _powers[0], _powers[1]


def pair_round(s: np.ndarray, size: np.ndarray, doc: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names every pair of a left symbol before a right one."""
    left = (mix(s ^ np.uint64(salt)) & np.uint64(1)).astype(bool)
    joined = np.append(left[:-1] & ~left[1:] & (doc[:-1] == doc[1:]), False) if len(s) else np.zeros(0, bool)
    at = np.flatnonzero(joined)
    s, size = s.copy(), size.copy()
    s[at] = mix(mix(s[at]) * _R + s[at + 1] + np.uint64(salt))
    size[at] += size[at + 1]
    keep = np.ones(len(s), bool)
    keep[at + 1] = False
    return s[keep], size[keep], doc[keep]


def run_round(s: np.ndarray, size: np.ndarray, doc: np.ndarray, most: int = RUN_MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names every maximal run of one symbol that is at most ``most`` words long; longer runs stay as they are."""
    if not len(s):
        return s, size, doc
    start = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])))
    count = np.diff(np.append(start, len(s)))
    named = (count > 1) & (count * size[start] <= most)
    s, size, keep = s.copy(), size.copy(), np.ones(len(s), bool)
    at, n = start[named], count[named]
    s[at] = mix(mix(s[at] + np.uint64(5)) + n.astype(np.uint64) * _R)
    size[at] *= n
    inner = np.repeat(at, n - 1) + (np.arange((n - 1).sum()) - np.repeat(np.cumsum(n - 1) - (n - 1), n - 1)) + 1
    keep[inner] = False
    return s[keep], size[keep], doc[keep]


def anchors(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the anchors of texts laid end to end (doc: the text of each word)."""
    s, size, d = pair_round(h, np.ones(len(h), np.int64), doc, 1)
    s, size, d = run_round(s, size, d)
    s, size, d = pair_round(s, size, d, 2)
    end = np.cumsum(size)
    start = end - size
    j = np.searchsorted(end, start + ANCHOR_LEAST)
    i = np.flatnonzero(j < len(s))
    i = i[d[j[i]] == d[i]]
    j = j[i] + 1
    up, down = _power_tables(len(s) + 1)
    total = np.append(np.uint64(0), np.cumsum(s * up[: len(s)], dtype=np.uint64))
    return start[i], mix((total[j] - total[i]) * down[i] + (end[j - 1] - start[i]).astype(np.uint64))


def window_hashes(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Hashes of all windows of the words, by doubling."""
    n, g, have = len(h) - window + 1, mix(h), 1
    if n <= 0:
        return np.empty(0, np.uint64)
    while have < window:
        step = min(have, window - have)
        g = mix(g[: len(g) - step] * _R + g[step:] + np.uint64(step))
        have += step
    return g[:n]


def _places(keys: np.ndarray, parts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of each key, and the key as it travels (its low bits, marked with the part)."""
    part = mix(keys ^ np.uint64(77)) % np.uint64(parts)
    return part.astype(np.int64), keys if width == 8 else (keys & np.uint64((1 << 8 * width) - 1)) | (part << np.uint64(8 * width))


def _packed(keys: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.uint64)


def _listed(uid: np.ndarray, own: np.ndarray, dest: np.ndarray, blob, out: list[list]) -> None:
    """Entries of some texts (numbers own into uid), in order of dest, as rows (dest, uids, counts, blob(a, b)) added to out."""
    ends = np.append(np.flatnonzero(dest[1:] != dest[:-1]) + 1, len(dest))
    for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
        if a < b:  # there may be no entries at all
            o, n = np.unique(own[a:b], return_counts=True)
            for c, v in zip(out, (int(dest[a]), uid[o].tobytes(), n.astype(np.int32).tobytes(), blob(a, b)), strict=True):
                c.append(v)


def _as_rows(out: list[list]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)]


def _rows(uid: np.ndarray, owner: np.ndarray, keys: np.ndarray, parts: int, width: int, other: np.ndarray | None = None, fan: int = FAN) -> pa.RecordBatch:
    """Entries (text number, key) as rows (part, uids, counts, keys). Keys met twice here are answered at once by rows
    of the parts from ``parts`` on, which are dealt by text. other: a second hash of what the keys stand for, which then
    picks the part. With more than ``fan`` parts, part is one of ``fan`` ranges of them, and keys have all eight bytes, followed
    by their parts."""
    part, key = _places(keys, parts, width)
    if other is not None:
        part = (mix(other) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    place = np.arange(len(k)) - np.flatnonzero(new)[group] if len(k) else group
    twice = np.bincount(group, minlength=1)[group] > 1 if len(k) else np.zeros(0, bool)
    send, answer = order[place < 2], order[twice]
    out: list[list] = [[], [], [], []]

    def emit(entries: np.ndarray, to: np.ndarray, w: int) -> None:
        dest = to if parts <= fan else to * fan // (2 * parts)
        entries = entries[np.lexsort((owner[entries], dest[entries]))]
        blob = lambda a, b: _packed(key[entries[a:b]], w)
        if parts > fan:
            blob = lambda a, b: _packed(key[entries[a:b]], 8) + to[entries[a:b]].astype("<i8").tobytes()
        _listed(uid, owner[entries], dest[entries], blob, out)

    emit(send, part, width)
    emit(answer, parts + (mix(uid.view(np.uint64))[owner] % np.uint64(parts)).astype(np.int64), 8)
    return pa.RecordBatch.from_arrays(_as_rows(out), names=["part", "uids", "counts", "keys"])


def _dealt_again(parts: int, width: int):
    """Rows of one range of parts, of many slices, to rows of its parts."""

    def run(table: pa.Table) -> pa.Table:
        uid = np.frombuffer(b"".join(table.column("uids").to_pylist()), np.int64)
        count = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int32)
        halves = [(raw[: len(raw) // 2], raw[len(raw) // 2 :]) for raw in table.column("keys").to_pylist()]
        key, to = (np.frombuffer(b"".join(h[i] for h in halves), kind) for i, kind in ((0, "<u8"), (1, "<i8")))
        ids, number = np.unique(uid, return_inverse=True)
        owner = np.repeat(number, count)
        order = np.lexsort((owner, to))
        key, to, owner = key[order], to[order], owner[order]
        out: list[list] = [[], [], [], []]
        _listed(ids, owner, to, lambda a, b: _packed(key[a:b], width if to[a] < parts else 8), out)
        return pa.Table.from_arrays(_as_rows(out), names=["part", "uids", "counts", "keys"])

    return run


def _meet(parts: int, width: int):
    """Of one part: (uid, keys) of the keys that occur twice."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        uid = np.frombuffer(b"".join(table.column("uids").to_pylist()), np.int64)
        count = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int32)
        raw = b"".join(table.column("keys").to_pylist())
        owner = np.repeat(np.arange(len(uid)), count)
        if part >= parts:
            keys = _unpacked(raw, 8)
        else:
            keys = _unpacked(raw, width)
            order = np.argsort(keys)
            k = keys[order]
            same = k[1:] == k[:-1]
            twice = np.append(False, same) | np.append(same, False)
            order = order[twice]
            keys, owner = keys[order], owner[order]
            if width < 8:
                keys = keys | (np.uint64(part) << np.uint64(8 * width))
        ids, at = np.unique(uid[owner], return_inverse=True)
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(np.bincount(at, minlength=len(ids)))
        blobs = [keys[order[a:b]].tobytes() for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)] if len(ids) else []
        return pa.table({"uid": pa.array(ids, pa.int64()), "keys": pa.array(blobs, pa.binary())})

    return run


ENTRY = "part long, uids binary, counts binary, keys binary"


def dealt(entries: DataFrame, parts: int, width: int, fan: int = FAN, share: int = 6) -> DataFrame:
    """Entries by part. Those of a part are a third or so of its texts' bytes: as much as ``share`` parts have goes to one task."""
    if parts <= fan:
        return entries
    batch = F.pmod(F.xxhash64("uids"), F.lit(-(-parts // (share * fan)))).alias("batch")
    return entries.select("*", batch).groupBy("part", "batch").applyInArrow(_dealt_again(parts, width), ENTRY)


def _answers(entries: DataFrame, parts: int, width: int, fan: int = FAN) -> DataFrame:
    """(uid, told): the keys of each text that occur twice anywhere."""
    entries = dealt(entries, parts, width, fan)
    met = entries.groupBy("part").applyInArrow(_meet(parts, width), "uid long, keys binary")
    return met.groupBy("uid").agg(F.collect_list("keys").alias("told"))


def _told(blobs) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(blobs), np.uint64)) if blobs else np.empty(0, np.uint64)


def _among(keys: np.ndarray, told: np.ndarray) -> np.ndarray:
    if not len(told):
        return np.zeros(len(keys), bool)
    return told[np.minimum(np.searchsorted(told, keys), len(told) - 1)] == keys


def _anchor_entries(parts: int, window: int, fan: int = FAN):
    def make():
        hashes = WordHashes()

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            hashes.trim()
            words = [ws_words(t) for t in part.column(2).to_pylist()]
            n = np.array([len(w) if len(w) >= window else 0 for w in words], np.int64)
            doc = np.repeat(np.arange(len(n)), n)
            start, key = anchors(hashes.of([x for w, k in zip(words, n, strict=True) if k for x in w]), doc)
            return _rows(part.column(0).to_numpy(zero_copy_only=False), doc[start], key, parts, 5, fan=fan)

        return step

    return make


def _candidate_starts(h: np.ndarray, told: np.ndarray, parts: int, window: int) -> np.ndarray:
    """Starts of windows that may be repeats: at most LOST words before a shared anchor."""
    start, key = anchors(h, np.zeros(len(h), np.int64))
    at = start[_among(_places(key, parts, 5)[1], told)]
    may = np.zeros(len(h) + 1, np.int64)
    np.add.at(may, np.maximum(at - LOST, 0), 1)
    np.add.at(may, at + 1, -1)
    return np.flatnonzero(np.cumsum(may)[: max(len(h) - window + 1, 0)] > 0)


def _window_entries(parts: int, window: int, fan: int = FAN):
    def make():
        hashes = WordHashes()

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            hashes.trim()
            owner, keys, other = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for d, (t, told) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                h = hashes.of(ws_words(t))
                at = _candidate_starts(h, _told(told), parts, window)
                if len(at):
                    keys.append(window_hashes(h, window)[at])
                    other.append(window_hashes(h * _R + np.uint64(3), window)[at])
                owner.append(np.full(len(at), d))
            return _rows(part.column(0).to_numpy(zero_copy_only=False), np.concatenate(owner), np.concatenate(keys), parts, 8, np.concatenate(other), fan)

        return step

    return make


def _remover(window: int):
    def make():
        hashes = WordHashes()

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            hashes.trim()
            n, gone, kept, spans = [], [], [], []
            for t, told in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                words, runs = ws_words(t), []
                n.append(len(words))
                if told:
                    hit = _among(window_hashes(hashes.of(words), window), _told(told)).astype(np.int64)
                    cover = np.zeros(len(words) + 1, np.int64)
                    cover[: len(hit)] += hit
                    cover[window : window + len(hit)] -= hit
                    mask = np.cumsum(cover[:-1]) > 0
                    words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                    runs = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).tolist()
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                spans.append(runs)
            cols = [part.column(1), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept", "spans"])

        return step

    return make


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES, fan: int = FAN) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space), spans (removed, start, end ... in words)."""
    if window < 2 * LOST + ANCHOR_LEAST + 7:
        raise ValueError("the window is too short for the anchors' guarantee")
    parts = max(12, -(-input_bytes(docs, text_col) // part_bytes))
    texts = docs.selectExpr(f"xxhash64(`{id_col}`, `{text_col}`) uid", f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text").repartition("uid")
    first = _answers(texts.mapInArrow(over_slices(_anchor_entries(parts, window, fan), 2), ENTRY), parts, 5, fan)
    joined = texts.join(first.hint("shuffle_hash"), "uid").select("uid", "doc_id", "text", "told")
    second = _answers(joined.mapInArrow(over_slices(_window_entries(parts, window, fan), 2), ENTRY), parts, 8, fan)
    told = texts.join(second.hint("shuffle_hash"), "uid", "left").select("uid", "doc_id", "text", "told")
    return told.mapInArrow(over_slices(_remover(window), 2), "doc_id long, n_words long, n_removed long, kept string, spans array<int>")
