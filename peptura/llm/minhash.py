"""MinHash near-dedup: a multi-index Hamming join on b-bit signatures, confirmed on full shingle sets.

A text's shingle set is signed by ``CHUNKS x CHUNK`` minima, each cut to 16 bits. By the pigeonhole principle two
signatures that differ in fewer than 2 x CHUNKS symbols have a chunk that differs in at most one; every chunk is
entered once for each symbol left out, so such pairs always share a key. At a similarity of 0.75 a pair shares no key
with a probability of 0.37^CHUNKS (5e-5), at 0.8 of 2e-6.

Keys are not expanded into all pairs. Equal sets are one node. In each key the members are first paired only with the
key's hub (the member that shares most keys), confirmed, and united. What is then left are pairs of different
components within a key; they are looked at in blocks of bounded size and go on to the exact check only if their
signatures are within the distance and a bound on the intersection allows the similarity: shingles that no other
candidate has cannot be shared. No pair that passes is dropped, so no link is lost.

Cases: null, empty or word-less texts have no set and link with nothing; a text of fewer words than a shingle is one
shingle; equal doc_ids are rows like others (component_id is the least doc_id of a component's rows); an empty table
gives an empty result; very long texts are signed whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import over_slices
from .common import WordHashes, cut, few, least_of_components, lookup, mix, ngram_hashes, shared_components, ws_words

CHUNKS, CHUNK = 10, 5
SYMBOLS = CHUNKS * CHUNK
DISTANCE = 2 * CHUNKS - 1
#: Pairs that share a key are passed on up to this distance: at a similarity of 0.75 one pair in ten thousand lies beyond.
LOOK_DISTANCE = 24
SHINGLE, NUM, DEN = 5, 75, 100
BLOCK = 512
MOST = np.iinfo(np.int64).max
_ODD = (np.random.default_rng(11).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_set(hashes: WordHashes, text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit shingle hashes, sorted; a shorter text is one shingle."""
    h = hashes.of(ws_words(text, lower=True))
    return np.unique(ngram_hashes(h, min(shingle, len(h)))) if len(h) else np.empty(0, np.uint64)


def _signer(shingle: int):
    def make():
        hashes = WordHashes()

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            hashes.trim()
            sets = [shingle_set(hashes, t, shingle) for t in part.column(1).to_pylist()]
            n = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(n)
            k1, k2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            sig: list = [None] * len(n)
            if len(some):
                flat = np.concatenate([sets[i] for i in some])
                at = np.append(0, np.cumsum(n[some])[:-1])
                k1[some] = mix(np.add.reduceat(mix(flat), at) + n[some].astype(np.uint64))
                k2[some] = np.add.reduceat(mix(flat ^ _ODD[0]), at)
                out = np.empty((len(some), SYMBOLS), np.uint16)
                for i, a in enumerate(_ODD):
                    v = flat * a
                    v ^= v >> np.uint64(31)
                    out[:, i] = (mix(np.minimum.reduceat(v * a, at)) & np.uint64(0xFFFF)).astype(np.uint16)
                for j, i in enumerate(some.tolist()):
                    sig[i] = out[j].tobytes()
            return pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(sig, pa.binary())],
                names=["doc_id", "n_shingles", "node", "k2", "sig"],
            )

        return step

    return make


def signature_keys(sigs: np.ndarray) -> np.ndarray:
    """(rows, SYMBOLS) keys: of every chunk, with each symbol left out once."""
    s, out = sigs.astype(np.uint64).reshape(len(sigs), CHUNKS, CHUNK), np.empty((len(sigs), CHUNKS, CHUNK), np.uint64)
    for gone in range(CHUNK):
        k = np.zeros((len(sigs), CHUNKS), np.uint64)
        for j in [j for j in range(CHUNK) if j != gone]:
            k = (k << np.uint64(16)) | s[:, :, j]
        out[:, :, gone] = mix(k + (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(gone)) * np.uint64(0xA24BAED4963EE407))
    return out.reshape(len(sigs), -1)


def _sigs(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            keys = signature_keys(_sigs(b.column(1)))
            node = np.repeat(b.column(0).to_numpy(zero_copy_only=False), SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node)], names=["key", "node"])


def _near_sigs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs (a, b, sig_a, sig_b) within the signature distance."""
    for b in batches:
        if b.num_rows:
            ok = (_sigs(b.column(2)) != _sigs(b.column(3))).sum(1) <= LOOK_DISTANCE
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs (a, b, set_a, set_b) whose sets are similar enough."""
    for b in batches:
        ok = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            ok.append(similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _near_pairs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of the pairs of one block or of two that may be similar, each at the least key it shares."""
    side, node, comp, n, m = (rows.column(k).to_numpy() for k in range(3, 8))
    sig = np.frombuffer(b"".join(rows.column(8).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
    keys, this = signature_keys(sig).view(np.int64), rows.column(0)[0].as_py()
    first, second = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    inter = np.minimum(m[first][:, None], m[second][None])
    ok = DEN * inter >= NUM * (n[first][:, None] + n[second][None] - inter)
    ok &= comp[first][:, None] != comp[second][None]
    i, j = np.nonzero(ok)
    i, j = first[i], second[j]
    once = (node[i] < node[j]) | (side[i] == 1)
    i, j = i[once], j[once]
    near = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        close = (sig[x] != sig[y]).sum(1) <= LOOK_DISTANCE
        x, y = x[close], y[close]
        # a pair is looked at under the least key that it shares, and under no other
        least = np.where(keys[x] == keys[y], keys[x], MOST).min(1) == this
        near[k : k + (1 << 16)][np.flatnonzero(close)[least]] = True
    return i[near], j[near]


def _with_pairs(rows: pa.Table) -> pa.RecordBatch | None:
    """(key, bi, bj, node) of the rows that are in some pair."""
    own = np.unique(np.concatenate(_near_pairs(rows)))
    return rows.select([0, 1, 2, 4]).take(pa.array(own)).combine_chunks().to_batches()[0] if len(own) else None


def _block_links(rows: pa.Table) -> pa.RecordBatch | None:
    """(a, b) of the pairs whose sets are similar enough."""
    node, sets = rows.column(4).to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column(9)]
    links = [(node[i], node[j]) for i, j in zip(*_near_pairs(rows), strict=True) if similar(sets[i], sets[j])]
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in (a, b)], names=["a", "b"]) if links else None


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    z = np.concatenate([x, y])
    z.sort()
    same = int((z[1:] == z[:-1]).sum())
    return DEN * same >= NUM * (len(z) - same)


def _of_blocks(pairs):
    """A mapInArrow function over rows (key, bi, bj, side, node, comp, n, m, sig, ...) sorted by the first three, that
    gives ``pairs`` one block or two at a time."""

    def groups(table: pa.Table, last: bool) -> tuple[list, pa.Table]:
        ids = np.stack([table.column(i).to_numpy() for i in range(3)])
        ends = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1
        cuts = [0, *ends.tolist(), *([table.num_rows] if last else [])]
        out = [table.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
        return out, table.slice(cuts[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for last, b in _with_last(batches):
            table = pa.Table.from_batches([*held, b])
            if table.num_rows:
                done, rest = groups(table, last)
                held = rest.combine_chunks().to_batches()
                for g in done:
                    if g.num_rows > 1 and (out := pairs(g)) is not None:
                        yield out

    return run


def _with_last(it):
    before, some = None, False
    for x in it:
        if some:
            yield False, before
        before, some = x, True
    if some:
        yield True, before


def _sets(shingle: int):
    def make():
        hashes = WordHashes()

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            hashes.trim()
            sets = [shingle_set(hashes, t, shingle) for t in part.column(1).to_pylist()]
            ids = np.array([int(mix(np.array([mix(s).sum() + np.uint64(len(s))], np.uint64))[0]) if len(s) else 0 for s in sets], np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "members"])

        return step

    return make


def _spread(parts: int):
    """Rows (node, members) to (part, nodes, shingles): what each part of the hash space gets of a batch, as bytes."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(1).slice(lo, 256)]
                node = np.repeat(b.column(0).slice(lo, 256).to_numpy(zero_copy_only=False), [len(s) for s in sets])
                flat = np.concatenate(sets)
                part = (flat >> np.uint64(33)) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                which, start = np.unique(part[order], return_index=True)
                ends = np.append(start[1:], len(flat))
                flat, node = flat[order], node[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(which.astype(np.int64)), pa.array([node[a:z].tobytes() for a, z in zip(start, ends, strict=True)], pa.binary()),
                     pa.array([flat[a:z].tobytes() for a, z in zip(start, ends, strict=True)], pa.binary())],
                    names=["part", "nodes", "shingles"],
                )

    return run


def _alone(table: pa.Table) -> pa.Table:
    """Of one part: for each node, how many of its shingles no other node has."""
    node = np.frombuffer(b"".join(table.column("nodes").to_pylist()), np.int64)
    flat = np.frombuffer(b"".join(table.column("shingles").to_pylist()), np.uint64)
    order = np.argsort(flat)
    f = flat[order]
    new = np.append(True, f[1:] != f[:-1])
    single = new & np.append(new[1:], True)
    nodes, count = np.unique(node[order][single], return_counts=True)
    return pa.table({"node": nodes, "own": count.astype(np.int64)})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per input row."""
    base = docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text")
    signed = cut(base.mapInArrow(over_slices(_signer(shingle), 1), "doc_id long, n_shingles long, node long, k2 long, sig binary"))
    rows = signed.count()
    nodes = signed.where("n_shingles > 0").groupBy("node", "k2").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("w")
    )
    nodes = cut(nodes, rows, 20_000)
    keys = nodes.select("node", "sig").mapInArrow(_key_rows, "key long, node long")
    counts = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = cut(keys.join(counts, "key"), SYMBOLS * rows, 500_000)  # the members of keys with more than one
    links = _linked(base, nodes, shared, shingle)
    comp = shared_components(docs.sparkSession, links)
    to_comp = nodes.select("node", "k2", "rep", "w").join(least_of_components(nodes, comp), "node", "left")
    to_comp = cut(to_comp.select("node", "k2", "w", F.coalesce("least", "rep").alias("component_id")), rows)
    own = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"), "k2")
    out = lookup(own, to_comp, ["node", "k2"], ["component_id"], "w", rows, "doc_id").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _linked(base: DataFrame, nodes: DataFrame, shared: DataFrame, shingle: int) -> DataFrame:
    """Confirmed links (a, b) of nodes: enough of them that components come out whole."""
    spark, members = base.sparkSession, shared.count()
    facts = nodes.select("node", "n", "sig")
    # 1. every member with its key's hub
    weight = shared.groupBy("node").agg(F.sum("c").alias("w"))
    hubs = shared.join(weight, "node").groupBy("key").agg(F.max(F.struct("w", "node")).alias("hub")).select("key", F.col("hub.node").alias("hub"))
    star = shared.join(hubs, "key").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    # texts of candidates, once
    want = shared.select("node").distinct().join(nodes.select("node", F.col("rep").alias("doc_id")), "node")
    texts = base.join(want.select("doc_id").distinct().hint("shuffle_hash"), "doc_id")
    sets = texts.select("doc_id", "text").mapInArrow(over_slices(_sets(shingle), 1), "node long, members binary").dropDuplicates(["node"])
    sets = cut(sets.join(want.select("node"), "node", "left_semi"), members, 20_000)

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("node").alias(x), F.col("members").alias(f"set_{x}")) for x in "ab")
        return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm, "a long, b long")

    a, b = (facts.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    able = star.join(a, "a").join(b, "b").where(f"{DEN} * least(n_a, n_b) >= {NUM} * greatest(n_a, n_b)")
    links = cut(confirmed(few(able.select("a", "b", "sig_a", "sig_b"), members).mapInArrow(_near_sigs, "a long, b long")), members)
    # 2. what is left in keys of three or more members: pairs of different components
    comp = shared_components(spark, links, most_rounds=8, settle=False)  # too fine a label only means more pairs
    left = shared.where("c > 2").join(comp, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = left.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    left = cut(left.join(mixed.select("key", "size"), "key"), members)
    left_nodes = left.select("node").distinct()
    total = left_nodes.join(facts, "node").agg(F.sum("n")).first()[0] or 0
    parts = max(16, -(-int(total) // 4_000_000))  # shingles in one part: 64 MB
    own = (
        sets.join(left_nodes, "node", "left_semi")
        .mapInArrow(_spread(parts), "part long, nodes binary, shingles binary")
        .groupBy("part").applyInArrow(_alone, "node long, own long")
        .groupBy("node").agg(F.sum("own").alias("own"))
    )
    able = facts.join(own, "node", "left").select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("m"), "sig").where(f"{DEN} * m >= {NUM} * n")
    rows = left.join(able, "node")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own_block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own_block", "other").alias("bi"), F.greatest("own_block", "other").alias("bj"),
        F.when(F.col("own_block") == F.col("other"), 0).when(F.col("own_block") < F.col("other"), 1).otherwise(2).alias("side"),
        "node", "comp", "n", "m", "sig",
    )
    rows = cut(rows, members)  # read twice below
    blocked = lambda df: df.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    # sets travel only to rows that are in some pair, and pairs that fail are not written
    some = cut(blocked(rows).mapInArrow(_of_blocks(_with_pairs), "key long, bi int, bj int, node long"), members)
    full = rows.join(some, ["key", "bi", "bj", "node"]).join(sets, "node")
    full = full.select("key", "bi", "bj", "side", "node", "comp", "n", "m", "sig", "members")
    rest = blocked(full).mapInArrow(_of_blocks(_block_links), "a long, b long")
    return cut(links.union(rest), members)
