"""Embedding near-dedup by a forest of random-projection trees with spill overlap.

Equal unit vectors of a label are one node. In each of ``TREES`` trees a cell is split at the median of a random
projection; vectors within a spill of the cut go to both sides. The spill is 0.8 of the standard deviation that the
projections of a pair at the threshold differ by (0.02 at a cosine of 0.98 in 64 dimensions). A split then parts such a
pair with a probability of 0.004, ten splits with 0.04, twenty with 0.07, so that all five trees miss one with a
probability of 1e-7 to 2e-6. A split sends an eighth of the vectors to both sides: a vector stands in ``TREES * 1.13^depth``
leaves, 11 at 50,000 vectors a label and 50 at 10^8, and each of these copies is sent to its leaf once.

Cells are split ``MOST_DEPTH`` levels at a time over all data. What is routed are ids; projections are taken of one-byte
codes of the vectors, whose error is a thirtieth of the spill. The cuts of a cell come from a sample of about ``SAMPLE``
of its vectors, every vector is routed. The table of cuts is broadcast only up to ``FEW_CELLS`` cells; beyond, it is
joined by cell and salt, so that a hot label's cells are no single task.

Vectors are compared within leaves by matrix products, in double precision. A pair is counted in the first leaf that both
share, so counts are exact without a list of pairs; a leaf sends on sums and the edges of a spanning forest. A leaf that no
cut makes smaller (many near-copies) is compared in blocks of ``BLOCK``, so no task holds more than two blocks, but the
work is quadratic in the size of a group of near-copies.

Cases: null labels, and null, empty, zero or not finite vectors link with nothing and are their own component; vectors
of different length never link; repeated rows are linked like others; equal vec_ids are rows of their own; a null vec_id
is a row like others, kept is false; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import cut, least_of_components, lookup, mix, shared_components

TREES, LEAF, SAMPLE, BLOCK, MOST_DEPTH = 5, 512, 1024, 1024, 6
PATHS = 1 << MOST_DEPTH  # nodes of one subtree, by heap number
FEW_CELLS, SALTS = 1 << 14, 16


def _nodes_of(wide: bool):
    """Rows (vec_id, label, embedding) to (vec_id, node, k2, label, raw, code). node and k2: 128 hash bits of the label and
    the unit vector; nulls if it can't be compared. raw: the vector as it came; code: a scale and a byte a component."""
    kind = np.float64 if wide else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, labels, out = b.column(2), b.column(1).to_pylist(), ([], [], [], [])
            ends = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype(kind)  # a null element becomes nan
            there = lists.is_valid().to_numpy(zero_copy_only=False)
            for i, label in enumerate(labels):
                x = values[ends[i] : ends[i + 1]]
                u = unit(x) if label is not None and there[i] and len(x) and np.isfinite(x).all() and x.any() else None
                row = (None,) * 4
                if u is not None:
                    h = xxhash.xxh3_128_intdigest(label.encode("utf-8", "surrogatepass") + b"\0" + u.tobytes())
                    row = ((h & (1 << 64) - 1) - (1 << 63), (h >> 64) - (1 << 63), x.tobytes(), _code(u))
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            cols = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), cols[0], cols[1], b.column(1), cols[2], cols[3]], names=["vec_id", "node", "k2", "label", "raw", "code"])

    return run


def unit(x: np.ndarray) -> np.ndarray:
    """The unit vector, or the unit vectors of rows, in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(-1, keepdims=True)
    return x / np.sqrt((x * x).sum(-1, keepdims=True)) + 0.0


def _code(u: np.ndarray) -> bytes:
    scale = np.abs(u).max() / 127
    return np.float32(scale).tobytes() + np.rint(u / scale).astype(np.int8).tobytes()


def _decoded(col: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1)
    return np.ascontiguousarray(raw[:, 4:]).view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


_made: dict[tuple[int, int, int], np.ndarray] = {}


def directions(tree: int, stage: int, dim: int) -> np.ndarray:
    """Unit vectors, one for each inner node of a subtree: the cells of one tree and stage share them."""
    key = (tree, stage, dim)
    if key not in _made:
        v = np.random.default_rng(key).normal(size=(PATHS, dim))
        _made[key] = (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)
    return _made[key]


def spill_of(threshold: float, dim: int) -> float:
    return 0.8 * float(np.sqrt(max(2 - 2 * threshold, 1e-9) / dim))


def fit_cuts(p: np.ndarray, size: int, spill: float) -> np.ndarray:
    """Cut of each inner node of one cell's subtree (children of node n are 2n and 2n + 1), nan where there is none, from
    the projections p (a row for each vector of a sample, a column for each node) of a cell of ``size`` vectors."""
    cuts = np.full(PATHS, np.nan, np.float32)
    todo = [(1, np.arange(len(p)))]
    while todo:
        path, own = todo.pop()
        if path >= PATHS or len(own) < 8 or size * len(own) / len(p) <= LEAF:
            continue
        at = np.float32(np.median(p[own, path]))
        low, high = own[p[own, path] <= at + spill], own[p[own, path] >= at - spill]
        if max(len(low), len(high)) > 0.9 * len(own):
            continue
        cuts[path] = at
        todo += [(2 * path, low), (2 * path + 1, high)]
    return cuts


def route(p: np.ndarray, cuts: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of the subtree's leaves that vectors fall into; p and cuts: a row for each vector."""
    rows, path, out = np.arange(len(p)), np.ones(len(p), np.int64), []
    while len(rows):
        inner = path < PATHS
        at = np.full(len(rows), np.nan, np.float32)
        at[inner] = cuts[rows[inner], path[inner]]
        stay = np.isnan(at)
        out.append((rows[stay], path[stay]))
        rows, path, at = rows[~stay], path[~stay], at[~stay]
        own = p[rows, path]
        low, high = own <= at + spill, own >= at - spill
        rows, path = np.concatenate([rows[low], rows[high]]), np.concatenate([2 * path[low], 2 * path[high] + 1])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2


def _fit(stage: int, threshold: float):
    """Of the sampled rows (cell, tree, code, c) of one cell: (cell, cuts)."""

    def run(table: pa.Table) -> pa.Table:
        x = _decoded(table.column("code").combine_chunks())
        p = x @ directions(table.column("tree")[0].as_py(), stage, x.shape[1]).T
        cuts = fit_cuts(p, table.column("c")[0].as_py(), spill_of(threshold, x.shape[1]))
        return pa.table({"cell": table.column("cell").slice(0, 1), "cuts": pa.array([cuts.tobytes()], pa.binary())})

    return run


def _route(stage: int, threshold: float):
    """Rows (cell, tree, node, code, c, cuts) to rows (cell, tree, node, parent) of the children."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tree, width = b.column(1).to_numpy(), np.array([len(x) for x in b.column(3).to_pylist()])
            cell, c = b.column(0).to_numpy().view(np.uint64), b.column(4).to_numpy()
            for t, w in sorted(set(zip(tree.tolist(), width.tolist(), strict=True))):
                at = np.flatnonzero((tree == t) & (width == w))
                own = b.take(pa.array(at))
                x = _decoded(own.column(3))
                cuts = np.frombuffer(b"".join(own.column(5).to_pylist()), np.float32).reshape(len(at), PATHS)
                row, path = route(x @ directions(t, stage, x.shape[1]).T, cuts, spill_of(threshold, x.shape[1]))
                if not len(row):
                    continue
                child = mix(mix(cell[at][row]) + path.astype(np.uint64))
                parent = np.where(path == 1, -1, c[at][row])  # still whole: no cut was found
                cols = [pa.array(child.view(np.int64)), pa.array(np.full(len(row), t, np.int32)), own.column(2).take(pa.array(row)), pa.array(parent)]
                yield pa.RecordBatch.from_arrays(cols, names=["cell", "tree", "node", "parent"])

    return run


def _per_cell(rows: DataFrame, table: DataFrame, cells: int, how: str) -> DataFrame:
    """rows joined with a table of a row per cell."""
    if cells <= FEW_CELLS:
        return rows.join(F.broadcast(table), "cell", how)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(SALTS)).cast("int")).join(salted, ["cell", "salt"], how).drop("salt")


def _forest(ok: np.ndarray) -> list[tuple[int, int]]:
    """(row, root) of the connected rows of a symmetric mask, but the roots."""
    todo, out = np.ones(len(ok), bool), []
    for root in np.flatnonzero(ok.any(1)).tolist():
        if todo[root]:
            todo[root] = False
            front = np.array([root])
            while len(front):
                front = np.flatnonzero(ok[front].any(0) & todo)
                todo[front] = False
                out += [(i, root) for i in front.tolist()]
    return out


def counted_before(lower: list[list[int]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of rows share a number. Only numbers that two of the rows hold can be shared."""
    flat = np.concatenate([np.asarray(x, np.int64) for x in lower]) if lower else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(lower)), [len(x) for x in lower])
    some = np.isin(row, np.union1d(i, j))
    flat, row = flat[some], row[some]
    values, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    many = count > 1
    row, at = row[many[at]], (np.cumsum(many) - 1)[at[many[at]]]
    out = np.zeros(len(i), bool)
    for lo in range(0, int(many.sum()), 512):  # columns of the table row x number, a slice at a time
        there = np.zeros((len(lower), 512), bool)
        use = (at >= lo) & (at < lo + 512)
        there[row[use], at[use] - lo] = True
        for k in range(0, len(i), 1 << 15):
            out[k : k + (1 << 15)] |= (there[i[k : k + (1 << 15)]] & there[j[k : k + (1 << 15)]]).any(1)
    return out


def _compare(threshold: float, wide: bool):
    """Of one block pair of a leaf, rows (leaf, bi, bj, side, node, w, raw, lower): rows (node, links, root)."""

    def run(table: pa.Table) -> pa.Table:
        side, node, w = (table.column(n).to_numpy() for n in ("side", "node", "w"))
        x = unit(np.frombuffer(b"".join(table.column("raw").to_pylist()), np.float64 if wide else np.float32).reshape(len(side), -1))
        first, second = (np.flatnonzero(side == 0),) * 2 if side[0] == 0 else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
        ok = x[first] @ x[second].T >= threshold
        if side[0] == 0:
            ok = np.triu(ok | ok.T, 1)
        i, j = np.nonzero(ok)
        i, j = first[i], second[j]
        square = np.zeros((len(node), len(node)), bool)
        square[i, j] = square[j, i] = True
        # leaves before this one in which members stand too: pairs that share one were counted there
        new = ~counted_before(table.column("lower").to_pylist(), i, j)
        i, j = i[new], j[new]
        links = np.bincount(i, w[j], len(node)).astype(np.int64) + np.bincount(j, w[i], len(node)).astype(np.int64)
        rows = [(int(node[k]), int(links[k]), None) for k in np.flatnonzero(links)] + [(int(node[k]), 0, int(node[r])) for k, r in _forest(square)]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("node", "links", "root"), cols, strict=True)})

    return run


def leaves_of(nodes: DataFrame, trees: int, threshold: float, n: int) -> DataFrame:
    """nodes (node, label, code) to distinct (leaf, node)."""
    tree = F.explode(F.sequence(F.lit(1), F.lit(trees)))
    cells = nodes.select("node", "code", "label", tree.alias("tree")).select(
        F.xxhash64("tree", "label", F.length("code")).alias("cell"), "tree", "node", "code", F.lit(0).cast("long").alias("parent")
    )
    leaves, stage = None, 0
    while True:
        sizes = cells.groupBy("cell").agg(F.count("*").alias("c"), F.max("parent").alias("parent"))
        # parent: size of the cell it came from; -1 where no cut was found. Cells that did not shrink are leaves
        big = cut(sizes.where(f"c > {LEAF} and (parent = 0 or (parent > 0 and c <= 0.9 * parent))").select("cell", "c"), 1)
        n_big = big.count()
        marked = _per_cell(cells.drop("parent"), big, n_big, "left")
        done = marked.where("c is null").select(F.col("cell").alias("leaf"), "node")
        leaves = done if leaves is None else leaves.union(done)
        if not n_big:
            return cut(leaves.distinct(), 4 * trees * n, 400_000)
        large = marked.where("c is not null")
        large = large if stage == 0 else large.join(nodes.select("node", "code").dropDuplicates(["node"]), "node")
        sample = large.where(F.pmod(F.xxhash64("node", "cell"), F.col("c")) < SAMPLE).select("cell", "tree", "code", "c")
        cuts = cut(sample.groupBy("cell").applyInArrow(_fit(stage, threshold), "cell long, cuts binary"), 1)
        routed = _per_cell(large, cuts, n_big, "inner").select("cell", "tree", "node", "code", "c", "cuts")
        cells = cut(routed.mapInArrow(_route(stage, threshold), "cell long, tree int, node long, parent long"), 4 * trees * n, 400_000)
        stage += 1


def near_vectors(
    embeddings: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", trees: int = TREES
) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per input row."""
    spark, kind = embeddings.sparkSession, embeddings.schema[vec_col].dataType
    wide = not (isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType))
    vector = f"`{vec_col}`" if not wide else f"cast(`{vec_col}` as array<double>)"
    rows = embeddings.selectExpr(f"cast(`{id_col}` as bigint) vec_id", f"cast(`{label_col}` as string) label", f"{vector} embedding")
    n = rows.count()
    rows = rows.mapInArrow(_nodes_of(wide), "vec_id long, node long, k2 long, label string, raw binary, code binary")
    nodes = cut(
        rows.where("node is not null")
        .groupBy("node", "k2")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("label").alias("label"), F.first("raw").alias("raw"), F.first("code").alias("code")),
        n, 10_000,
    )
    leaves = leaves_of(nodes.select("node", "label", "code"), trees, threshold, n)
    own = leaves.groupBy("node").agg(F.collect_list("leaf").alias("leaves"))  # a vector's leaves: some dozens
    member = leaves.join(leaves.groupBy("leaf").agg(F.count("*").alias("c")).where("c > 1"), "leaf")
    member = member.join(own, "node").withColumn("lower", F.filter("leaves", lambda v: v < F.col("leaf"))).join(nodes.select("node", "raw", "w"), "node")
    member = member.withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "leaf", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"),
        F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"),
        "node", "w", "raw", "lower",
    )
    found = cut(member.groupBy("leaf", "bi", "bj").applyInArrow(_both_sides(_compare(threshold, wide)), "node long, links long, root long"), 4 * n)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = shared_components(spark, found.where("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b")))
    facts = nodes.select("node", "k2", "rep", "w").join(least_of_components(nodes, comp), "node", "left").join(links, "node", "left")
    n_links = F.col("w") - 1 + F.coalesce("links", F.lit(0))
    facts = cut(facts.select("node", "k2", "w", F.coalesce("least", "rep").alias("component_id"), n_links.alias("n_links")), n)
    out = lookup(rows.select("vec_id", "node", "k2"), facts, ["node", "k2"], ["component_id", "n_links"], "w", n, "vec_id")
    out = out.withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _both_sides(run):
    """A block pair of which one side is empty has no pairs."""

    def guarded(table: pa.Table) -> pa.Table:
        side = set(table.column("side").to_pylist())
        if side in ({1}, {2}):
            return pa.table({n: pa.array([], pa.int64()) for n in ("node", "links", "root")})
        return run(table)

    return guarded
