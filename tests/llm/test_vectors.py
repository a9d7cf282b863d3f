"""Embedding near-dedup against brute force."""

import math

import numpy as np
import pytest

pytest.importorskip("peptura.llm")

from peptura.llm import vectors as V  # noqa: E402


def brute(rows):
    ok = [label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if k else None for (_, v, _), k in zip(rows, ok, strict=True)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted((r[0], n[i], least[find(i)]) for i, r in enumerate(rows))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "LEAF", 60)
    monkeypatch.setattr(V, "BLOCK", 40)
    rng = np.random.default_rng(3)
    rows = []
    for c in rng.normal(size=(6, 32)):
        for _ in range(40):  # chains and near misses around each centre
            rows.append((len(rows), (c + rng.normal(size=32) * rng.choice([0.01, 0.08, 0.14, 0.2, 0.5])).tolist(), int(rng.integers(0, 2))))
    rows += [(1000 + i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(300, 32)))]
    dense = rng.normal(size=32)
    rows += [(2000 + i, (dense + rng.normal(size=32) * 0.05).tolist(), 1) for i in range(130)]  # no cut parts these
    rows += [(3000 + i, rows[5][1], rows[5][2]) for i in range(50)] + [(3100, [2 * x for x in rows[5][1]], rows[5][2])]
    rows += [(4000, None, 1), (4001, [], 1), (4002, [0.0] * 32, 1), (4003, [math.nan] * 32, 1), (4004, [None] * 32, 1), (4005, rows[5][1], None), (4006, rows[5][1][:9], rows[5][2]), (4007, rows[5][1][:9], rows[5][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    got = V.near_vectors(df).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert V.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_production_leaf_finds_planted_pairs(spark, kind):
    """A label far above LEAF, cut at several levels: every pair planted near the threshold is found, and nothing else."""
    rng, dim, n, pairs = np.random.default_rng(7), 64, 20_000, 1_500
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(pairs, dim))
    side -= (side * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.9801, 0.985, (pairs, 1))
    near = cos * x[:pairs] + np.sqrt(1 - cos**2) * side
    far = 0.979 * x[pairs : 2 * pairs] + np.sqrt(1 - 0.979**2) * side  # some of these side vectors are not orthogonal
    v = np.concatenate([x, near, far]).astype(np.float32)
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links, least = np.zeros(len(v), int), np.arange(len(v))
    for a in range(0, len(v), 2_000):
        i, j = np.nonzero(u[a : a + 2_000] @ u.T >= 0.98)
        i += a
        i, j = i[i != j], j[i != j]
        np.add.at(links, i, 1)
        np.minimum.at(least, i, j)
    df = spark.createDataFrame(list(enumerate(v.tolist())), f"vec_id long, embedding array<{kind}>").selectExpr("*", "3 label").repartition(4)
    got = {r["vec_id"]: r for r in V.near_vectors(df).collect()}
    assert len(got) == len(v) and links.sum() >= 2 * pairs
    assert [i for i in range(len(v)) if got[i]["n_links"] != links[i] or got[i]["component_id"] != least[i]] == []
    nodes = spark.createDataFrame([(i, "3", V._code(u[i])) for i in range(len(v))], "node long, label string, code binary")
    leaves = V.leaves_of(nodes, V.TREES, 0.98, len(v))
    copies, largest = leaves.count() / len(v), leaves.groupBy("leaf").count().agg({"count": "max"}).first()[0]
    assert copies < 12 and largest <= 2 * V.LEAF, (copies, largest)
