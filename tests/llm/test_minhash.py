"""MinHash near-dedup against brute force."""

import random

import numpy as np
import pytest

pytest.importorskip("peptura.llm")

from peptura.llm import minhash as M  # noqa: E402
from peptura.llm.common import shared_components  # noqa: E402


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d is None, d or 0), len(sets[i]), d if not sets[i] else least.get(find(i))) for i, (d, _) in enumerate(rows))


def test_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    rows = []
    for base in range(5):  # families with many degrees of editing, near misses among them
        text = [word() for _ in range(120)]
        for _ in range(40):
            t = list(text)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
                t[rng.randrange(len(t))] = word()
            rows.append((len(rows) * 3 % 601, " ".join(t)))
    rows += [(700 + i, "the one short TEXT") for i in range(20)] + [(800, "The\tone\nshort text"), (801, "the one short"), (802, "a b c d e"), (803, "a b c d e f")]
    rows += [(900, None), (901, ""), (902, " \t"), (None, "the one short text"), (903, "x " * 9000), (904, "X " * 8000), (5, "another text with an id met before"), (905, "é É")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, node int, n_shingles string")
    got = M.near_duplicates(df).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_shingles"], r["component_id"]) for r in got) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got)
    assert M.near_duplicates(df.limit(0)).count() == 0


def test_every_pair_in_reach_shares_a_key():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, M.SYMBOLS).astype(np.uint16)
        b = a.copy()
        at = rng.choice(M.SYMBOLS, M.DISTANCE, replace=False)
        b[at] = b[at] + 1
        ka, kb = M.signature_keys(np.stack([a, b]))
        assert set(ka) & set(kb)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(200, 200), (300, 301), (301, 300)]
    got = {r["node"]: r["comp"] for r in shared_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root}
    for x, c in want.items():
        assert got.get(x, x) == c
