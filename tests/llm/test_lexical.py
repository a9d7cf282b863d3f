"""Ranked search against a plain loop over items and documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("peptura.llm")

from peptura.llm import lexical as L  # noqa: E402

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate({i: i + 32 for i in range(65, 91)}) for t in TERMS.findall(text or "")]


def brute(docs, items, k=10):
    """Sorted rows (item_id, rank, doc_id, score)."""
    found = [(i, terms(t)) for i, t in docs]
    found = [(i, Counter(w), len(w)) for i, w in found if w]
    n_docs, n_terms = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        got = []
        for doc, c, n in found:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                got.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(got, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def corpus(rng, n):
    words = [f"w{i}" for i in range(60)] + ["É", "ß", "Ab", "日本"]
    text = lambda m: rng.choice(" .\n").join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randrange(m)))
    docs = [(None, "w1 w2"), (None, "w1 w2"), (-7, None), (-8, ""), (-9, ".. !"), (3, "w1 W1 w1"), (3, "w1 W1 w1"), (-4, "w5 " * 4000)]
    docs += [(i, text(30)) for i in range(n)] + [(n + i, "w3 w4 w9 w30") for i in range(25)]  # copies: ties beyond the k
    items = [(-1, "w1 w1 w1 w2"), (0, None), (1, "nothing here"), (2, "w59 É AB 日本"), (2, "w3 w4 w9 w30"), (None, "w30")] + [(i, text(20)) for i in range(5, 30)]
    return docs, items


@pytest.mark.parametrize(("k", "blocks", "batch", "vocabulary"), [(10, 1 << 15, 256, 1 << 20), (3, 7, 4, 1 << 20), (10, 70, 9, 0)])
def test_against_a_plain_loop(spark, k, blocks, batch, vocabulary):
    docs, items = corpus(random.Random(k + blocks), 300)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    got = L.search(d, q, k, batch=batch, vocabulary_bytes=vocabulary, block_docs=blocks)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, k)


def test_empty_tables_and_clashing_columns(spark):
    docs, items = [(1, "a b", 5, "x")], [(9, "b", 1, 2)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item long, term string")
    q = spark.createDataFrame(items, "item_id long, text string, batch int, block int")
    assert [tuple(r) for r in L.search(d, q).collect()] == brute([x[:2] for x in docs], [x[:2] for x in items])
    assert L.search(d.limit(0), q).collect() == [] and L.search(d, q.limit(0)).collect() == []


def test_sums_and_products_of_slices():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 40, 192), rng.integers(0, 1 << 20, 192)
    bits = lambda v, n: np.array([np.packbits((v >> s) & 1, bitorder="little").view(np.uint64) for s in range(n)])
    total, every = bits(a, 44), np.arange(192)
    for shift in (0, 3, 11):
        L.add(total, bits(b, 20), shift)
        a = a + (b << shift)
        assert (L.scores_at(total, every) == a).all()
    weights = np.array([0, 1, 26_000])
    assert (L.scores_at(L.times(bits(b, 20), weights), every) == b * np.repeat(weights, 64)).all()


def test_best_of_slices():
    rng = np.random.default_rng(6)
    for k in (1, 5, 40, 500):
        v = rng.integers(0, 12, (3, 128)) * rng.integers(0, 3, (3, 128))
        total = np.array([[np.packbits((row >> s) & 1, bitorder="little").view(np.uint64) for s in range(5)] for row in v])
        sure, tied = L.best(total, k)
        for row, s, t in zip(v, sure, tied, strict=True):
            s, t = row[L.members(s)], row[L.members(t)]
            want = np.sort(row[row > 0])[::-1][:k]
            got = np.sort(np.concatenate([s, t[: max(0, k - len(s))]]))[::-1]
            assert len(s) <= k and len(set(t.tolist())) <= 1 and (got == want).all()
