"""Substring dedup against brute force, and the guarantee of shared anchors."""

import random

import numpy as np
import pytest

pytest.importorskip("peptura.llm")

from peptura.llm import substrings as S  # noqa: E402
from peptura.llm.common import WordHashes  # noqa: E402


def brute(texts, window=35):
    seen, words = {}, [(t or "").encode().split() for t in texts]
    for w in words:
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            seen[g] = seen.get(g, 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def corpus(rng):
    say = lambda n, k: " ".join(rng.choices([f"w{i}" for i in range(k)], k=n))
    shared = [say(n, 50) for n in (34, 35, 36, 60, 200)] + ["a " * 40, "x y " * 30, "x x y " * 20]
    texts = [None, "", " \n ", "one", say(34, 9), say(35, 9), "é ü " * 60, "w1 " * 35, "w1 " * 36, "w1 " * 20_000]
    for _ in range(60):
        texts.append(" ".join(say(rng.randint(0, 40), rng.choice([2, 5, 500])) + " " + rng.choice(shared) for _ in range(rng.randint(1, 4))))
    return texts + [say(80, 2) for _ in range(10)] + texts[-3:]


def test_against_brute_force(spark):
    texts = corpus(random.Random(6))
    df = spark.createDataFrame([(i % 70 if i % 9 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, uid string, part int")
    got = S.remove_repeats(df).collect()
    want = sorted((str(i % 70 if i % 9 else None), *b) for i, b in enumerate(brute(texts)))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got) == want
    assert all(sum(r["spans"][1::2]) - sum(r["spans"][::2]) == r["n_removed"] for r in got)
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_equal_windows_share_an_anchor_at_the_same_place():
    rng, hashes = random.Random(9), WordHashes()
    for _ in range(3000):
        k = rng.choice([1, 2, 2, 3, 4, 30])
        say = lambda n, k=k: [b"%d" % rng.randrange(k) for _ in range(n)]
        window, found = say(S.WINDOW), []
        for _ in range(2):
            before = say(rng.randint(0, 12))
            h = hashes.of(before + window + say(rng.randint(0, 12)))
            start, key = S.anchors(h, np.zeros(len(h), np.int64))
            found.append({(s - len(before), x) for s, x in zip(start.tolist(), key.tolist(), strict=True) if 0 <= s - len(before) <= S.LOST})
        assert found[0] & found[1]
