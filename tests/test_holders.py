"""K-mers and who holds them, made from arrays of letters."""

import random

import numpy as np
import pytest

from peptura.functions.sequences import DISALLOWED
from peptura.operators import catalog, kmers


def _held(texts, owners, k):
    out = {}
    for t, o in zip(texts, owners, strict=True):
        for i in range(len(t) - k + 1):
            if not set(t[i : i + k]) & set(DISALLOWED + kmers.GAP):
                out.setdefault(t[i : i + k], set()).add(o)
    return {w: sorted(x) for w, x in out.items()}


@pytest.mark.parametrize("letters, longest", [("ACX", 60), ("ACDEFGHIKLMNPQRSTVWYBJ", 30), ("a\0\x01é\U0001f600Z", 25)])
def test_holders(letters, longest):
    rng = random.Random(longest)
    texts = ["".join(rng.choices(letters, k=rng.randrange(0, 90))) for _ in range(40)]
    texts += [t[3:50] for t in texts]  # long ones are held by several
    owners = np.sort(np.array([rng.randrange(30) for _ in texts]))
    got = {}
    for words, offsets, held in kmers.holders(texts, owners, longest, 2):
        assert len(set(words)) == len(words) == len(offsets) - 1
        got |= {w: held[a:b].tolist() for w, a, b in zip(words, offsets[:-1], offsets[1:], strict=True)}
    assert got == {w: x for k in range(2, longest + 1) for w, x in _held(texts, owners.tolist(), k).items()}
    assert list(kmers.holders(["", "X"], np.array([0, 1]), 2)) == []


@pytest.mark.parametrize("most", [1, 500, 4 << 20])
def test_lists_are_shuffled_and_not_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(kmers, "LETTERS", most)
    rng = random.Random(1)
    rows = [(i, f"n{i % 50}" if i % 9 else None, "".join(rng.choices("ACDX", k=rng.randrange(60))) if i % 11 else None) for i in range(200)]
    rows += [(1000, None, "WWW")]
    df = spark.createDataFrame(rows, "prot_id int, name string, seq string").repartition(3)
    for attribute, at in (("name", 1), ("prot_id", 0)):
        want = {}
        for k in (2, 3):
            want |= _held([r[2] or "" for r in rows], [r[at] for r in rows], k) if at == 0 else {w: sorted({rows[i][1] for i in x} - {None}) for w, x in _held([r[2] or "" for r in rows], range(len(rows)), k).items()}
        got = kmers.kmer_to_proteins(df, 3, 2, attribute)
        assert {r["kmer"]: r["proteins"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "explode" not in plan.lower()  # one row a place before
    for names in (3, 256):
        found = catalog.kmer_postings(df, 3, 2, names)
        places = [(r["kmer"], r["block"], r["piece"]) for r in found.collect()]
        assert len(set(places)) == len(places) and max(r["n"] for r in found.collect()) <= names
        ids = catalog.posting_ids(found, keep=("n",)).collect()
        assert len({(r["kmer"], r["prot_id"]) for r in ids}) == len(ids)
        back = {}
        for r in ids:
            back.setdefault(r["kmer"], []).append(r["prot_id"])
        assert {w: sorted(x) for w, x in back.items()} == want
    assert "lambda" not in catalog.posting_ids(found)._jdf.queryExecution().executedPlan().toString()
