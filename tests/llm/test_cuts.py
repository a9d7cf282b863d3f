"""Shards of folded groups against the minimax cut of the groups themselves."""

import random

import pytest

pytest.importorskip("peptura.llm")

from peptura.llm.sharding import minimax_cuts, open_atoms, shard_documents  # noqa: E402


def shards(rows, n_shards):
    """doc_id -> shard, ids being unique."""
    groups = {}
    for i, t in rows:
        g = groups.setdefault(("null", i) if t is None else t, [i, 0])
        g[0], g[1] = min(g[0], i), g[1] + len((t or "").encode()) + 1
    order = sorted(groups.values())
    cuts = minimax_cuts([b for _, b in order], n_shards)
    at = {first: sum(c <= k for c in cuts) for k, (first, _) in enumerate(order)}
    return {i: at[groups[("null", i) if t is None else t][0]] for i, t in rows}


@pytest.mark.parametrize("spread", [lambda i: i, lambda i: (i - 150) * 20_000_000_000_000_007, lambda i: (1 << i % 60) + i * i])
def test_folded_is_exact(spark, spread):
    rng = random.Random(11)
    texts = [None if i % 97 == 5 else str(i) + "x" * rng.choice([1, 5, 40, 900]) for i in range(300)]
    rows = [(i, t) for i, t in {spread(i): t for i, t in enumerate(texts)}.items()]
    rows += [(max(i for i, _ in rows) + 1 + k, texts[k % 3]) for k in range(90)]  # copies of few texts
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    for atoms, n in ((5, 8), (40, 8)):
        got = shard_documents(df, n_shards=n, max_atoms=atoms)
        assert {r["doc_id"]: r["shard"] for r in got.collect()} == shards(rows, n)


def test_few_atoms_are_opened():
    rng = random.Random(5)
    sizes = [rng.randint(1, 2_000) for _ in range(20_000)]
    assert len(open_atoms(sizes, [False] * len(sizes), 8, 50)) < 400
    assert open_atoms(sizes, [True] * len(sizes), 8, max(sizes)) == []


def test_splitting_reaches_the_cuts_of_the_groups():
    rng = random.Random(7)
    for _ in range(300):
        sizes = [rng.choice([1, 2, 3, 50, 400]) for _ in range(rng.randint(1, 60))]
        n, step = rng.randint(1, 9), rng.randint(2, 20)
        atoms = [list(range(i, min(i + step, len(sizes)))) for i in range(0, len(sizes), step)]
        while todo := open_atoms([sum(sizes[i] for i in a) for a in atoms], [len(a) == 1 for a in atoms], n, max(sizes)):
            atoms = [h for k, a in enumerate(atoms) for h in ((a[: len(a) // 2], a[len(a) // 2 :]) if k in todo else (a,))]
        cuts = minimax_cuts([sum(sizes[i] for i in a) for a in atoms], n)
        assert [atoms[c][0] for c in cuts] == minimax_cuts(sizes, n)
