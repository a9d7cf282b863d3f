"""Growth by running masses against a loop over letters."""

import random

import pytest

from peptura.functions import masses as M
from peptura.operators import extension as E
from peptura.operators.clusters import extend_clusters
from peptura.operators.legacy import legacy_extend

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def proteins(rng):
    seqs = ["", "A", "AXA", "XXXX", "G" * 64, "G" * 65, "G" * 400, "".join(rng.choices(LETTERS, k=63)), "".join(rng.choices(LETTERS + "XBU", k=300)), "".join(rng.choices(LETTERS, k=1000)), "AC" + "X" * 200 + "DE"]
    return [(i, f"p{i}", s) for i, s in enumerate(seqs)]


def places(rng, seqs, n=25):
    for i, name, s in seqs:
        for _ in range(n if len(s) > 1 else 0):
            a = rng.randrange(len(s))
            yield i, name, s, rng.choice("by"), a, min(len(s), a + rng.randrange(1, 12))


def fits(seq, mz, z, ppm=20.0):
    if any(c not in M.RESIDUES for c in seq):
        return False
    units = sum(round(M.RESIDUES[c] * 10**7) for c in seq)
    return (units / 1e7 + M.WATER_MASS + z * M.PROTON_MASS) / z < mz + ppm * mz / 1e6


def grown(s, kind, a, e, mz, z):
    if not fits(s[a:e], mz, z):
        return None
    while True:
        b, f = (a, e + 1) if kind == "b" else (a - 1, e)
        if b < 0 or f > len(s) or not fits(s[b:f], mz, z):
            return s[a:e]
        a, e = b, f


@pytest.mark.parametrize("seed", [1, 2])
def test_extend_clusters(spark, seed):
    rng = random.Random(seed)
    seqs = proteins(rng)
    spectra = [("s", i, rng.uniform(100, 2500) if i % 4 else None if i == 8 else 57.03 + i, rng.randrange(1, 4)) for i in range(30)]
    # precursors that a sequence reaches exactly are met by the rule, not by its closed form
    spectra += [("s", 100 + i, sum(M.RESIDUES[c] for c in "ACDEF"[: i + 1]) + M.WATER_MASS + M.PROTON_MASS, 1) for i in range(5)]
    rows = [("s", rng.choice(spectra)[1], kind, name, e - a, a, e, s) for _, name, s, kind, a, e in places(rng, seqs)]
    rows.append(("s", 104, "b", "p1", 1, 0, 1, "A"))
    df = spark.createDataFrame(rows, "sample string, scan int, ion_type string, protein string, length int, start int, end int, seq string")
    spec = spark.createDataFrame(spectra, "sample string, scan int, precursor_mz double, precursor_charge int")
    got = extend_clusters(df, spark.createDataFrame(seqs, "prot_id int, name string, seq string"), spec)
    by = {(x, y): (mz, z) for x, y, mz, z in spectra}
    # a spectrum without a precursor has no growth
    want = [(*r, grown(r[7], r[2], r[5], r[6], *by["s", r[1]]) if by["s", r[1]][0] else None) for r in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_legacy_extend(spark):
    rng = random.Random(3)
    seqs = [*proteins(rng), (50, "p50", "UUAX" * 50 + "K" + "a1-" * 30 + "DE")]
    mass = lambda c: 0 if c in "BXUZOJ" else round(M.LEGACY_RESIDUES.get(c, 0) * 10**6)
    rows, want = [], []
    for i, _, s, kind, a, e in places(rng, seqs, 20):
        row = ("x", rng.uniform(50, 1500), i, kind, float(sum(map(mass, s[a:e]))) / 1e6, a, e)
        m, out = round(row[4] * 1e6), ""
        for c in s[e:] if kind == "b" else s[:a][::-1]:
            if c in "BXUZOJ":
                continue
            if (m + mass(c)) / 1e6 > row[1]:
                break
            m, out = m + mass(c), out + c
        rows.append(row)
        want.append((*row, out if kind == "b" else out[::-1]))
    df = spark.createDataFrame(rows, "prec_id string, precursor_mz double, prot_id int, ion_type string, kmer_mass double, start int, end int")
    got = legacy_extend(df, spark.createDataFrame(seqs, "prot_id int, name string, seq string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_rows_are_bounded_by_the_reach(spark):
    df = spark.createDataFrame([(1, "ACDEFGHIKL" * 400)], "prot_id int, seq string")
    rows = E.running_masses(df, "prot_id", spark.range(1).selectExpr("30"), {c: round(m * 10**7) for c, m in M.RESIDUES.items()}).collect()
    assert len(rows) == 2 * -(-4000 // E.CHUNK) and max(len(r["letters"]) for r in rows) <= E.CHUNK + 31
    assert E.running_masses(df.limit(0), "prot_id", spark.range(1).selectExpr("30"), {}).collect() == []


def test_no_protein_on_a_row(spark):
    """The exchanges of an extension carry neither whole sequences nor running masses beyond one join."""
    df = spark.createDataFrame([("s", 1, "b", "p", 1, 0, 1)], "sample string, scan int, ion_type string, protein string, length int, start int, end int")
    spec = spark.createDataFrame([("s", 1, 500.0, 1)], "sample string, scan int, precursor_mz double, precursor_charge int")
    out = extend_clusters(df, spark.createDataFrame([("p", "ACD")], "name string, seq string"), spec)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "seq#" not in plan.split("Join")[1]  # above the joins
    assert out.collect()[0]["extended_seq"] == "ACD"


def test_binary_search(spark):
    rng = random.Random(4)
    rows = [(sorted(rng.randrange(50) for _ in range(n)), m) for n in (0, 1, 2, 31, 64, 100) for m in (-1, 0, 25, 49, 90)]
    df = spark.createDataFrame(rows, "a array<long>, m long").selectExpr("a", "m")
    got = [r["n"] for r in df.select(E.count_at_most(df["a"], df["m"]).alias("n")).collect()]
    assert got == [sum(x <= m for x in a) for a, m in rows]
