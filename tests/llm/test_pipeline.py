"""The pipeline's stages against plain decisions."""

import random

import pytest

pytest.importorskip("peptura.llm")
P = pytest.importorskip("corpus_pipeline")

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def say(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(11)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    item = " ".join(f"item{i}" for i in range(30))
    docs = [(i, say(i)) for i in range(60)]
    docs += [(100 + i, f"{say(200 + i)} awfulword") for i in range(40)]
    docs += [(300, say(3)), (301, say(4) + " more"), (302, item + " " + say(400)), (303, say(401) + " token=0641917ea4e9feb9cda83477b57ac2654884f485"), (304, None), (305, "")]
    rows = [(d, t, "en", "s", len(t or ""), "extra") for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, found string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, 1, int(100 <= d < 140)) for d, _ in docs if d < 140], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, all_ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    kept = [f(spark, docs, folder) for _, f in P.STAGES]
    assert all(k.columns == columns for k in kept[:-1]) and len(P.STAGES) == 5
    clean = ids(kept[0])
    assert not clean & set(range(100, 140)) and len(clean) >= len(all_ids) - 40 - 2  # so few labels: two mistakes at most
    assert ids(kept[1]) == all_ids - {300, 301}
    assert ids(kept[2]) == all_ids - {302}
    masked = {r["doc_id"]: r for r in kept[3].collect()}
    before = {r["doc_id"]: r for r in docs.collect()}
    assert masked[303]["text"] == say(401) + " [SECRET]" and masked[303]["n_chars"] == len(masked[303]["text"]) and masked[303]["found"] == "extra"
    assert {d for d in before if (before[d]["text"] or "") != (masked[d]["text"] or "")} == {303}
    encoded = {r["doc_id"]: r for r in kept[4].collect()}
    assert set(encoded) == all_ids and all(len(r["ids"]) == r["n_tokens"] for r in encoded.values()) and encoded[305]["n_tokens"] == 0


def test_run_is_the_stages_in_turn(spark, folder):
    got = {r["doc_id"]: r["n_tokens"] for r in P.run(spark, folder).collect()}
    assert not set(got) & {*range(100, 140), 300, 301, 302} and len(got) >= 66 - 3 - 2 and 304 in got
