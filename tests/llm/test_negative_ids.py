"""Negative ids, and texts that need more than one of everything, for each operator: one row for each, none lost."""

import public_tokenizers
import pytest

pytest.importorskip("peptura.llm")

WORDS = " ".join(f"word{i} token=abcdef{i}" for i in range(300))
DOCS = [(-5, WORDS), (-(2**62), WORDS + " end"), (-1, "short"), (0, None), (7, "")]
IDS = sorted(i for i, _ in DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").repartition(2)


def _ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_toxicity(spark, docs):
    from peptura.llm.toxicity import score_toxicity

    labels = spark.createDataFrame([(i, n % 2, (n + 1) % 2) for n, i in enumerate(IDS)], "doc_id long, quality int, toxic int")
    assert _ids(score_toxicity(docs, labels)) == IDS


def test_pipeline_stage_of_toxicity(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, 0, n % 2) for n, i in enumerate(IDS)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert set(_ids(corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)))) <= set(IDS)


def test_text_operators(spark, docs):
    from peptura.llm import decontaminate, licenses, lexical, minhash, secrets, sentencepieces, sharding, substrings, tokencounts

    model = public_tokenizers.path("piece_bpe_32k.model")
    items = spark.createDataFrame([(-3, "word1 token abcdef1 word2")], "item_id long, text string")
    for found in (
        decontaminate.find_contamination(docs, items), licenses.scan_licenses(docs), secrets.scan_secrets(docs), sentencepieces.encode_documents(docs, model), sharding.shard_documents(docs), substrings.remove_repeats(docs), tokencounts.count_tokens(docs, model)
    ):
        assert _ids(found) == IDS
    near = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert sorted(near) == IDS and near[-5] == (-(2**62), False) and near[-(2**62)][1]
    assert [r["doc_id"] for r in lexical.search(docs, items).orderBy("rank").collect()] in ([-5, -(2**62)], [-(2**62), -5])


def test_vectors(spark):
    from peptura.llm.vectors import near_vectors

    rows = [(-2, [1.0, 0.0], 1), (-9, [1.0, 0.001], 1), (3, [0.0, 1.0], 1), (-4, None, 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {-2: (1, -9), -9: (1, -9), 3: (0, 3), -4: (0, -4)}
