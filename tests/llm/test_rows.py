"""Stages on rows whose ids repeat, are missing, or have no document."""

import random

import pytest

pytest.importorskip("peptura.llm")
P = pytest.importorskip("corpus_pipeline")

from peptura.llm.toxicity import sample_windows  # noqa: E402


def say(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def test_near_duplicates_go_by_row(spark):
    rows = [
        (1, say(1), "a"), (2, say(1), "b"), (2, say(2), "c"),  # 2 stands on a copy and on a clean text
        (3, say(3), "d"), (3, say(3), "e"), (4, say(3) + " more", "f"),  # a repeated row, and a near copy
        (None, say(4), "g"), (None, say(4), "h"), (None, say(4) + " more", "i"),  # copies without an id
        (None, say(5), "j"), (9, say(5), "k"), (7, None, "l"), (7, None, "m"), (8, "", "n"), (8, "", "o"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string")
    out = P.drop_near_duplicates(spark, docs, "")
    got = {r["name"] for r in out.collect()}
    assert out.columns == docs.columns and out.count() == len(got)
    assert got >= {"a", "c", "k", "l", "m", "n", "o"} and not got & {"b", "f", "j"}
    assert len(got & {"d", "e"}) == 1 and len(got & {"g", "h", "i"}) == 1 and len(got) == 9


def test_labels_without_documents_take_no_place(spark):
    docs = spark.createDataFrame([(i, f"some words of {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4_000)], "doc_id long, toxic int")
    own = labels.where("doc_id < 40")
    want = sample_windows(docs, own, (10, 10), 8, "doc_id", "text")
    assert len(want) == 20 and sample_windows(docs, labels, (10, 10), 8, "doc_id", "text") == want
