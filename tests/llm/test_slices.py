"""Substring dedup when every text is a slice of its own, and when no text has a repeat."""

import random

import pytest

pytest.importorskip("peptura.llm")

from peptura.llm import arrow  # noqa: E402
from peptura.llm import substrings as S  # noqa: E402

from test_substrings import brute, corpus  # noqa: E402


def _same(spark, texts, n):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(n)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in S.remove_repeats(df).collect()}
    assert got == dict(enumerate(brute(texts)))


@pytest.mark.parametrize("texts", [["a b c", "d e"], [None, ""], [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"], ["x " * 34], []])
def test_nothing_repeats(spark, texts):
    _same(spark, texts, 2)


def test_a_text_a_slice():
    texts = corpus(random.Random(8))
    step = S._anchor_entries(12, S.WINDOW)()
    import pyarrow as pa

    for i, t in enumerate(texts):
        one = pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([i], pa.int64()), pa.array([t], pa.string())], names=["uid", "doc_id", "text"])
        assert [p.num_rows for p in arrow.slices(one, 2)] == [1]
        assert step(one).schema.names == ["part", "uids", "counts", "keys"]


def test_one_row_partitions(spark):
    _same(spark, corpus(random.Random(12)), 97)
