"""Rows that slices send follow the input, not its square: with parts that grow with it, small slices, at 1, 2 and 4 times."""

import random

import public_tokenizers
import pytest

pytest.importorskip("peptura.llm")

from peptura.llm import arrow  # noqa: E402
from peptura.llm import sentencepieces as P  # noqa: E402
from peptura.llm import substrings as S  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from test_substrings import brute, corpus  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def words(rng, n, m=400):
    return [" ".join("".join(rng.choices("abcdefghij", k=4)) for _ in range(m)) for _ in range(n)]


def test_lists_of_chunks(spark):
    rng, rows = random.Random(1), {}
    for times in (1, 2, 4):
        texts = words(rng, 60 * times)
        size = sum(map(len, texts))
        parts = P.parts_of(size, 1000, 32)
        assert parts == 32  # of the 120 and more that one for each 1,000 bytes would be
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
        slices = df.mapInArrow(P._slices(10_000, parts), "slice long, doc_ids array<long>, payload array<binary>")
        rows[times] = slices.mapInArrow(P._asked, "part int, slice long, chunks binary").count() / size
    assert max(rows.values()) < 1.1 * min(rows.values()), rows


@pytest.mark.parametrize("known", [3, 10**6])
def test_few_parts_give_the_same_ids(spark, known, monkeypatch):
    monkeypatch.setattr(P._segmented, "__defaults__", (known,))
    texts = [*words(random.Random(2), 30, 50), None, "", "  a  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r["doc_id"]: r["ids"] for r in P.encode_documents(df, MODEL, slice_bytes=2000, part_bytes=100, most_parts=20).collect()}
    assert got == {i: ",".join(map(str, sp.encode(t or ""))) for i, t in enumerate(texts)}


def entries(spark, texts, parts, fan):
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "uid long, doc_id long, text string").repartition(len(texts) // 10)
    return df.mapInArrow(arrow.over_slices(S._anchor_entries(parts, S.WINDOW, fan), 2), S.ENTRY)


def test_entries_in_two_steps(spark):
    """At 1, 2 and 4 times the input, with a part for each 2,000 bytes, dealt over 8 ranges; a partition is a slice."""
    rng, first, second, plain = random.Random(3), {}, {}, {}
    for times in (1, 2, 4):
        texts = words(rng, 100 * times)
        size = sum(map(len, texts))
        parts = size // 2000
        sent = entries(spark, texts, parts, 8)
        first[times] = sent.count() / size
        second[times] = S.dealt(sent, parts, 5, 8, share=100).count() / size
        plain[times] = entries(spark, texts, parts, 10**9).count() / size
    assert max(first.values()) < 1.2 * min(first.values()), first
    assert max(second.values()) < 1.3 * min(second.values()), second
    assert plain[4] > 1.5 * plain[1], plain  # what it would be in one step


@pytest.mark.parametrize("fan", [2, 5, 10**6])
def test_two_steps_give_the_same_rows(spark, fan):
    texts = corpus(random.Random(20 + fan % 7))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in S.remove_repeats(df, part_bytes=500, fan=fan).collect()}
    assert got == dict(enumerate(brute(texts)))
    assert df.agg(F.count("*")).first()[0] == len(texts)
