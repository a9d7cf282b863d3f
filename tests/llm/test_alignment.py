"""Alignment against a plain loop over bytes."""

import random
from collections import Counter

import pytest

pytest.importorskip("peptura.llm")
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from peptura.llm import alignment as A  # noqa: E402

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens(texts):
    """Of each text the lists (id, bytes) of both sides, empty where bytes differ."""
    a, b = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    for t in texts:
        if not t:
            yield [], []
            continue
        left = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids]
        right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(t) for p in [b.id_to_piece(i)]]
        same = b"".join(x for _, x in left) == b"".join(x for _, x in right) == (" " + t).encode()
        yield (left, right) if same else ([], [])


def spans(side):
    at, out = 0, []
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(texts):
    docs = []
    for left, right in tokens(texts):
        left, right = spans(left), spans(right)
        links = [(i, j) for i, s, e in left for j, u, v in right if max(s, u) < min(e, v)]
        ends = sorted({e for _, _, e in left} & {e for _, _, e in right})
        ids = lambda side, lo, hi: ",".join(str(i) for i, s, _ in side if lo <= s < hi)
        groups = ";".join(f"{ids(left, lo, hi)}|{ids(right, lo, hi)}" for lo, hi in zip([0, *ends], ends, strict=False))
        docs.append((len(left), len(right), len(ends), links, groups))
    count = Counter(p for *_, links, _ in docs for p in set(links))
    best = {}
    for (a, _), c in count.items():
        best[a] = max(best.get(a, 0), c)
    return [(na, nb, ng, len(links), groups, sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links)) for na, nb, ng, links, groups in docs]


ODD = [
    None, "", " ", "  a  b ", "x", "x", "x", "naïve 日本語 नमस्ते 😀", "a▁b", "<|endoftext|> </s><unk> <0x41>", "tabs\t\n\r\n\x0b end ", "x" * 3000, "1²½ it's", "é́", "\x00\x01", "antidisestablishment tokenizers " * 40,
]


def corpus(rng, n):
    words = ["the", "there", "Thermo", "token", "izer", "ßen", "日本", "  ", "\n", "unbelievable", "12345", "!?", "don't", "zxq"]
    return ODD + ["".join(rng.choice(words) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(25))) for _ in range(n)]


@pytest.mark.parametrize(("slice_chars", "split", "held"), [(A.SLICE, A.SPLIT, A.HELD), (60, 3, 5), (400, 10, 1)])
def test_against_a_plain_loop(spark, slice_chars, split, held, monkeypatch):
    monkeypatch.setattr(A, "STEP", min(A.STEP, slice_chars // 2))
    monkeypatch.setattr(A, "HELD", held)
    texts = corpus(random.Random(slice_chars), 120)
    df = spark.createDataFrame([(i - 5, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, A.align_documents(df, FIRST, SECOND, slice_chars=slice_chars, split=split).collect()))
    want = [(i - 5, *w[:5], *w[5:]) for i, w in enumerate(brute(texts))]
    assert got == sorted(want)


def test_stream_in_small_batches(spark, monkeypatch):
    """Counts and postings of an id may stand in different Arrow batches, sums are sent again and again."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        texts = corpus(random.Random(4), 40)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
        got = sorted(map(tuple, A.align_documents(df, FIRST, SECOND, slice_chars=300, split=2).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((i, *w) for i, w in enumerate(brute(texts)))


def test_columns_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b", 1, "g"), (None, "a b", 1, "g"), (-3, "a", 2, "h")], "doc_id int, text string, n_a int, slice string")
    want = brute(["a b", "a b", "a"])
    got = sorted(map(tuple, A.align_documents(df, FIRST, SECOND).collect()), key=str)
    assert got == sorted([(None, *want[0]), (None, *want[1]), (-3, *want[2])], key=str)
    assert A.align_documents(df.limit(0), FIRST, SECOND).collect() == []
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, A.align_documents(none, FIRST, SECOND).collect())) == [(i, 0, 0, 0, 0, "", 0, 0) for i in (1, 2)]
