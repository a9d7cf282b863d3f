"""SentencePiece, decontamination and license scan against the library and plain Python."""

import random
import re

import pytest

pytest.importorskip("peptura.llm")

from pyspark.sql import functions as F  # noqa: E402

from peptura.llm.decontaminate import find_contamination  # noqa: E402
from peptura.llm.licenses import build_rules, scan_licenses  # noqa: E402
from peptura.llm.sentencepieces import encode_documents  # noqa: E402

ODD = [
    None, "", " ", "  ", "a", " a", "a ", "  a  b   c ", "a▁b", "▁", "▁▁ x▁", "a\n b\n\n", "\t\x00", "é è ü ß 漢字 🙂 🙂x", "é ​",
    "<s> </s> <unk>", "x" * 3000, "word " * 5000, "line\r\nline", "　 \xa0 b",
]


def test_sentencepiece_is_the_library(spark):
    sentencepiece, tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    path = tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    alphabet = ["a", "the", " ", "  ", "▁", "é", "\n", "ing", "漢", "🙂", "\x01", "Q", "1", "."]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(800)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, "  ", "y")], "doc_id long, text string, ids string")
    got = encode_documents(df, path, as_array=True).collect()
    assert len(got) == len(texts) + 1
    key = lambda r: (r["doc_id"], r["n_tokens"], r["ids"], r["decoded"])
    assert sorted(map(key, encode_documents(df.repartition(3), path, as_array=True, slice_bytes=70).collect())) == sorted(map(key, got))
    none = encode_documents(df.select("doc_id", F.lit(None).cast("string").alias("text")), path, slice_bytes=1).collect()
    assert len(none) == len(got) and {(r["n_tokens"], r["ids"], r["decoded"]) for r in none} == {(0, "", "")}
    for r in got:
        ids = sp.encode(texts[r["doc_id"]] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == sp.decode(ids), texts[r["doc_id"]]
    assert encode_documents(df.limit(0), path).count() == 0


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(13, len(x))
        grams = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else []:
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize(("limit", "first_words"), [(16 << 20, 1 << 20), (500, 1 << 20), (500, 0)])
def test_decontamination(spark, limit, first_words):
    find = lambda d, b: find_contamination(d, b, index_bytes=limit, word_most=first_words)
    rng = random.Random(2)
    vocab = ["ab", "Cd", "é", "x1", "zz", "THE", "of", "q"]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, say(rng.choice([20, 35, 13, 14]))) for i in range(12)] + [(50, None), (51, "..."), (52, "q q q zz zz ab é"), (53, "the " * 30), (54, "solo")]
    nameless = " ".join(f"n{i}" for i in range(13))
    docs = [say(rng.randint(0, 80)) for _ in range(40)] + [None, "", "!!!", "the, THE-the " * 400, "a solo b", items[0][1]]
    docs += [say(30) + " " + it[1].upper().replace(" ", ", ") + " " + say(20) for it in items[:8]]
    docs += [say(9) + " " + " ".join(words(items[1][1])[:12]) + " nope " + say(9)]
    df = spark.createDataFrame([(i % 50, t, 1) for i, t in enumerate(docs)] + [(0, docs[0], 1)], "doc_id long, text string, n_hit int")
    docs_of_nameless = spark.createDataFrame([(1, "x " + nameless)], "doc_id long, text string")
    only = find(docs_of_nameless, spark.createDataFrame([(None, nameless), (None, "q " * 200)], "item_id long, text string")).collect()[0]
    assert (only["n_hit"], only["items"]) == (13, [])
    bench = spark.createDataFrame(items + [items[0]], "item_id long, text string")
    got = sorted(map(str, find(df, bench).select("doc_id", "text", "n_words", "n_hit", "items").collect()))
    from pyspark.sql import Row

    want = []
    for i, t in [*enumerate(docs), (0, docs[0])]:
        n, h, f = brute(t, items)
        want.append(str(Row(doc_id=i % 50, text=t, n_words=n, n_hit=h, items=f)))
    assert got == sorted(want)
    assert find(df.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in find(df, bench.limit(0)).collect()} == {0}


def test_license_base_and_rules(spark):
    assert len(build_rules()) > 300
    texts = [
        None, "", "no words about it", "MIT License", "This is under the GNU-General  Public\nLicense, version 3.", "Licensed under CC BY-NC 4.0.",
        "Licensed under the Apache License, Version 2.0. apache license", "mit mit license mit", "émit license", "x " * 30_000 + "mit license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy", "die schule mit kindern",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts * 2)], "doc_id long, text string, labels string")
    got = sorted(scan_licenses(df).collect(), key=lambda r: r["doc_id"])
    base = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for r, t in zip(got, texts * 2, strict=True):
        w = words(t)
        at = [(i, lab) for p, lab in base.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    labels = [r["labels"] for r in got]
    assert labels[4] == "gpl,gpl-3" and labels[5] == "cc-by,cc-by-nc-4.0" and "apache-2.0" in labels[6] and labels[10] == "mit"
    assert labels[2] == labels[11] == "" and got[2]["score"] == 0
    assert scan_licenses(df.limit(0)).count() == 0
