"""Token counts against the library, whatever the table and the cache hold."""

import random

import pytest

pytest.importorskip("peptura.llm")
import public_tokenizers  # noqa: E402

from peptura.llm import tokencounts as T  # noqa: E402
from peptura.llm.bytepairs import Pieces, load_json  # noqa: E402

JSON, WORDS, MODEL = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = [
    None, "", " ", "  \n\n a  b\t", "it's we'll 'S don''t", "x" * 5000, "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", "1²½①Ⅷ x²", "\x1c\x1d a\x85\xa0　b​", "é́ naïve 日本語 नमस्ते", "😀👩‍👩‍👧 \U000e0041",
    "▁a ▁ ▁▁b", "\x00\x01", "<s> </s> <unk> <0x41>",
]


def library(path):
    if path.endswith(".json"):
        tok = load_json(path)
        return lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda t: len(sp.encode(t or ""))


def texts(rng, n=150):
    kinds = ["abcde ", "aé日 \n", " \t\r\n\x0b", "0189 ½²", "'stvrelmd ", "!?-_ .", "".join(map(chr, range(0x80, 0x3000, 7)))]
    return ODD + ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("path", [JSON, WORDS, MODEL])
@pytest.mark.parametrize("table", [None, {}])
def test_against_the_library(spark, path, table):
    rows = [(i - 3 if i else None, t) for i, t in enumerate(texts(random.Random(1)))]  # a null id and negative ones
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in T.count_tokens(df, path, limit=20, table=table, kept=7).collect()), key=str)
    of = library(path)
    want = [(i, len((t or "").encode()), of(t), of(t) > 20) for i, t in rows]
    assert got == sorted(want, key=str)


def test_the_table_is_of_frequent_pieces(spark):
    df = spark.createDataFrame([(i, "common words and  rareword%d" % i) for i in range(40)], "id int, text string")
    table = T.frequent_lengths(df, JSON, entries=6)
    assert {"common", " words", " and", " ", " rareword"} < table.keys() and len(table) == 6
    assert T.unpack(T.pack(table)) == table and T.unpack(T.pack({})) == {}


def test_tiers():
    tok = T._tokenizer(JSON)
    lengths = T.Lengths({" a": 1}, tok.sizes, kept=2)
    long = "y" * 300
    assert lengths.totals([[" a", " bcdqz"], [" a", long]]) == [1 + tok.sizes([" bcdqz"])[0], 1 + tok.sizes([long])[0]]
    assert set(lengths) == {" a"} and set(lengths.met) == {" bcdqz"} and lengths.misses == 2
    assert lengths.totals([[" bcdqz"]]) and lengths.misses == 2
    lengths.totals([["q%d" % i for i in range(5)]])
    assert lengths.totals([[" bcdqz"]]) and lengths.misses == 8  # the cache was full and begun anew


def test_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(5, "x y", "n", 1)], "doc_id int, text string, n_tokens string, batch int")
    assert [tuple(r) for r in T.count_tokens(df, JSON).collect()] == [(5, 3, 2, False)]
    assert T.count_tokens(df.limit(0), JSON).collect() == []


def test_pieces_of_every_character():
    """Each character, alone and in company, is split as the library splits it."""
    tok = load_json(JSON)
    pieces = Pieces(tok)
    for start in range(0, 0x20000, 97):
        t = " ".join(f"a{c}1{c}{c} {c}" for c in map(chr, range(start, start + 97, 5)) if not 0xD800 <= ord(c) < 0xE000)
        assert pieces(t) == [t[s:e] for _, (s, e) in tok.pre_tokenizer.pre_tokenize_str(t)]
