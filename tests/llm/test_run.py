"""The whole pipeline against brute-force stages, and its stages on odd rows."""

import random
import re

import pytest

pytest.importorskip("peptura.llm")
P = pytest.importorskip("corpus_pipeline")
sentencepiece, tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")

from test_minhash import brute as near_duplicates  # noqa: E402
from test_native import base_spans  # noqa: E402
from test_text import brute as contamination  # noqa: E402

from peptura.llm.secrets import char_class, default_samples, train  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, found string"


def say(rng, n=60):
    return " ".join("".join(rng.choices("aeioukmnrst", k=rng.randint(2, 7))) for _ in range(n))


def masked(text, model):
    """Base spans, and random tokens that touch none of them, replaced from the left."""
    base = [(int(s), int(e)) for _, s, e in (x.split(":") for x in base_spans(text)[0])]
    extra = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        c = [char_class(x) for x in m.group()]
        if len(c) >= 16 and re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group()) and not any(s < m.end() and m.start() < e for s, e in base):
            if sum(model[a * 40 + b] for a, b in zip(c, c[1:], strict=False)) / (len(c) - 1) >= 1.0:
                extra.append(m.span())
    out, at = "", 0
    for s, e in sorted(base + extra):
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def corpus(rng):
    items = [(i, say(rng, 30)) for i in range(5)] + [(9, None), (10, "")]
    key = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    texts = [say(rng) for _ in range(60)] + [f"{say(rng, 30)} zugol {say(rng, 20)} zugmet" for _ in range(30)]
    texts += [t.rsplit(" ", 1)[0] + " changed" for t in texts[:10]] + texts[10:14]
    texts += [f"{say(rng, 20)} {items[i][1]} {say(rng, 9)}" for i in range(4)] + [f"{say(rng, 9)} token={key()} é {say(rng, 9)} q7Rk2PzX9vLmT4wB8nYc1D" for _ in range(4)]
    texts += [None, "", "  ", say(rng, 9_000) + f" token={key()}"]
    return items, [(i, t, "en", "s", len(t or ""), 0.5, 7, "x") for i, t in enumerate(texts)]


def test_run_is_brute_force(spark, tmp_path):
    rng = random.Random(21)
    items, rows = corpus(rng)
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(r[0], 1, int(60 <= r[0] < 90)) for r in rows if r[0] < 90]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    from peptura.llm.toxicity import score_toxicity

    scored = {r["doc_id"]: r["predicted"] for r in score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    left = [(r[0], r[1]) for r in rows if scored[r[0]] == 0]
    kept = {i for (_, i), _, c in near_duplicates(left) if i == c}
    left = [(i, t) for i, t in left if i in kept]
    judged = {i: contamination(t, items) for i, t in left}
    left = [(i, t) for i, t in left if not (judged[i][1] and 20 * judged[i][1] >= judged[i][0])]
    assert 60 < len(left) < 80
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    model = train(default_samples())
    want = {i: sp.encode(masked(t or "", model)) for i, t in left}
    got = P.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == want and len(got) == len(want)
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)


@pytest.mark.parametrize("stage", P.STAGES, ids=[n for n, _ in P.STAGES])
def test_stages_on_odd_rows(spark, tmp_path, stage):
    rng = random.Random(5)
    items, rows = corpus(rng)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(r[0], None, int(60 <= r[0] < 90)) for r in rows if r[0] < 90], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = [(None, None, None, None, None, None, None, None)] * 2 + [(None, "", None, "s", 0, 0.0, 1, None)] * 2
    odd += [rows[3], (3, "another text under an id met before", None, None, None, None, None, None)] + [(500, rows[5][1], None, None, None, None, 5, None)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    name, function = stage
    out = function(spark, docs, str(tmp_path))
    got = out.collect()
    if name != "encode":
        assert out.columns == docs.columns
    empties = [r for r in got if r["doc_id"] is None]
    assert len(empties) == 4  # null and empty texts are documents without words, and stay
    third = [r for r in got if r["doc_id"] == 3]
    assert len(third) == (2 if name == "near_duplicates" else 3)
    if name == "encode":
        assert all(r["n_tokens"] == 0 for r in empties)
    elif name == "near_duplicates":
        assert 500 not in {r["doc_id"] for r in got}
    else:
        assert {r["text"] for r in empties} == {None, ""} and [tuple(r) for r in empties].count((None,) * 8) == 2
    nothing = function(spark, docs.limit(0), str(tmp_path))
    assert nothing.count() == 0 and nothing.columns == out.columns
