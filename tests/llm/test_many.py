"""Texts of many hits: secrets, masks and license intervals against plain Python, and their growth."""

import random
import time

import pytest

pytest.importorskip("peptura.llm")

from pyspark.sql import functions as F  # noqa: E402

from peptura.llm import licenses, secrets  # noqa: E402


def test_running_values(spark):
    rng = random.Random(1)
    rows = [(n, [rng.randint(-9, 99) for _ in range(n)]) for n in (0, 1, 2, 3, 4, 5, 16, 17, 100, 1000)]
    df = spark.createDataFrame(rows, "i int, xs array<int>")
    got = df.select("xs", F.expr(secrets.running("xs", 0, "{} + {}".format)), F.expr(secrets.running("xs", -50, "greatest({}, {})".format))).collect()
    for xs, sums, most in got:
        assert sums == [sum(xs[: i + 1]) for i in range(len(xs))] and most == [max(xs[: i + 1]) for i in range(len(xs))]


def masked(text, spans):
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def test_masks_of_any_spans(spark):
    rng, rows = random.Random(2), []
    for n in (0, 1, 5, 4095, 4096, 4097, 9000):
        for k in (0, 1, 7, 60):
            text = "".join(rng.choices("abé漢🙂", k=n))
            spans = sorted({(s := rng.randint(0, n - 1), min(n, s + rng.randint(1, 300)), rng.randint(0, 2)) for _ in range(k)}) if n else []
            rows.append((text, spans))
    df = spark.createDataFrame(rows, "text string, found array<struct<s:int,e:int,k:int>>")
    for t, spans, got in df.select("text", "found", secrets.mask_secrets("found", "text")).collect():
        assert got == masked(t, [tuple(s) for s in spans])


def test_long_text_of_many_secrets(spark):
    rng = random.Random(3)
    key = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    word = lambda: "".join(rng.choices("ABCDEFGHIJKabcdefgh0123456789QRSTUV", k=24))
    seconds = {}
    for n in (8, 2_000, 16_000):  # the first compiles
        text = " ".join(x for _ in range(n // 4) for x in (f"token={key()}", key(), "é plain", word(), word()))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        r = secrets.scan_secrets(df).select("text", "found", "base", secrets.mask_secrets().alias("m")).collect()[0]
        seconds[n] = time.time() - began
        base = [(int(s), int(e)) for _, s, e in (x.split(":") for x in r["base"].split(","))]
        assert len(base) == n // 4 * 3  # a token is an assignment and a hex string
        assert r["m"] == masked(text, [(x["s"], x["e"], x["k"]) for x in r["found"]])
    assert seconds[16_000] < 16 * max(seconds[2_000], 0.5), seconds  # eight times the text


def test_cost_of_one_short_row(spark):
    """What a plan costs besides its rows, from the second time on."""
    df = spark.createDataFrame([(-1, "password=hunter2hunter2")], "doc_id long, text string")
    seconds = []
    for _ in range(3):
        began = time.time()
        assert secrets.scan_secrets(df).select("n_assign", secrets.mask_secrets()).collect()[0][0] == 1
        seconds.append(time.time() - began)
    assert min(seconds) < 4, seconds


def test_license_intervals():
    rng = random.Random(4)
    for _ in range(300):
        hits = [(-rng.choice([40, 60, 90]), 0, n, s := rng.randint(0, 30), s + rng.randint(1, 12), "x") for n in range(rng.randint(0, 14))]
        hits = [(p, s - e, n, s, e, x) for p, _, n, s, e, x in hits]
        kept = []
        for h in sorted(hits):
            if not any(k[3] <= h[3] and h[4] <= k[4] for k in kept):
                kept.append(h)
        assert licenses.outermost(hits) == (kept if len(hits) > 1 else hits)


def test_license_scan_of_many_hits():
    rules = licenses.build_rules()
    text = "the mit license, cc by 4.0 and licensed under the apache license, version 2.0; " * 4_000
    began = time.time()
    n, kept, starts, base = licenses.scan_text(text, rules)
    assert time.time() - began < 20 and len(starts) == len(base) == 12_000 and len(kept) >= 12_000
    assert (n, min(starts), kept[0][:2]) == (16 * 4_000, 1, (8, 15))


def test_license_labels_are_those_of_all_rules():
    """Labels and score without gates and with every pair of intervals compared."""
    rng = random.Random(6)
    rules = licenses.build_rules()
    names = [n for _, ns, _, _ in licenses.FAMILIES for n in ns] + [w for _, w, _ in licenses.SIGNATURES if "(" not in w and "." not in w]
    for _ in range(150):
        bits = [rng.choice([rng.choice(names), rng.choice(["licensed under the", "version 2", "v3", "2 0", "or any later version", "4 0", "spdx license identifier", "word", "x"])]) for _ in range(rng.randint(0, 14))]
        norm = (" " + " ".join(bits) + " ").encode()
        hits = sorted((-p, m.start() - m.end(), n, m.start(), m.end(), label) for n, (label, rx, _, p) in enumerate(rules) for m in rx.finditer(norm))
        kept = []
        for h in hits:
            if not any(k[3] <= h[3] and h[4] <= k[4] for k in kept):
                kept.append(h)
        n, got, starts, base = licenses.scan_text(" ".join(bits), rules)
        assert [(norm[: h[3]].count(b" ") - 1, norm[: h[4]].count(b" ") - 1, h[5], -h[0]) for h in kept] == got
