"""Secret scan: base patterns plus character Markov models. DataFrame functions only on the rows.

Two first-order character models, of random strings and of ordinary identifiers, are trained from labelled samples.
A token is reported when the mean log-likelihood ratio per transition is at least ``threshold`` and it lies in no base
span. Transitions run over 40 character classes, so a model is one array of 1,600 numbers, a constant of the plan.

Spark's regex functions give matches without places; places follow from the parts between matches: part lengths and
match lengths alternate. Lengths are in code points. Patterns are first matched as they are and short ones dropped
afterwards, because a dropped match still consumes its characters.

Cases: a null text is empty, an empty text has no spans, a text without candidates is never split, very long texts are
scanned whole, repeated rows are scanned each, an empty table gives an empty result. Ties in start are ordered by kind
as listed in KINDS. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Callable, Iterable, Sequence
from functools import cache
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the contract: kind, pattern, group whose length counts, least length.
PATTERNS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
KINDS = ("assign", "access", "hex", "markov")
#: Tokens that the models judge: of at least this many characters, with a digit and a letter.
TOKEN, TOKEN_LEAST = r"[A-Za-z0-9+/_=-]+", 16
#: The same tokens as one pattern, so that only they are taken from a text: what fails at a token's start fails in all of it.
JUDGED = r"(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}"
#: Code points in the blocks that texts are cut into for masking.
BLOCK = 4096
#: 26 letters in lower case, 10 for capitals by alphabet position / 3, and one class each for digits, signs, `_-`, others.
CLASSES = 40

#: Ordinary identifier parts for the default negative sample.
PARTS = (
    "user name value index count total list map set get put add remove update create delete file path line text word "
    "token page url host port key map node tree graph edge table row column data base source target parse read write "
    "open close start stop begin end first last next previous config option default error message result status code "
    "time date year month day hour minute second event handler listener manager factory builder service client server "
    "request response header body cookie session account order item price product customer report summary detail view "
    "version number string integer double float boolean array object class method function variable constant public "
    "private static final return import export module package license document section chapter image video audio"
).split()


def char_class(ch: str) -> int:
    o = ord(ch)
    if 97 <= o <= 122:
        return o - 97
    if 65 <= o <= 90:
        return 26 + (o - 65) // 3
    return 35 if 48 <= o <= 57 else 36 if ch in "+/=" else 37 if ch in "_-" else 38


def default_samples(n: int = 400) -> list[tuple[str, int]]:
    """(string, 1 if random) by rule: digests written in base64, hex and capitals, and joined identifier parts."""
    out: list[tuple[str, int]] = []
    for i in range(n):
        d = hashlib.sha256(f"sample {i}".encode()).digest()
        b64 = base64.b64encode(d).decode().rstrip("=")
        out += [(b64[: 20 + i % 20], 1), (d.hex()[: 24 + i % 20], 1), (base64.b32encode(d).decode()[: 20 + i % 16], 1)]
        w = [PARTS[(d[k] * 256 + d[k + 1]) % len(PARTS)] for k in range(0, 8, 2)]
        year = str(1990 + d[9] % 40)
        out += [("_".join(w), 0), ("-".join([*w[:3], year]), 0), (w[0] + "".join(x.title() for x in w[1:]), 0)]
        out += [("".join(w), 0), ("/".join(w[:3]) + "/" + year, 0), ("_".join(w).upper(), 0), (w[0] + str(d[10]), 0)]
    return out


def train(samples: Iterable[tuple[str, int]]) -> list[float]:
    """Log-likelihood ratios of class transitions (row-major), add-one smoothed; from a bounded labelled sample."""
    seen = [[[0.25] * CLASSES for _ in range(CLASSES)] for _ in range(2)]
    for s, label in samples:
        for a, b in zip(s, s[1:], strict=False):
            seen[int(label)][char_class(a)][char_class(b)] += 1
    llr = []
    for a in range(CLASSES):
        tot = [sum(seen[y][a]) for y in (0, 1)]
        llr += [round(math.log(seen[1][a][b] / tot[1]) - math.log(seen[0][a][b] / tot[0]), 6) for b in range(CLASSES)]
    return llr


@cache
def default_model() -> tuple[float, ...]:
    return tuple(train(default_samples()))


# Expressions over arrays are written as SQL text: one call to the JVM for each column, not one for each node of its tree.

_names = count()


def _fresh(n: int = 1) -> list[str]:
    """Names of lambda variables that nothing else has."""
    return [f"v{next(_names)}" for _ in range(n)]


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def numbers(values: Iterable[float], kind: str) -> str:
    """An array of literals."""
    return f"cast(array({','.join(f'{x!r}{"D" if kind == "double" else ""}' for x in values)}) as array<{kind}>)"


def llr_of(token: str, model: Sequence[float]) -> str:
    """Mean ratio per transition of an ASCII token; 0 for fewer than two characters."""
    code, table = numbers((char_class(chr(i)) for i in range(128)), "int"), numbers(map(float, model), "double")
    ch, cls, c, i, pairs, acc, x = _fresh(7)
    classes = f"transform(split({token}, ''), {ch} -> element_at({code}, least(ascii({ch}), 127) + 1))"
    steps = f"transform(slice({cls}, 2, greatest(size({cls}) - 1, 0)), ({c}, {i}) -> element_at({table}, element_at({cls}, {i} + 1) * {CLASSES} + {c} + 1))"
    mean = f"aggregate({pairs}, 0D, ({acc}, {x}) -> {acc} + {x}) / greatest(size({pairs}), 1)"
    return bound(classes, cls, bound(steps, pairs, mean))


def bound(value: str, name: str, body: str) -> str:
    """``body`` with the value computed once under a name: a lambda would compute an outer expression anew for every element."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def running(xs: str, zero: int, op: Callable[[str, str], str]) -> str:
    """op over all elements up to each one (a sum, a maximum) of an int array. In blocks of about the square root of its
    length, as a fold copies what it has made at every step."""

    def fold(block: str) -> str:
        out, x = _fresh(2)
        return f"aggregate({block}, cast(array() as array<int>), ({out}, {x}) -> concat({out}, array(cast({op(f'coalesce(get({out}, size({out}) - 1), {zero})', x)} as int))))"

    every, step, i, made, m, ends, before, x = _fresh(8)
    blocks = f"transform(sequence(0, cast(ceil(size({every}) / {step}) as int) - 1), {i} -> {fold(f'slice({every}, {i} * {step} + 1, {step})')})"
    last = fold(f"transform({made}, {m} -> element_at({m}, -1))")
    shifted = bound(last, ends, f"concat(array({zero}), slice({ends}, 1, size({ends}) - 1))")
    whole = f"flatten(zip_with({made}, {shifted}, ({m}, {before}) -> transform({m}, {x} -> cast({op(before, x)} as int))))"
    body = bound(f"cast(ceil(sqrt(size({every}))) as int)", step, bound(blocks, made, whole))
    return f"if(size({xs}) = 0, cast(array() as array<int>), {bound(xs, every, body)})"


def _starts(parts: str, hits: str) -> str:
    """0-based starts of the matches from part and match lengths."""
    p, m, sizes, e, x, y = _fresh(6)
    both = f"zip_with(slice({parts}, 1, size({hits})), {hits}, ({p}, {m}) -> named_struct('p', length({p}), 'm', length({m})))"
    ends = running(f"transform({sizes}, {x} -> {x}.p + {x}.m)", 0, lambda a, b: f"{a} + {b}")
    return bound(both, sizes, f"zip_with({ends}, {sizes}, ({e}, {y}) -> {e} - {y}.m)")


def _spans(kind: str, pattern: str) -> str:
    """Spans (s, e, k, m) of the matches h_kind that ok_kind holds for. The text is split only if one does."""
    hits, kept = f"h_{kind}", f"ok_{kind}"
    parts, s, m, at, n, x, y, o = _fresh(8)
    starts = bound(f"split(text, {quoted(pattern)}, -1)", parts, _starts(parts, hits))
    made = f"transform({at}, ({s}, {n}) -> named_struct('s', {s}, 'e', {s} + length(get({hits}, {n})), 'k', {KINDS.index(kind)}, 'm', get({hits}, {n})))"
    spans = bound(starts, at, f"filter({made}, ({x}, {y}) -> get({kept}, {y}))")
    return f"if(exists({kept}, {o} -> {o}), {spans}, cast(array() as array<struct<s:int,e:int,k:int,m:string>>))"


def _without_overlaps(spans: str) -> str:
    """Sorted spans without those of the models that overlap a base span: the furthest end of the base spans up to each
    one, and the nearest start of those after it, tell."""
    every, x, far, near, i = _fresh(5)
    base = lambda field, other: f"transform({every}, {x} -> if({x}.k < 3, {x}.{field}, {other}))"
    furthest = running(base("e", -1), -1, lambda a, b: f"greatest({a}, {b})")
    nearest = "reverse(" + running(f"reverse({base('s', 2**31 - 1)})", 2**31 - 1, lambda a, b: f"least({a}, {b})") + ")"
    kept = f"filter({every}, ({x}, {i}) -> {x}.k < 3 or (get({far}, {i}) <= {x}.s and get({near}, {i}) >= {x}.e))"
    return bound(spans, every, bound(furthest, far, bound(nearest, near, kept)))


def _text_of(spans: str) -> str:
    kinds, x = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")", _fresh()[0]
    return f"array_join(transform({spans}, {x} -> concat_ws(':', element_at({kinds}, {x}.k + 1), cast({x}.s as string), cast({x}.e as string))), ',')"


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: Sequence[float] | None = None,
    threshold: float = 1.0,
    keep: Sequence[str] = (),
) -> DataFrame:
    """doc_id, text, found: array of (s, e, k) sorted by start then kind, n_assign, n_access, n_hex, base, all (as text)."""
    model = list(model if model is not None else default_model())
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keep)
    # a cheap pre-test per kind spares most texts the slower passes
    tests = {
        "assign": f"text rlike {quoted(r'(?i:passw|secret|token|api_?key)')}",
        "access": "contains(text, 'AKIA')",
        "hex": "text rlike '[0-9a-f]{24}'",
        "markov": "text rlike '[A-Za-z0-9+/_=-]{16}'",
    }
    pats = {k: p for k, p, _, _ in PATTERNS} | {"markov": JUDGED}
    df = df.select("*", *[F.expr(f"if({tests[k]}, regexp_extract_all(text, {quoted(pats[k])}, 0), cast(array() as array<string>))").alias(f"h_{k}") for k in KINDS])
    m = _fresh()[0]
    kept = {k: f"length(regexp_extract({m}, {quoted(pats[k])}, {group})) >= {least}" for k, _, group, least in PATTERNS}
    kept["markov"] = f"{llr_of(m, model)} >= {float(threshold)!r}D"
    df = df.select("*", *[F.expr(f"transform(h_{k}, {m} -> {kept[k]})").alias(f"ok_{k}") for k in KINDS])
    df = df.select("doc_id", "text", *keep, *[F.expr(_spans(k, pats[k])).alias(f"s_{k}") for k in KINDS])
    df = df.withColumn("base_spans", F.expr("array_sort(concat(s_assign, s_access, s_hex))"))
    both = _without_overlaps("array_sort(concat(base_spans, s_markov))")
    df = df.withColumn("found", F.expr(f"if(size(s_markov) = 0, base_spans, {both})"))
    return df.select(
        "doc_id", "text", *keep, "found",
        *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.expr(_text_of("base_spans")).alias("base"), F.expr(_text_of("found")).alias("spans"),
    )


def mask_secrets(found: str = "found", text: str = "text", mask: str = "[SECRET]") -> Column:
    """The text (by columns' names) with every span replaced; of overlapping spans the first puts the mask. The text is cut
    into blocks once, as taking a part of it by place costs as much as all that stands before."""
    i, blocks, spans, x, y, ends, n = _fresh(7)

    def piece(a: str, b: str) -> str:
        part = f"array_join(slice({blocks}, {a} div {BLOCK} + 1, {b} div {BLOCK} - {a} div {BLOCK} + 1), '')"
        return f"if({b} > {a}, substring({part}, {a} - {a} div {BLOCK} * {BLOCK} + 1, {b} - {a}), '')"

    furthest = running(f"transform({spans}, {x} -> {x}.e)", 0, lambda a, b: f"greatest({a}, {b})")
    before = f"if({n} = 0, 0, get({ends}, {n} - 1))"
    one = f"if({x}.s >= {before}, concat({piece(before, f'{x}.s')}, {quoted(mask)}), '')"
    last = f"array_max({ends})"
    whole = f"concat(array_join(transform({spans}, ({x}, {n}) -> {one}), ''), {bound(last, y, piece(y, f'length({text})'))})"
    cuts = f"transform(sequence(0, length({text}) div {BLOCK}), {i} -> substring({text}, cast({i} * {BLOCK} + 1 as int), {BLOCK}))"
    return F.expr(f"if(size({found}) = 0, {text}, {bound(found, spans, bound(cuts, blocks, bound(furthest, ends, whole)))})")
