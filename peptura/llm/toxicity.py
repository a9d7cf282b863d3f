"""Toxicity: a bidirectional GRU with attention pooling over word and character inputs, trained in numpy.

A word's input is its own hashed vector plus the means of the hashed vectors of its character trigrams and of its
beginnings, which carry over to words never met in training. Texts are cut into
overlapping windows of ``WINDOW`` words, ``STRIDE`` apart, the last padded; every window is scored and a text's score
is that of its worst window.

Training uses at most ``per_label`` toxic and ``clean_times`` as many clean labelled rows (by hash order of doc_id) and
at most ``per_doc`` windows of each, which bounds it whatever the size of the corpus. It first learns every window under its text's label,
then, as only some windows of a toxic text are toxic, the worst window of each toxic text and the windows of the others.

Cases: null and empty texts, or texts without words, get the score of an all-padded window; very long texts have every
window scored; repeated rows are scored each; a null label is no label; of rows that share a labelled
id one text, that of the least hash, is learned from; of unlike labels of one id that are chosen the toxic one counts; if a label is missing among the labels, the
model is trained on what there is; empty tables give empty results (or an untrained model). Other columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import over_slices
from .common import alnum_words, cut, mix

WINDOW, STRIDE = 32, 24
HIDDEN, DIM, WORD_ROWS, CHAR_ROWS = 8, 8, 1 << 14, 1 << 14
HEAD_MOST = 7
BLOCK = 2048


@dataclass
class Model:
    """p: parameters by name. E/C: word and trigram vectors; W, U, b: gates z, r, n of both directions (leading axis)."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 7, dtype=np.float32) -> Model:
        g = np.random.default_rng(seed)
        r = lambda *s, k=0.3: g.normal(0, k, s).astype(dtype)
        h = HIDDEN
        p = {"E": r(WORD_ROWS, DIM, k=0.1), "C": r(CHAR_ROWS, DIM, k=0.1), "W": r(2, DIM, 3 * h), "U": r(2, h, 3 * h), "b": np.zeros((2, 3 * h), dtype)}
        p |= {"A": r(2 * h, h), "a": np.zeros(h, dtype), "v": r(h), "w": r(2 * h), "o": np.zeros(1, dtype)}
        return cls(p)


@dataclass
class Features:
    """Of some words: word rows, character rows with their owners and weights."""

    first: np.ndarray
    flat: np.ndarray
    owner: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, words: list[bytes], dtype=np.float32) -> Features:
        """Beginnings of 1 to 6 bytes and trigrams, of words with marked ends, hashed into one table."""
        n = len(words)
        text = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
        size = np.fromiter(map(len, words), np.int64, n) + 2
        start = np.cumsum(size) - size
        first = np.fromiter(map(zlib.crc32, words), np.int64, n) % WORD_ROWS
        tri_n = size - 2  # a word has one byte at least
        tri_owner = np.repeat(np.arange(n), tri_n)
        at = np.arange(len(tri_owner)) - (np.cumsum(tri_n) - tri_n)[tri_owner] + start[tri_owner]
        tri = (text[at] << np.uint64(16)) | (text[at + 1] << np.uint64(8)) | text[at + 2]
        h, heads, head_owner = text[start] if n else text[:0], [], []
        for k in range(1, HEAD_MOST + 1):
            own = np.flatnonzero(size > k)
            h[own] = h[own] * np.uint64(1_000_003) + text[start[own] + k] + np.uint64(1)
            if k >= 2:
                heads.append(h[own])
                head_owner.append(own)
        heads, head_owner = np.concatenate(heads), np.concatenate(head_owner)
        head_n = np.bincount(head_owner, minlength=n)
        flat = (mix(np.concatenate([heads, tri])) % np.uint64(CHAR_ROWS)).astype(np.int64)
        owner = np.concatenate([head_owner, tri_owner])
        share = np.concatenate([1 / head_n[head_owner], 1 / tri_n[tri_owner]]).astype(dtype)
        order = np.argsort(owner, kind="stable")
        return cls(first, flat[order], owner[order], share[order])

    def take(self, own: np.ndarray) -> Features:
        """The features of the words numbered own (ascending)."""
        lo, hi = np.searchsorted(self.owner, own), np.searchsorted(self.owner, own, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return Features(self.first[own], self.flat[at], np.repeat(np.arange(len(own)), n), self.weight[at])


def word_vectors(m: Model, f: Features, keep: np.ndarray | float = 1.0) -> np.ndarray:
    """Inputs of words; keep scales the words' own vectors (dropout in training)."""
    x = m.p["E"][f.first] * np.asarray(keep, m.p["E"].dtype).reshape(-1, 1)
    if len(f.flat):
        x = x + np.add.reduceat(m.p["C"][f.flat] * f.weight[:, None], np.searchsorted(f.owner, np.arange(len(f.first))))
    return x


def project(m: Model, x: np.ndarray) -> np.ndarray:
    """Gate inputs of both directions for distinct words; the last row is the padding, which keeps the state as it is."""
    xp = np.einsum("nd,kde->kne", x, m.p["W"]) + m.p["b"][:, None]
    pad = np.zeros((2, 1, 3 * HIDDEN), xp.dtype)
    pad[:, :, :HIDDEN] = 40
    return np.concatenate([xp, pad], 1)


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(m: Model, xp: np.ndarray, idx: np.ndarray, keep: bool = False):
    """Logits of windows of word numbers idx (windows, WINDOW); padding is the last row of xp."""
    n, t_all, h_all, tape = len(idx), idx.shape[1], HIDDEN, []
    hs = np.zeros((t_all, n, 2 * h_all), xp.dtype)
    for k in (0, 1):
        h, u = np.zeros((n, h_all), xp.dtype), m.p["U"][k]
        for t in range(t_all) if k == 0 else range(t_all - 1, -1, -1):
            x = xp[k][idx[:, t]]
            hu = h @ u
            zr = _sig(x[:, : 2 * h_all] + hu[:, : 2 * h_all])
            z, r = zr[:, :h_all], zr[:, h_all:]
            c = np.tanh(x[:, 2 * h_all :] + r * hu[:, 2 * h_all :])
            if keep:
                tape.append((k, t, h, z, r, c, hu[:, 2 * h_all :]))
            h = c + z * (h - c)
            hs[t, :, k * h_all : (k + 1) * h_all] = h
    q = np.tanh(hs @ m.p["A"] + m.p["a"])
    e = q @ m.p["v"]
    e = np.where(idx.T == xp.shape[1] - 1, np.asarray(-1e4, e.dtype), e)
    e = np.exp(e - e.max(0))
    alpha = e / e.sum(0)
    ctx = np.einsum("tn,tnh->nh", alpha, hs)
    logit = ctx @ m.p["w"] + m.p["o"][0]
    return (logit, (hs, q, alpha, ctx, tape)) if keep else logit


def gate_tables(xp: np.ndarray) -> list[list[np.ndarray]]:
    """The gate inputs as contiguous tables [direction][gate]."""
    return [[np.ascontiguousarray(xp[k][:, g * HIDDEN : (g + 1) * HIDDEN], np.float32) for g in range(3)] for k in (0, 1)]


def infer(m: Model, tables: list[list[np.ndarray]], idx: np.ndarray) -> np.ndarray:
    """As forward, without what gradients need and on contiguous arrays."""
    at, n = np.ascontiguousarray(idx.T), len(idx)
    hs = np.empty((2, len(at), n, HIDDEN), np.float32)
    for k in (0, 1):
        xz, xr, xc = tables[k]
        uz, ur, uc = (np.ascontiguousarray(m.p["U"][k][:, g * HIDDEN : (g + 1) * HIDDEN]) for g in range(3))
        h = np.zeros((n, HIDDEN), np.float32)
        for t in range(len(at)) if k == 0 else range(len(at) - 1, -1, -1):
            i = at[t]
            z, r, c = h @ uz, h @ ur, h @ uc
            for g, x in ((z, xz), (r, xr)):
                g += x.take(i, 0)
                g *= 0.5
                np.tanh(g, out=g)
                g += 1
                g *= 0.5
            c *= r
            c += xc.take(i, 0)
            np.tanh(c, out=c)
            h = h - c
            h *= z
            h += c
            hs[k, t] = h
    a, w = m.p["A"], m.p["w"]
    q = hs[0] @ a[:HIDDEN]
    q += hs[1] @ a[HIDDEN:]
    q += m.p["a"]
    np.tanh(q, out=q)
    e = q @ m.p["v"]
    e[at == len(tables[0][0]) - 1] = -1e4
    e = np.exp(e - e.max(0))
    return (e * (hs[0] @ w[:HIDDEN] + hs[1] @ w[HIDDEN:])).sum(0) / e.sum(0) + m.p["o"][0]


def gradients(m: Model, f: Features, idx: np.ndarray, y: np.ndarray, weight: np.ndarray, keep: np.ndarray | float = 1.0):
    """Weighted log-loss and its gradients."""
    x = word_vectors(m, f, keep)
    xp, h_all = project(m, x), HIDDEN
    logit, (hs, q, alpha, ctx, tape) = forward(m, xp, idx, keep=True)
    loss = float((weight * (np.logaddexp(0, logit) - y * logit)).sum())
    d = (weight * (_sig(logit) - y)).astype(xp.dtype)
    g = {k: np.zeros_like(v) for k, v in m.p.items()}
    g["w"], g["o"] = ctx.T @ d, np.array([d.sum()], xp.dtype)
    dctx = d[:, None] * m.p["w"]
    dhs = alpha[:, :, None] * dctx
    dalpha = np.einsum("nh,tnh->tn", dctx, hs)
    de = alpha * (dalpha - (alpha * dalpha).sum(0))
    dq = de[:, :, None] * m.p["v"] * (1 - q * q)
    g["v"] = np.einsum("tn,tnh->h", de, q)
    g["A"], g["a"] = np.einsum("tnh,tnk->hk", hs, dq), dq.sum((0, 1))
    dhs = dhs + dq @ m.p["A"].T
    dxp = np.zeros_like(xp)
    for k in (0, 1):
        dh, u = np.zeros((len(idx), h_all), xp.dtype), m.p["U"][k]
        for kk, t, h0, z, r, c, un in reversed([s for s in tape if s[0] == k]):
            dh = dh + dhs[t, :, k * h_all : (k + 1) * h_all]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h0 - c) * z * (1 - z)
            dr = dc * un * r * (1 - r)
            dx = np.concatenate([dz, dr, dc], 1)
            dhu = np.concatenate([dz, dr, dc * r], 1)
            np.add.at(dxp[k], idx[:, t], dx)
            g["U"][k] += h0.T @ dhu
            dh = dh * z + dhu @ u.T
    dxp = dxp[:, :-1]  # the padding row is fixed
    g["W"], g["b"] = np.einsum("nd,kne->kde", x, dxp), dxp.sum(1)
    dx = np.einsum("kne,kde->nd", dxp, m.p["W"])
    np.add.at(g["E"], f.first, dx * np.asarray(keep, dx.dtype).reshape(-1, 1))
    np.add.at(g["C"], f.flat, dx[f.owner] * f.weight[:, None])
    return loss, g


def windows_of(n: int) -> range:
    """Starts of the windows of a text of n words: at least one, STRIDE apart, the last reaching the end."""
    return range(0, max(n - WINDOW + STRIDE, 1), STRIDE)


def number(windows: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words and, for each window, their numbers padded with len(words)."""
    seen: dict[bytes, int] = {}
    rows = [[seen.setdefault(w, len(seen)) for w in win] for win in windows]
    idx = np.full((len(rows), WINDOW), len(seen), np.int64)
    for i, r in enumerate(rows):
        idx[i, : len(r)] = r
    return list(seen), idx


def calibrate(m: Model, docs: list[tuple[int, list[list[bytes]]]], threshold: float) -> None:
    """Shift the output so that the cut of fewest errors on labelled texts lies at the threshold."""
    words, idx = number([w for _, wins in docs for w in wins])
    ends = np.cumsum([len(wins) for _, wins in docs])
    y = np.array([y for y, _ in docs])
    if len(set(y.tolist())) < 2:
        return
    worst = np.maximum.reduceat(_score(m, Features.of(words), idx), np.append(0, ends[:-1]))
    order = np.argsort(worst)
    worst, y = worst[order], y[order]
    # errors of a cut below place i; clean texts are rarer in the sample than in a corpus, so theirs count four times
    wrong = np.append(0, np.cumsum(y == 1)) + 4 * ((y == 0).sum() - np.append(0, np.cumsum(y == 0)))
    best = np.flatnonzero(wrong == wrong.min())
    i = int(best[len(best) // 2])
    cut = worst[0] - 1 if i == 0 else worst[-1] + 1 if i == len(worst) else 0.35 * worst[i - 1] + 0.65 * worst[i]
    m.p["o"] += np.float32(np.log(threshold / (1 - threshold)) - cut)


def fit(
    docs: list[tuple[int, list[list[bytes]]]], seed: int = 7, rounds: tuple[int, int] = (1, 4), batch: int = 256, rate: float = 0.01, threshold: float = 0.3
) -> Model:
    """A model from (label, windows) of labelled texts, by Adam; every seventh text only sets the cut."""
    m = Model.fresh(seed)
    docs = [(y, [w for w in wins if w]) for y, wins in docs]
    docs = [d for d in docs if d[1]]
    if not docs:
        return m
    aside, docs = (docs[::7], [d for i, d in enumerate(docs) if i % 7]) if len(docs) >= 70 else (docs, docs)
    g, step = np.random.default_rng(seed), 0
    mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.p.items()}
    flat = [(d, w) for d, (_, wins) in enumerate(docs) for w in wins]
    owner, label = np.array([d for d, _ in flat]), np.array([docs[d][0] for d, _ in flat], np.float32)
    words, idx = number([w for _, w in flat])
    feats = Features.of(words)
    batch = min(batch, max(24, len(flat) // 30))
    more = min(40, max(1, -(-(400 if len(flat) < 3000 else 200) * batch // (sum(rounds) * len(flat)))))  # small samples are read more often
    rounds = (rounds[0] * more, rounds[1] * more)
    for turn in range(sum(rounds)):
        use = np.arange(len(flat))
        if turn >= rounds[0]:  # of toxic texts only the worst window
            logit = _score(m, feats, idx)
            order = np.lexsort((-logit, owner))
            worst = order[np.append(True, np.diff(owner[order]) != 0)]
            use = np.concatenate([worst, np.flatnonzero((label == 0) & ~np.isin(use, worst))])
        share = [max(1, int((label[use] == y).sum())) for y in (0, 1)]
        g.shuffle(use)
        for i in range(0, len(use), batch):
            b = use[i : i + batch]
            own, at = np.unique(idx[b], return_inverse=True)
            at = at.reshape(idx[b].shape)
            if own[-1] != len(words):
                own = np.append(own, len(words))
            y = label[b]
            weight = np.where(y == 1, min(4.0, share[0] / share[1]), 1.0).astype(np.float32) / len(b)
            keep = 2.0 * (g.random(len(own) - 1) < 0.5)
            _, grad = gradients(m, feats.take(own[:-1]), at, y, weight, keep)
            step += 1
            for k, p in m.p.items():
                a, v = mom[k]
                a *= 0.9
                a += 0.1 * grad[k]
                v *= 0.99
                v += 0.01 * grad[k] ** 2
                p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(p.dtype)
    calibrate(m, aside, threshold)
    return m


def _score(m: Model, f: Features, idx: np.ndarray) -> np.ndarray:
    tables = gate_tables(project(m, word_vectors(m, f)))
    return np.concatenate([infer(m, tables, idx[i : i + BLOCK]) for i in range(0, len(idx), BLOCK)]) if len(idx) else np.zeros(0)


class Numbers(dict):
    """word -> number in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Scorer:
    """Scores texts; keeps the gate inputs of the words it has met, up to ``most`` of them."""

    def __init__(self, model: Model, most: int = 400_000):
        self.m, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.seen = Numbers()
        self.room = 1 << 14
        self.tables = [[np.empty((self.room, HIDDEN), np.float32) for _ in range(3)] for _ in (0, 1)]

    def learn(self, had: int) -> list[list[np.ndarray]]:
        """Tables with the words since ``had``, and the padding in the last row."""
        n = len(self.seen)
        new = project(self.m, word_vectors(self.m, Features.of(list(itertools.islice(self.seen, had, None)))))
        while self.room <= n:
            self.room *= 2
        for k in (0, 1):
            for g in range(3):
                t = self.tables[k][g]
                if len(t) < self.room:
                    t = self.tables[k][g] = np.concatenate([t, np.empty((self.room - len(t), HIDDEN), np.float32)])
                t[had : n + 1] = new[k][:, g * HIDDEN : (g + 1) * HIDDEN]
        return [[t[: n + 1] for t in self.tables[k]] for k in (0, 1)]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if len(self.seen) > self.most:
            self.clear()
        per, had = [alnum_words(t) for t in texts], len(self.seen)
        n = np.array([len(w) for w in per], np.int64)
        at = np.fromiter(map(self.seen.__getitem__, itertools.chain.from_iterable(per)), np.int32, int(n.sum()))
        tables, pad = self.learn(had), len(self.seen)
        wins = np.maximum(-(-(n - WINDOW + STRIDE) // STRIDE), 1)
        doc = np.repeat(np.arange(len(n)), wins)
        first = np.cumsum(wins) - wins
        start = (np.arange(len(doc)) - first[doc]) * STRIDE
        offset = np.cumsum(n) - n
        at = np.append(at, np.int32(pad))
        logit = np.empty(len(doc), np.float32)
        for i in range(0, len(doc), BLOCK):
            d = doc[i : i + BLOCK]
            place = start[i : i + BLOCK, None] + np.arange(WINDOW)
            logit[i : i + BLOCK] = infer(self.m, tables, at[np.where(place < n[d][:, None], place + offset[d][:, None], len(at) - 1)])
        return _sig(np.maximum.reduceat(logit, first).astype(np.float64)) if len(n) else np.zeros(0)


def sample_windows(docs: DataFrame, labels: DataFrame, per_label: tuple[int, int], per_doc: int, id_col: str, text_col: str) -> list:
    """(label, windows) of at most per_label[label] labelled rows of each label; held-out rows are not among them."""
    rows = labels.select(F.col("doc_id").alias("lid"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where("toxic in (0, 1) and lid is not null and crc32(cast(cast(lid as string) as binary)) % 4 <> 2")
    texts = docs.selectExpr(f"cast(`{id_col}` as bigint) lid", f"`{text_col}` text")
    rows = cut(rows.join(texts.select("lid"), "lid", "left_semi"))  # ids without a document take no place; read twice
    picks = [rows.where(F.col("toxic") == y).orderBy(F.xxhash64("lid"), "lid").limit(per_label[y]) for y in (0, 1)]
    chosen = picks[0].union(picks[1]).groupBy("lid").agg(F.max("toxic").alias("toxic"))  # bounded by the two limits, so it is broadcast

    def make():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for t in part.column(1).to_pylist():
                ws = alnum_words(t)
                starts = list(windows_of(len(ws)))
                if len(starts) > per_doc:
                    own = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"))  # by the text: ids have no part in learning
                    starts = sorted(np.random.default_rng(own).choice(starts, per_doc, replace=False).tolist())
                out.append([b" ".join(ws[s : s + WINDOW]).decode("utf-8", "replace") for s in starts])
            return pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(out, pa.list_(pa.string()))], names=["doc_id", "toxic", "windows"])

        return step

    # of rows with one id the text of the least hash is read, so there are no more texts than chosen ids
    one = texts.join(F.broadcast(chosen), "lid").groupBy("lid", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    got = one.select("lid", "least.text", "toxic").mapInArrow(over_slices(make, 1), "doc_id long, toxic int, windows array<string>")
    kept = got.collect()
    return [(r["toxic"], [w.encode().split() for w in r["windows"]]) for r in sorted(kept, key=lambda r: (r["doc_id"], r["windows"]))]


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.3,
    per_label: int = 900,
    clean_times: float = 1.6,
    per_doc: int = 8,
    train_docs: DataFrame | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, text, held_out, score, predicted, and the columns of the input named in keep."""
    sample = sample_windows(train_docs if train_docs is not None else docs, labels, (int(per_label * clean_times), per_label), per_doc, id_col, text_col)
    model = fit(sample, threshold=threshold)
    sent = docs.sparkSession.sparkContext.broadcast(model.p)

    def make():
        scorer = Scorer(Model(sent.value))

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            scores = pa.array(scorer(part.column(1).to_pylist()), pa.float64())
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), scores, *part.columns[2:]], names=["doc_id", "text", "score", *keep])

        return step

    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), df.schema["text"], T.StructField("score", T.DoubleType()), *(df.schema[k] for k in keep)])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return df.mapInArrow(over_slices(make, 1), schema).select(
        "doc_id", "text", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *keep
    )


