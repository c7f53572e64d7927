"""Toxicity scores from a bidirectional gated recurrent network with
attention pooling, trained in numpy on the driver and run over every
overlapping window of every text inside Spark tasks.

Inputs of a position: the word's evidence, and the strongest and the mean
evidence of its character 4- and 5-grams.  Evidence is the lower confidence
bound of a log odds between labelled toxic and clean training documents, so
rare words and n-grams count as nothing.  The recurrent weights, the
attention and the output are learned on windows: a toxic document's most
suspicious window against the most suspicious and random windows of clean
ones, chosen anew by the network between rounds.

The network goes along a text once in each direction, not once a window: in
blocks of BLOCK words that begin CONTEXT words early (on both sides), so a
state knows at least CONTEXT words before it and no text is one long chain.
The windows then differ only in which positions the attention is over; its
sums for all windows of WINDOW words, one from every word, are sliding sums.
Training sees windows in the same surroundings.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, held_out, with_fields

WORD = re.compile(r"[^\W\d_]+")
WINDOW, HIDDEN, INPUTS = 32, 8, 3
BLOCK, CONTEXT = 128, 16
#: Bound of the training sample: labelled documents, read whole.
SAMPLE = 4000
#: Parts of the sample whose evidence comes from the other parts.
FOLDS = 4


def grams(word: str) -> list[str]:
    return [word[i:i + n] for n in (4, 5) for i in range(len(word) - n + 1)]


def evidence(docs: list[list[str]], labels: np.ndarray, of, z: float = 1.5, least: float = 0.05) -> dict:
    """feature -> lower bound of the log odds, where it is above ``least``."""
    toxic, clean = Counter(), Counter()
    for words, y in zip(docs, labels):
        (toxic if y else clean).update({f for w in set(words) for f in of(w)})
    n1, n0 = max(1, labels.sum()), max(1, (labels == 0).sum())
    out = {}
    for f, a in toxic.items():
        b = clean[f]
        odds = np.log((a + .5) / (n1 - a + .5)) - np.log((b + .5) / (n0 - b + .5))
        low = odds - z * np.sqrt(1 / (a + .5) + 1 / (b + .5) + 1 / (n1 - a + .5) + 1 / (n0 - b + .5))
        if low > least:
            out[f] = float(low)
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    words: dict
    grams: dict
    net: dict | None
    base: float            # score of a text without words, or of all texts without a network
    shift: float = 0.0     # puts the best training threshold at 0.5

    def inputs(self, word: str) -> tuple[float, float, float]:
        g = [self.grams.get(x, 0.0) for x in grams(word)]
        return self.words.get(word, 0.0), max(g, default=0.0), sum(g) / max(1, len(g))


class Inputs(dict):
    """word -> input vector, remembered up to a bound."""

    def __init__(self, model: Model, most: int = 300_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        v = self[word] = self.model.inputs(word)
        return v

    def of(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").lower())
        flat = [x for w in words for x in self[w]]
        return np.array(flat, np.float32).reshape(-1, INPUTS)


def windows(x: np.ndarray) -> np.ndarray:
    """All windows of WINDOW positions, one from each position (a view); a
    shorter text is one window, filled up with zeros."""
    if len(x) < WINDOW:
        x = np.concatenate([x, np.zeros((WINDOW - len(x), INPUTS), np.float32)])
    return np.lib.stride_tricks.sliding_window_view(x, WINDOW, axis=0).transpose(0, 2, 1)


def start_net(rng) -> dict:
    def mat(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    net = {"a": mat(2 * HIDDEN, HIDDEN), "v": mat(HIDDEN, 1), "o": mat(2 * HIDDEN, 1),
           "ob": np.full((1, 1), -1, np.float32)}
    for d in "fb":
        net |= {f"W{d}": mat(INPUTS, 3 * HIDDEN), f"U{d}": mat(HIDDEN, 3 * HIDDEN),
                f"c{d}": np.zeros((1, 3 * HIDDEN), np.float32)}
    return net


def gru(net, d, proj, mask, keep=None):
    """States (steps, n, HIDDEN) over projected inputs; a masked step leaves
    the state as it is."""
    H, U = HIDDEN, net[f"U{d}"]
    h = np.zeros((proj.shape[1], H), np.float32)
    out = np.empty((len(proj), proj.shape[1], H), np.float32)
    for t in range(len(proj)) if d == "f" else range(len(proj) - 1, -1, -1):
        rec = h @ U
        zr = sigmoid(proj[t, :, :2 * H] + rec[:, :2 * H])
        z, r = zr[:, :H], zr[:, H:]
        c = np.tanh(proj[t, :, 2 * H:] + r * rec[:, 2 * H:])
        m = mask[t]
        if keep is not None:
            keep.append((t, h, z, r, c, rec[:, 2 * H:]))
        h = h + m * z * (c - h)
        out[t] = h
    return out


def segment(x: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A window and CONTEXT positions on both sides: inputs, which positions
    the text has, and which belong to the window."""
    place = np.arange(at - CONTEXT, at + WINDOW + CONTEXT)
    has = (place >= 0) & (place < len(x))
    return (x[np.clip(place, 0, len(x) - 1)] * has[:, None], has,
            has & (place >= at) & (place < at + WINDOW))


def states(net, x, has, keep=None):
    """States of both directions (steps, n, 2 * HIDDEN) over inputs x (steps,
    n, INPUTS); positions that a text has not leave them as they are."""
    mask = has[:, :, None].astype(np.float32)
    kf, kb = ([], []) if keep is not None else (None, None)
    out = np.concatenate([gru(net, d, x @ net[f"W{d}"] + net[f"c{d}"], mask, k)
                          for d, k in (("f", kf), ("b", kb))], axis=2)
    if keep is not None:
        keep.update(x=x, mask=mask, f=kf, b=kb)
    return out


def forward(net, x, has, pool, keep=None):
    """Logits of segments: inputs x (n, steps, INPUTS), the positions that are
    there and those that are pooled (n, steps)."""
    h = states(net, np.ascontiguousarray(x.transpose(1, 0, 2)), has.T, keep)
    u = np.tanh(h @ net["a"])
    e = (u @ net["v"])[:, :, 0] - 1e4 * (1 - pool.T)
    w = np.exp(e - e.max(axis=0))
    w /= w.sum(axis=0)
    pooled = (w[:, :, None] * h).sum(axis=0)
    if keep is not None:
        keep.update(h=h, u=u, w=w, pooled=pooled)
    return (pooled @ net["o"] + net["ob"])[:, 0]


def backward(net, k, dlogit):
    H, g = HIDDEN, {}
    d = dlogit[:, None].astype(np.float32)
    g["o"], g["ob"] = k["pooled"].T @ d, d.sum(keepdims=True)
    dp = d @ net["o"].T
    dh = k["w"][:, :, None] * dp
    dw = (k["h"] * dp).sum(axis=2)
    de = k["w"] * (dw - (k["w"] * dw).sum(axis=0))
    g["v"] = np.einsum("tnh,tn->h", k["u"], de)[:, None]
    du = de[:, :, None] * net["v"][:, 0] * (1 - k["u"] ** 2)
    g["a"] = np.einsum("tni,tnj->ij", k["h"], du)
    dh = dh + du @ net["a"].T
    for i, side in enumerate("fb"):
        U, gU = net[f"U{side}"], np.zeros_like(net[f"U{side}"])
        dproj = np.zeros((*k["w"].shape, 3 * H), np.float32)
        carry = np.zeros((k["w"].shape[1], H), np.float32)
        for t, h, z, r, c, rec in reversed(k[side]):
            dn = dh[t, :, i * H:(i + 1) * H] + carry
            m = k["mask"][t]
            dz, dc = dn * m * (c - h) * z * (1 - z), dn * m * z * (1 - c ** 2)
            dr = dc * rec * r * (1 - r)
            dproj[t] = np.concatenate([dz, dr, dc], axis=1)
            drec = np.concatenate([dz, dr, dc * r], axis=1)
            gU += h.T @ drec
            carry = dn * (1 - m * z) + drec @ U.T
        g[f"U{side}"], g[f"c{side}"] = gU, dproj.sum(axis=(0, 1))[None]
        g[f"W{side}"] = np.einsum("tni,tnj->ij", k["x"], dproj)
    return g


def train(net, x, has, pool, y, rng, steps=250, batch=256, rate=0.01):
    """Adam on cross entropy; classes are drawn evenly."""
    first, second = ({n: np.zeros_like(p) for n, p in net.items()} for _ in range(2))
    one, zero = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for i in range(1, steps + 1):
        pick = np.concatenate([rng.choice(one, batch // 2), rng.choice(zero, batch // 2)])
        k: dict = {}
        p = sigmoid(forward(net, x[pick], has[pick], pool[pick], k))
        g = backward(net, k, (p - y[pick]) / batch)
        for n in net:
            first[n] = .9 * first[n] + .1 * g[n]
            second[n] = .999 * second[n] + .001 * g[n] ** 2
            step = (first[n] / (1 - .9 ** i)) / (np.sqrt(second[n] / (1 - .999 ** i)) + 1e-8)
            net[n] = (net[n] - rate * step).astype(np.float32)


def positions(net, x: np.ndarray, bounds: np.ndarray, most: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """For every position of the texts x[bounds[i]:bounds[i + 1]] the weight
    of the attention (not yet divided by a window's sum) and the output of
    its state.  Inner blocks without any evidence are all alike, so one of
    them is read for all."""
    sizes = np.diff(bounds)
    count = -(-sizes // BLOCK)
    doc = np.repeat(np.arange(len(sizes)), count)
    begin = bounds[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * BLOCK
    steps = np.arange(-CONTEXT, BLOCK + CONTEXT)
    inner = slice(CONTEXT, CONTEXT + BLOCK)
    weight, out = np.empty(len(x)), np.empty(len(x))

    def read(place, has):
        h = states(net, np.ascontiguousarray((x[np.clip(place, 0, len(x) - 1)] * has[:, :, None]).transpose(1, 0, 2)),
                   has.T)[inner]
        e = np.tanh(h @ net["a"]) @ net["v"]
        return np.exp(e[:, :, 0].T.astype(np.float64)), (h @ net["o"])[:, :, 0].T

    def put(rows, values):
        place = begin[rows][:, None] + np.arange(BLOCK)
        own = place < bounds[doc[rows] + 1][:, None]
        for into, v in zip((weight, out), values):
            into[place[own]] = np.broadcast_to(v, place.shape)[own]

    some = np.r_[0, np.cumsum(x.any(axis=1))]
    first, last = np.maximum(begin - CONTEXT, bounds[doc]), np.minimum(begin + BLOCK + CONTEXT, bounds[doc + 1])
    blank = (some[first] == some[last]) & (last - first == len(steps))
    if blank.any():
        one = np.flatnonzero(blank)[:1]
        put(np.flatnonzero(blank), read(begin[one][:, None] + steps, np.ones((1, len(steps)), bool)))
    rest = np.flatnonzero(~blank)
    for i in range(0, len(rest), most):
        rows = rest[i:i + most]
        place = begin[rows][:, None] + steps
        put(rows, read(place, (place >= bounds[doc[rows]][:, None]) & (place < bounds[doc[rows] + 1][:, None])))
    return weight, out


def sliding(v: np.ndarray) -> np.ndarray:
    """Sums of WINDOW (a power of two) values from every place on, by doubling."""
    v, size = np.concatenate([v, np.zeros(WINDOW)]), 1
    while size < WINDOW:
        v = np.concatenate([v[:-size] + v[size:], v[-size:]])
        size *= 2
    return v[:-WINDOW]


def document_logits(net, inputs: list[np.ndarray], most: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Largest window logit of each document (which has a word), and which
    window."""
    top = np.full(len(inputs), -np.inf)
    where = np.zeros(len(inputs), np.int64)
    held: list[int] = []

    def flush():
        size = np.array([len(inputs[i]) for i in held])
        bounds = np.r_[0, np.cumsum(size)]
        weight, out = positions(net, np.concatenate([inputs[i] for i in held]), bounds, most)
        count = np.maximum(1, size - WINDOW + 1)
        own = np.repeat(np.arange(len(held)), count)
        offset = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        at, short = bounds[own] + offset, size < WINDOW
        sums = []
        for v in (weight * out, weight):
            part = sliding(v)[at]
            part[short[own]] = np.add.reduceat(v, bounds[:-1])[short]  # a short text is one window
            sums.append(part)
        s = sums[0] / sums[1] + float(net["ob"][0, 0])
        order = np.lexsort((offset, -s, own))
        lead = order[np.r_[True, own[order][1:] != own[order][:-1]]]
        top[held], where[held] = s[lead], offset[lead]
        held.clear()

    words = 0
    for i, x in enumerate(inputs):
        if len(x):
            held.append(i)
            words += len(x)
            if words >= most * BLOCK:
                flush()
                words = 0
    if held:
        flush()
    return top, where


def fit_texts(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """Train on texts; with only one class, or none, every score is the base rate."""
    y = np.asarray(labels, np.int64)
    base = float(np.clip(y.mean() if len(y) else 0, 0.0, 1.0))
    if len(set(y.tolist())) < 2:
        return Model({}, {}, None, base)
    rng = np.random.default_rng(seed)
    words = [WORD.findall(t.lower()) for t in texts]

    def evident(rows):
        part = [words[i] for i in rows]
        return evidence(part, y[rows], lambda w: (w,)), evidence(part, y[rows], grams)

    model = Model(*evident(np.arange(len(y))), None, min(base, 0.49))
    # The network sees each training text through the evidence of the others,
    # as it will see new texts, so it learns how far evidence can be trusted.
    fold = rng.permutation(len(y)) % FOLDS
    inputs: list = [None] * len(y)
    for f in range(FOLDS):
        cache = Inputs(Model(*evident(np.flatnonzero(fold != f)), None, base))
        for i in np.flatnonzero(fold == f):
            inputs[i] = cache.of(texts[i])
    use = [i for i, x in enumerate(inputs) if len(x)]
    inputs, y = [inputs[i] for i in use], y[use]
    if len(set(y.tolist())) < 2:
        return model
    net = start_net(rng)
    where = np.array([int(np.argmax(windows(x).max(axis=2).sum(axis=1))) for x in inputs])
    for _ in range(3):
        parts, ys = [], []
        for x, label, at in zip(inputs, y, where):
            for j in {int(at)} | (set() if label else {int(rng.integers(max(1, len(x) - WINDOW + 1)))}):
                parts.append(segment(x, j))
                ys.append(label)
        train(net, *(np.stack(p) for p in zip(*parts)), np.array(ys), rng)
        top, where = document_logits(net, inputs)
    order = np.argsort(top)
    t, lab = top[order], y[order]
    # The threshold between two training scores with fewest errors, in the widest such gap.
    wrong = np.r_[0, np.cumsum(lab)] + np.r_[np.cumsum((1 - lab)[::-1])[::-1], 0]
    edge = np.r_[t[0] - 2, t, t[-1] + 2]
    best = np.flatnonzero(wrong == wrong.min())
    i = best[np.argmax(edge[best + 1] - edge[best])]
    model.net, model.shift = net, float((edge[i] + edge[i + 1]) / 2)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` labelled documents that are not held out
    (those of smallest id hash), whole.  A repeated label counts as toxic if any of them is; null labels are ignored."""
    pick = (labels.filter("toxic is not null").filter(~held_out())
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # Broadcast of at most ``sample`` ids.
    rows = (docs.select("doc_id", "text")
            .join(F.broadcast(pick), "doc_id")
            .orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(sample)
            .select("text", "toxic").toArrow())
    texts = [t or "" for t in rows.column("text").to_pylist()]
    return fit_texts(texts, np.array([int(v > 0) for v in rows.column("toxic").to_pylist()], np.int64))


def scores(texts: list[str | None], model: Model, cache: Inputs) -> np.ndarray:
    """Score per text: its most toxic window's; texts without words get the base rate."""
    out = np.full(len(texts), model.base)
    if model.net is not None:
        top, _ = document_logits(model.net, [cache.of(t) for t in texts])
        some = np.isfinite(top)
        out[some] = sigmoid(top[some] - model.shift)
    return out


def score(docs: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """Adds the score (0 to 1) of every whole text; null and empty texts get
    the training base rate (below 0.5).  A column already called ``name``
    is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def fn(batch, cache):
        texts = batch.column(text).to_pylist()
        return [batch.column(c) for c in kept] + [scores(texts, held.value, cache)]

    kept = [c for c in docs.columns if c != name]
    schema = with_fields(docs.select(*kept).schema, f"`{name}` double")
    return arrow_map(docs.select(*kept), fn, schema, slice_rows=512, start=lambda: Inputs(held.value))
