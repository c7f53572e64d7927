"""Language by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton.  A text is parsed
into the longest phrases that occur in the labelled text; the language that
needs the fewest phrases for each of its characters wins.

Parsing runs over many blocks of text at a time: each is a lane that walks
the transition tables one character a step; a missing transition ends a
phrase.  Texts are cut into blocks of BLOCK characters, so long ones do not
hold up a batch; a block's end ends a phrase.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, held_out

#: Bounds of the training sample: documents of a language, characters of one,
#: and symbols of its automaton.
SAMPLE, SAMPLE_CHARS, SYMBOLS = 200, 2000, 60_000
BLOCK, LANES = 512, 4096


def normalised(text: str | None) -> str:
    """Lower-case letters; runs of anything else are one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())


def suffix_automaton(s: list[int], symbols: int) -> np.ndarray:
    """Transitions (state, symbol) of the automaton of all substrings, -1 if none."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in s:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    out = np.full((len(nxt), symbols), -1, np.int32)
    for i, t in enumerate(nxt):
        for c, j in t.items():
            out[i, c] = j
    return out


@dataclass
class Model:
    langs: list[str]
    symbol: dict[str, int]         # letter -> number; 0 is the space, the last any other letter
    tables: list[np.ndarray]


def fit_texts(texts: dict[str, str], symbols: int = SYMBOLS) -> Model:
    texts = {lang: normalised(t)[:symbols] for lang, t in sorted(texts.items())}
    letters = sorted(set("".join(texts.values())) - {" "})
    symbol = {" ": 0} | {c: i + 1 for i, c in enumerate(letters)}
    return Model(list(texts), symbol, [suffix_automaton([symbol[c] for c in t], len(symbol) + 1)
                                       for t in texts.values()])


def fit(docs: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """Learn from at most ``sample`` documents of each language that are not
    held out (those of smallest id hash), ``chars`` characters of each."""
    rank = Window.partitionBy("lang").orderBy("h", "doc_id", "t")
    rows = (docs.filter("lang is not null and text is not null").filter(~held_out())
            .select("lang", "doc_id", F.xxhash64("doc_id").alias("h"), F.substring("text", 1, chars).alias("t"))
            .withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= sample)
            .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("s"))
            .select("lang", F.array_join(F.transform("s", lambda x: x["t"]), " ").alias("t")).collect())
    return fit_texts({r.lang: r.t for r in rows})


class Parser:
    """Tables of one task: the automata stacked, and symbols by code point."""

    def __init__(self, model: Model):
        self.model = model
        self.width = len(model.symbol) + 1
        self.flat = np.concatenate([t.ravel() for t in model.tables]) if model.langs else np.empty(0, np.int32)
        self.base = np.cumsum([0] + [t.size for t in model.tables])[:-1]
        self.known: dict[str, int] = {}

    def symbols_of(self, text: str) -> np.ndarray:
        """Symbol numbers with runs of non-letters as one 0, none at the ends."""
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        seen, at = np.unique(code, return_inverse=True)
        out = np.empty(len(seen), np.int32)
        for i, c in enumerate(map(chr, seen.tolist())):
            out[i] = self.model.symbol.get(c, self.width - 1) if c.isalpha() else 0
        s = out[at]
        s = s[(s > 0) | np.r_[False, s[:-1] > 0]] if len(s) else s
        return s[:-1] if len(s) and s[-1] == 0 else s

    def phrases(self, lanes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Phrases of each lane (padded with 0, ``size`` symbols, longest
        first) under each language."""
        n, k = len(lanes), len(self.model.langs)
        out = np.zeros((n, k), np.int32)
        steps = np.ascontiguousarray(lanes.T)
        ends = np.searchsorted(-size, -np.arange(lanes.shape[1]), "left")     # lanes longer than each step
        for j in range(k):
            table = self.flat[self.base[j]:self.base[j] + self.model.tables[j].size]
            start = table[:self.width]
            state = np.zeros(n, np.int32)
            count = out[:, j]
            for t in range(lanes.shape[1]):
                m = ends[t]
                if not m:
                    break
                c = steps[t, :m]
                new = table[state[:m] * self.width + c]
                # A missing transition ends a phrase (state 0 has none open);
                # a character that the language lacks is one by itself.
                miss = np.flatnonzero(new < 0)
                again = start[c[miss]]
                count[miss] += (state[miss] != 0).astype(np.int32) + (again < 0)
                new[miss] = np.maximum(again, 0)
                state[:m] = new
            count += state != 0
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A language and a score each: how far the best is from the second,
        as a share of the second's phrases."""
        model, rows, owner = self.model, [], []
        length = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            s = self.symbols_of(t or "")
            length[i] = len(s)
            for a in range(0, len(s), BLOCK):
                rows.append(s[a:a + BLOCK])
                owner.append(i)
        total = np.zeros((len(texts), max(1, len(model.langs))))
        order = sorted(range(len(rows)), key=lambda r: -len(rows[r]))
        for a in range(0, len(order) if model.langs else 0, LANES):
            part = order[a:a + LANES]
            lanes = np.zeros((len(part), len(rows[part[0]])), np.int32)
            for i, r in enumerate(part):
                lanes[i, :len(rows[r])] = rows[r]
            np.add.at(total, [owner[r] for r in part], self.phrases(lanes, np.array([len(rows[r]) for r in part])))
        langs, scores = [], []
        for n, x in zip(length, total):
            if not n or not model.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            best = int(x.argmin())
            second = np.delete(x, best).min() if len(x) > 1 else x[best]
            langs.append(model.langs[best])
            scores.append(float(1 - x[best] / second) if len(x) > 1 else 1.0)
        return langs, scores


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score per row of docs.  ``und`` with score 0 for
    null texts, texts without a letter, and where nothing was learned; ties
    go to the language first in the alphabet."""
    held = docs.sparkSession.sparkContext.broadcast(model)     # bounded by the training sample

    def fn(batch, parser):
        return [batch.column("doc_id"), *parser.predict(batch.column("text").to_pylist())]

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fn,
                     "doc_id long, lang_pred string, score double", slice_rows=1024,
                     start=lambda: Parser(held.value))
