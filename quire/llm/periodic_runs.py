"""Periodic runs of words: every maximal stretch that repeats itself with a
smallest period q over at least max(12, 2q) words.

Periods are dealt with by octave: [1, 8), [8, 16), [16, 32), ...  For the
octave from g on (the first: 4) a document is laid out in overlapping tiles
around every g-th word, each reaching 2g words back and 4g on (the first: 12
and 20).  A run of a period p of the octave has at least g consecutive places
i with word i = word i + p, so a tile's middle b falls among them, and in the
tile two Z-functions at that boundary say for all p at once how far the
equality goes on from b (against b + p) and back from it: a fragment of the
run.  Tiles know nothing of each other, and fragments reach at most the
tile's ends; fragments are shuffled by document and period, and those that
touch are stitched together.

* A tile is laid out only if hashes of g/2 words beside b and b + p agree for
  some p of its octave, which a run needs on one side at least; the hashes
  only spare work, words are compared by the Z-functions.
* A period that is a multiple of a smaller one is seen in the tile: the p
  words from b on are then a power, which the forward Z-function shows.
* Work and rows grow with n log n for n words, whatever the text; only
  documents that have tiles send their words to the shuffle.

Words are what stands between the characters x20 and x09 to x0D.  Null and
empty texts have no words and no runs.  Texts are read whole.  Ties between
runs are ordered by start, then period.  Repeated ids and rows keep one
result row each; a null id is an id; an empty table gives an empty table;
other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import GOLD, arrow_map, document_key, mix, stored

#: Least number of words in a run, whatever its period.
LEAST = 12
#: The first octave: periods below FIRST, tiles every FIRST / 2 words.
FIRST = 8
#: Rows to a batch; comparisons made at once.
SLICE, BLOCK = 256, 1 << 18


def need(p: int) -> int:
    """Least number of places i with word i = word i + p in a run of period p."""
    return max(LEAST, 2 * p) - p


# ------------------------------------------------------------------ tiles

class _Codes(dict):
    """word -> number, in order of appearance."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def octaves(most: int):
    """(first period, end of periods, tile distance, reach) up to a period
    ``most``.  The reach is what a run needs on one side of the middle."""
    low, high, step = 1, FIRST, FIRST // 2
    while low <= most:
        yield low, high, step, max(high, LEAST)
        low, high, step = high, 2 * high, high


def tiles_of(codes: np.ndarray, bounds: np.ndarray):
    """Tiles that may hold a fragment, of the documents
    codes[bounds[i]:bounds[i + 1]]: (document, first period, middle, its
    periods), the middle counted from the document's start."""
    sizes = np.diff(bounds)
    h = mix(codes.astype(np.uint64) * GOLD)
    size = 1

    def longer(h, a, b):  # hashes of the words of a window and of those b behind
        out = np.zeros_like(h)
        if len(h) > b:
            out[:len(h) - b] = mix(h[:len(h) - b] * GOLD + a[b:])
        return out

    two = longer(h, h, 1)
    for low, high, step, _ in octaves(int(sizes.max(initial=0)) // 2):
        half = (step + 1) // 2
        if low == 1:
            half, h = 3, longer(two, h, 2)
            four = longer(two, two, 2)
        else:
            if size == 1:
                size, h = 4, four
            while size < half:
                h, size = longer(h, h, size), size * 2
        docs = np.flatnonzero(sizes >= max(LEAST, 2 * low))
        count = (sizes[docs] - low) // step + 1
        whose = np.repeat(docs, count)
        places = (np.arange(len(whose)) - np.repeat(np.cumsum(count) - count, count)) * step
        short = (h >> np.uint64(32)).astype(np.uint32)
        periods, most = np.arange(low, high), max(1, BLOCK // (high - low))
        for at in range(0, len(whose), most):
            doc, b = whose[at:at + most], places[at:at + most]
            here = bounds[doc] + b
            far, end = here[:, None] + periods, bounds[doc + 1][:, None]
            ahead = (far + half <= end) & (short[here][:, None] == short[np.minimum(far, len(h) - 1)])
            behind = ((b >= half)[:, None] & (far <= end) & (short[np.maximum(here - half, 0)][:, None]
                                                             == short[np.clip(far - half, 0, len(h) - 1)]))
            hit = (ahead | behind) & (periods <= (sizes[doc] // 2)[:, None])
            for i in np.flatnonzero(hit.any(axis=1)).tolist():
                yield int(doc[i]), low, int(b[i]), periods[hit[i]]


def tiles(docs: DataFrame) -> DataFrame:
    """One row for each document (low = 0: its number of words, the SHA-256 of
    its words joined by a space, and, if it has tiles, its words), and one for
    each tile (low: first period; the middle ``at``; ``lead`` words before it;
    the periods to look at; the tile's words as numbers)."""
    def fn(batch, _):
        out = {k: [] for k in ("row", "n", "sha", "packed", "low", "at", "lead", "periods", "words")}

        def put(row, n=None, sha=None, packed=None, low=0, at=None, lead=None, periods=None, words=None):
            for k, v in zip(out, (row, n, sha, packed, low, at, lead, periods, words)):
                out[k].append(v)

        import zstandard
        pack = zstandard.ZstdCompressor(level=3).compress
        words = [(v or b"").split() for v in batch.column(2).cast(pa.binary()).to_pylist()]
        number = _Codes()
        codes = np.fromiter((number[w] for ws in words for w in ws), np.int32)
        bounds = np.concatenate([[0], np.cumsum([len(ws) for ws in words])]).astype(np.int64)
        ends = {low: (high, reach) for low, high, _, reach in octaves(len(codes))}
        tiled = set()
        for doc, low, at, periods in tiles_of(codes, bounds):
            tiled.add(doc)
            high, reach = ends[low]
            a, n = int(bounds[doc]), len(words[doc])
            lead = min(at, reach)
            put(doc, low=low, at=at, lead=lead, periods=periods.astype("<i4").tobytes(),
                words=codes[a + at - lead:a + min(n, at + reach + high)].astype("<i4").tobytes())
        for doc, ws in enumerate(words):
            joined = b" ".join(ws)
            put(doc, len(ws), hashlib.sha256(joined).hexdigest(), pack(joined) if doc in tiled else None)
        rows = pa.array(out.pop("row"), pa.int32())
        return [batch.column(0).take(rows), batch.column(1).take(rows), *out.values()]

    return arrow_map(docs.select("doc_id", "ident", "text"), fn,
                     f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ident string, n long, sha string, "
                     "packed binary, low int, at int, lead int, periods binary, words binary", SLICE)


# ------------------------------------------------------------------ fragments

def z_function(s: np.ndarray) -> list[int]:
    """For each place how long the text from there on agrees with its start.
    Places that differ from the first at once are passed over together."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
        same = (np.flatnonzero(s[1:] == s[0]) + 1).tolist()
        s = s.tolist()
    else:
        same = []
    left = right = 0
    for i in same:
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


@lru_cache(maxsize=1 << 16)
def _parts(p: int) -> tuple[int, ...]:
    """p divided by each of its prime factors."""
    out, rest, f = [], p, 2
    while f * f <= rest:
        if rest % f == 0:
            out.append(p // f)
            while rest % f == 0:
                rest //= f
        f += 1
    return (*out, p // rest) if rest > 1 else tuple(out)


def solve(words: np.ndarray, lead: int, at: int, periods: np.ndarray) -> list[tuple[int, int, int]]:
    """(period, start, end) of the fragments across the tile's middle."""
    ahead = z_function(words[lead:])
    far = [p for p in periods.tolist() if lead + p <= len(words)]
    if not far:
        return []
    reach = lead + max(far)
    back = z_function(np.concatenate([words[:lead][::-1], [-1], words[:reach][::-1]])) if lead else []
    out = []
    for p in far:
        on = ahead[p] if p < len(ahead) else 0
        before = back[1 + reach - p] if lead else 0
        if on + before >= need(p) and not any(ahead[q] >= p - q for q in _parts(p) if q < p):
            out.append((p, at - before, at + p + on))
    return out


def stitched(parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Fragments of one document with those that touch made one."""
    out = []
    for p, a, b in sorted(parts):
        if out and out[-1][0] == p and a <= out[-1][2] - p:
            out[-1] = (p, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((p, a, b))
    return out


def fragments(tiled: DataFrame) -> DataFrame:
    """Rows of documents as they are (period = 0), and of tiles the fragments
    (period, start, stop), stitched as far as they meet in one batch."""
    def fn(batch, _):
        low = batch.column(5).to_numpy()
        docs = np.flatnonzero(low == 0)
        at_tile = np.flatnonzero(low)
        cols = [batch.column(i).take(pa.array(at_tile)).to_pylist() for i in (1, 6, 7, 8, 9)]
        found: dict = {}
        for row, ident, at, lead, periods, words in zip(at_tile.tolist(), *cols):
            got = solve(np.frombuffer(words, "<i4"), lead, at, np.frombuffer(periods, "<i4"))
            found.setdefault(ident, (row, []))[1].extend(got)
        rows, runs = docs.tolist(), [(0, None, None)] * len(docs)
        for row, parts in found.values():
            merged = stitched(parts)
            rows += [row] * len(merged)
            runs += merged
        take = pa.array(rows, pa.int64())
        return [*(batch.column(i).take(take) for i in range(5)),
                *([r[i] for r in runs] for i in range(3))]

    return arrow_map(tiled, fn, f"doc_id {tiled.schema['doc_id'].dataType.simpleString()}, ident string, n long, "
                     "sha string, packed binary, period int, start int, stop int")


def stitch(parts: DataFrame) -> DataFrame:
    """(ident, start, length, period): fragments of one document and period
    that touch, made one."""
    w = Window.partitionBy("ident", "period").orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start") > before - F.col("period"), F.lit(True)).cast("int")
    return (parts.withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(w))
            .groupBy("ident", "period", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
            .select("ident", F.col("start").cast("long").alias("start"),
                    (F.col("stop") - F.col("start")).cast("long").alias("length"),
                    F.col("period").cast("long").alias("period")))


# ------------------------------------------------------------------ operators

def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h = crc32 of the id and g = h / 10, a document
    whose h ends in 0 repeats itself from word a = g % n on, every
    1 + (n - a) / (3 + g % 8) words; a null id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))

    def fn(batch, _):
        out = []
        for h, text in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
            words = (text or b"").split() if h is not None and h % 10 == 0 else []
            if words:
                g, n = h // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                block = words[a:a + p]
                text = b" ".join(words[:a] + (block * ((n - a) // p + 1))[:n - a])
            out.append(text)
        return [batch.column(0), pa.array(out, pa.binary()).cast(pa.string())]

    return arrow_map(docs.select("doc_id", h.alias("h"), "text"), fn,
                     f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string", SLICE)


def runs_and_collapsed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed, collapsed_sha256): all runs (start,
    length, period) by start and period; the words that no run drops, joined
    by a space (null where none is dropped: the text's own words), and their
    hash.  A run drops what follows its first ``period`` words."""
    ident = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), document_key(docs))
    parts = stored(fragments(tiles(docs.select("doc_id", ident.alias("ident"), "text"))), "run-fragments")
    runs = (stitch(parts.filter("period > 0")).groupBy("ident")
            .agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs")))
    joined = (parts.filter("period = 0").join(runs, "ident", "left")
              .select("doc_id", "n", "sha", "packed", F.coalesce(
                  "runs", F.array().cast("array<struct<start:long,length:long,period:long>>")).alias("runs")))

    def fn(batch, _):
        import zstandard
        unpack = zstandard.ZstdDecompressor().decompress
        text, sha = [], []
        for h, packed, runs in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            kept = None
            if runs:
                words = unpack(packed).split(b" ")
                edge = np.zeros(len(words) + 1, np.int64)
                for r in runs:
                    edge[r["start"] + r["period"]] += 1
                    edge[r["start"] + r["length"]] -= 1
                kept = b" ".join(w for w, d in zip(words, np.cumsum(edge).tolist()) if not d)
                h = hashlib.sha256(kept).hexdigest()
            text.append(kept), sha.append(h)
        return [batch.column(0), batch.column(1), batch.column(4), pa.array(text, pa.binary()).cast(pa.string()), sha]

    return arrow_map(joined, fn, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, n_words long, "
                     "runs array<struct<start:long,length:long,period:long>>, collapsed string, "
                     "collapsed_sha256 string", SLICE)


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the longest (ties: first start, then period), hashes."""
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("by"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(
        ",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
                    (-F.col("best.by")).alias("length"), F.col("best.period").alias("period"),
                    F.expr("-best.by * 1000 div best.period").alias("exponent_milli"),
                    F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256"))
