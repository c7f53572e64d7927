"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared 5-word seeds.  For each
pair with a seed, runs of consecutive seeds are the maximal matches; the
longest unmarked one is marked in both texts again and again (each word is
used once) until none of five words is left.  Marked words over the item's
words is its coverage, so a passage in another order counts in full.

A benchmark is small beside a corpus.  Its index goes to the tasks only if
its seeds are at most ``most_seeds``, which makes the join a filter while
scanning; beyond that the same join runs as a shuffle on the seeds.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WordHashes, arrow_map, shingle_hashes, signed, stored, text_key, with_fields

LEAST, COVERAGE, MOST_SEEDS = 5, 0.6, 1_000_000
#: Bytes that are no part of a word; A-Z becomes a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
MATCH = "struct<item_id:long,item_words:int,covered:int,tiles:int,coverage:double>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def seeds_of(words: list[bytes], cache: WordHashes, least: int) -> np.ndarray:
    return shingle_hashes(cache.of(words), least)


def runs(hits: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(words over the seed, item position, text position) of the maximal
    runs of seed hits on one diagonal."""
    out, open_ = [], {}
    for at, i in sorted((p, i) for i, p in hits):
        d = at - i
        if d in open_ and open_[d][1] + open_[d][0] == i:
            open_[d][0] += 1
        else:
            if d in open_:
                out.append(tuple(open_[d]))
            open_[d] = [1, i, at]
    return out + [tuple(x) for x in open_.values()]


def tile(hits: list[tuple[int, int]], item: list[bytes], words: list[bytes], least: int) -> tuple[int, int]:
    """(words of the item covered, tiles)."""
    n = min(least, len(item))
    free_i, free_t = bytearray(b"\1") * len(item), bytearray(b"\1") * len(words)
    heap = [(-(r + n - 1), i, p) for r, i, p in runs(hits)
            if item[i:i + r + n - 1] == words[p:p + r + n - 1]]
    heapq.heapify(heap)
    covered = tiles = 0
    while heap:
        size, i, p = heapq.heappop(heap)
        size = -size
        best, at = [], 0
        while at < size:      # the parts that no longer tile has taken
            if free_i[i + at] and free_t[p + at]:
                end = at
                while end < size and free_i[i + end] and free_t[p + end]:
                    end += 1
                best.append((at, end))
                at = end
            at += 1
        if best == [(0, size)]:
            free_i[i:i + size] = free_t[p:p + size] = bytes(size)
            covered, tiles = covered + size, tiles + 1
        else:
            for a, b in best:
                if b - a >= n:
                    heapq.heappush(heap, (a - b, i + a, p + a))
    return covered, tiles


def pair(words: list[bytes], seeds: np.ndarray, item_id, item: list[bytes], index: dict, least: int):
    """The match of a text with an item, whose seeds ``index`` maps to positions."""
    # A short item has one seed of its own length, which ``seeds`` lacks.
    if len(item) < least:
        hits = [(0, p) for p in range(len(words) - len(item) + 1) if words[p:p + len(item)] == item]
    else:
        at = np.flatnonzero(np.isin(seeds, np.fromiter(index, np.uint64, len(index))))
        hits = [(i, int(p)) for p in at for i in index[int(seeds[p])]]
    covered, tiles = tile(hits, item, words, least)
    return (item_id, len(item), covered, tiles, covered / len(item))


def _index(seeds: np.ndarray) -> dict:
    out = defaultdict(list)
    for i, s in enumerate(seeds.tolist()):
        out[s].append(i)
    return dict(out)


def _start(items: list[tuple]):
    """Seed -> items, and the short items by their words, for one task."""
    cache = WordHashes()
    by_seed, parts = defaultdict(list), []
    for n, (item_id, text) in enumerate(items):
        words = words_of(text)
        seeds = seeds_of(words, cache, LEAST)
        parts.append((item_id, words, _index(seeds) if len(words) >= LEAST else {}))
        for s in set(seeds.tolist()) if len(words) >= LEAST else ():
            by_seed[s].append(n)
    known = np.sort(np.fromiter(by_seed, np.uint64, len(by_seed)))
    return {"cache": cache, "parts": parts, "by_seed": by_seed, "known": known,
            "short": [n for n, p in enumerate(parts) if 0 < len(p[1]) < LEAST]}


def _member(seeds: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(seeds):
        return np.zeros(len(seeds), bool)
    return known[np.minimum(np.searchsorted(known, seeds), len(known) - 1)] == seeds


def _scan(docs: DataFrame, items: list[tuple], coverage: float) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(items)
    columns = docs.columns

    def fn(batch, s):
        found = []
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            seeds = seeds_of(words, s["cache"], LEAST) if len(words) >= LEAST else np.empty(0, np.uint64)
            hit = {n for x in seeds[_member(seeds, s["known"])].tolist() for n in s["by_seed"][x]}
            rows = [pair(words, seeds, *s["parts"][n], LEAST) for n in sorted(hit | set(s["short"]))]
            found.append([dict(zip(("item_id", "item_words", "covered", "tiles", "coverage"), r))
                          for r in rows if r[4] >= coverage])
        return [batch.column(c) for c in columns] + [found]

    return arrow_map(docs, fn, with_fields(docs.schema, f"matches array<{MATCH}>"), slice_rows=256,
                     start=lambda: _start(held.value))


def _joined(docs: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    """The same by shuffles: seeds joined with seeds, then text with text."""
    def seeds(batch, cache):
        at, out = [], []
        for n, t in enumerate(batch.column("text").to_pylist()):
            words = words_of(t)
            # Items and texts shorter than a seed meet on their words' own runs.
            h = {int(x) for k in range(1, LEAST + 1) if k <= len(words)
                 for x in seeds_of(words, cache, k)} if "short" in batch.schema.names and batch.column("short")[n].as_py() \
                else set(seeds_of(words, cache, LEAST).tolist())
            at += [n] * len(h)
            out += h
        at = pa.array(at, pa.int64())
        return [batch.column(0).take(at), signed(np.array(out, np.uint64))]

    items = stored(items.withColumn("n", F.monotonically_increasing_id()), "items")
    item_seeds = arrow_map(items.select("n", "text"), seeds, "n long, seed long", start=WordHashes)
    short = not items.filter(F.size(F.split(F.trim("text"), r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+")) < LEAST + 2).isEmpty()
    texts = stored(docs.select("doc_id", text_key().alias("tkey"), "text").dropDuplicates(["doc_id", "tkey"])
                   .withColumn("d", F.monotonically_increasing_id()), "texts")
    doc_seeds = arrow_map(texts.select("d", "text", F.lit(short).alias("short")), seeds,
                          "d long, seed long", start=WordHashes)
    pairs = doc_seeds.join(item_seeds, "seed").select("d", "n").distinct()
    both = (pairs.join(texts, "d").join(items.select("n", "item_id", F.col("text").alias("item")), "n")
            .select("doc_id", "tkey", "text", "item_id", "item"))

    def fn(batch, cache):
        rows = []
        for text, item_id, item in zip(*(batch.column(c).to_pylist() for c in ("text", "item_id", "item"))):
            words, item = words_of(text), words_of(item)
            index = _index(seeds_of(item, cache, LEAST)) if len(item) >= LEAST else {}
            own = seeds_of(words, cache, LEAST) if len(words) >= LEAST else np.empty(0, np.uint64)
            rows.append(dict(zip(("item_id", "item_words", "covered", "tiles", "coverage"),
                                 pair(words, own, item_id, item, index, LEAST))))
        return [batch.column("doc_id"), batch.column("tkey"), rows]

    found = (arrow_map(both, fn, f"m_id long, m_key long, match {MATCH}", slice_rows=256, start=WordHashes)
             .filter(F.col("match.coverage") >= coverage)
             .groupBy("m_id", "m_key").agg(F.sort_array(F.collect_list("match")).alias("matches")))
    return (docs.join(found, F.col("doc_id").eqNullSafe(F.col("m_id")) & (text_key() == F.col("m_key")), "left")
            .select(*docs.columns, F.coalesce("matches", F.array().cast(f"array<{MATCH}>")).alias("matches")))


def tiled(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE,
          most_seeds: int = MOST_SEEDS) -> DataFrame:
    """docs with ``matches``: the items of which at least ``coverage`` of the
    words is tiled by the text.  Null, empty and wordless texts and items
    match nothing; an item of fewer than five words needs all of them in a
    row; repeated items count once.  A column ``matches`` of docs is replaced."""
    docs = docs.drop("matches")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()
    # Words are at most every second byte, so this bounds the seeds from above.
    size = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    if size > most_seeds:
        return _joined(docs, items, coverage)
    rows = sorted(((r.item_id, r.text) for r in items.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return _scan(docs, [r for r in rows if words_of(r[1])], coverage)
