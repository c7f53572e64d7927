"""Exact substring deduplication by distributed prefix doubling.

A byte goes when a 100-byte string over it also starts earlier.  Comparing
every position of a corpus at every length would move many times the
corpus, so the doubling runs on chosen positions and drops all it can early:

* ranks are names of strings (64-bit, 128 with the context's name).  Inside
  a task, names double from 1 to 32 bytes: the name of 2n bytes is made of
  the names of two n-byte halves;
* anchors: of the 69 32-byte strings inside a 100-byte string, the one of
  smallest name (leftmost on ties).  Equal 100-byte strings have equal
  anchors at equal places, so only anchors (about one byte in 35) are
  shuffled and grouped by rank.  Anchors of unique rank leave;
* anchors of equal rank are ranked again by 168 bytes around them, all that
  a 100-byte string with that anchor can hold.  If the whole group agrees,
  the first stays and the others lose all their strings; nothing more is
  looked at.  So the inside of copies and of passages never goes further;
* what is left, anchors of equal 32 bytes in unlike surroundings, is ranked
  by each of its 100-byte strings, past the threshold.

Inside a batch, repeats of an anchor in equal surroundings are decided at
once and not sent to the group, so a passage in a third of all documents
sends one row a batch.  Groups of very many surroundings go string by string
through an aggregate that combines before its shuffle.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import GOLD, MULT, arrow_map, document_key, mix, signed, stored, with_fields

GRAM = 32
#: Windows of one document looked at in one go, symbols between documents,
#: and symbols of documents joined for one numpy pass.
SEGMENT, GAP, BUFFER = 1 << 20, 256, 1 << 18
#: Rows of one rank that one task compares in memory.
HOT = 20_000


@cache
def _symbols() -> np.ndarray:
    return np.random.default_rng(5).integers(0, 2**64, 257, dtype=np.uint64)


def names(symbols: np.ndarray, length: int) -> np.ndarray:
    """Names of all strings of ``length`` (a power of two) by doubling."""
    h, n = _symbols()[symbols], 1
    while n < length:
        x = h[:-n] * MULT
        x ^= x >> np.uint64(32)
        x += h[n:]
        x *= GOLD
        x ^= x >> np.uint64(29)
        h, n = x, 2 * n
    return h


def running_min(v: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        v, n = np.minimum(v[:-n], v[n:]), 2 * n
    rest = width - n
    return np.minimum(v[:len(v) - rest], v[rest:]) if rest else v


def _segments(texts: list[bytes], length: int):
    """(document, first window, end of windows, bytes from, bytes) lists of a
    bounded total size; long documents are cut with overlap."""
    out, total = [], 0
    for i, t in enumerate(texts):
        for lo in range(0, len(t) - length + 1, SEGMENT):
            hi = min(lo + SEGMENT, len(t) - length + 1)
            a = max(0, lo - GAP)
            out.append((i, lo, hi, a, t[a:hi + length + GAP]))
            total += len(out[-1][4]) + GAP
            if total >= BUFFER:
                yield out
                out, total = [], 0
    if out:
        yield out


def anchors(texts: list[bytes], length: int = 100):
    """document, offset, name, name of the surroundings, first window, end of
    windows: one entry per anchor of each text."""
    width, found = length - GRAM + 1, []
    for segments in _segments(texts, length):
        parts, spans, at = [np.full(GAP, 256, np.uint16)], [], GAP
        for i, lo, hi, a, data in segments:
            spans.append((i, at - a, at - a + lo, at - a + hi))   # document, its byte 0, windows
            parts += [np.frombuffer(data, np.uint8).astype(np.uint16), np.full(GAP, 256, np.uint16)]
            at += len(data) + GAP
        h = names(np.concatenate(parts), GRAM)
        low = np.uint64((1 << 22) - 1)
        best = running_min((h & ~low) | np.arange(len(h), dtype=np.uint64), width) & low
        window = np.concatenate([np.arange(a, b) for _, _, a, b in spans])
        owner = np.repeat(np.arange(len(spans)), [b - a for _, _, a, b in spans])
        pos = best[window].astype(np.int64)
        first = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1]) | (owner[1:] != owner[:-1])])
        end = np.r_[first[1:], len(pos)]
        pos, lo, owner = pos[first], window[first], owner[first]
        hi = lo + (end - first)
        around = mix((pos - lo).astype(np.uint64) * GOLD + (hi - pos).astype(np.uint64) + np.uint64(1))
        back = length - GRAM
        for step in [*range(-back, back, GRAM), back]:
            around = mix(around * GOLD + h[pos + step])
        base = np.array([s[1] for s in spans])[owner]
        found.append((np.array([s[0] for s in spans])[owner], pos - base, h[pos], around, lo - base, hi - base))
    if not found:
        return [np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64)]
    return [np.concatenate(x) for x in zip(*found)]


def _bytes(col) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in col.to_pylist()]


def _order(ids: pa.Array, keys: pa.Array):
    """Sort keys of documents: null ids last, then id, then text key."""
    none = np.array(ids.is_null())
    return none, np.array(ids.fill_null(0)), np.array(keys)


def first_anchors(docs: DataFrame, length: int) -> DataFrame:
    """One row per anchor: rank, part (what it is grouped by), around, place,
    and whether an earlier equal one in its batch has settled it."""

    def fn(batch, _):
        none, ids, keys = _order(batch.column("doc_id"), batch.column("tkey"))
        doc, off, h, around, _, _ = anchors(_bytes(batch.column("text")), length)
        if not len(doc):
            return None
        order = np.lexsort((off, keys[doc], ids[doc], none[doc], around, h))
        doc, off, h, around = doc[order], off[order], h[order], around[order]
        lead = np.r_[True, (h[1:] != h[:-1]) | (around[1:] != around[:-1])]
        head = np.flatnonzero(lead)[np.cumsum(lead) - 1]
        # A repeated row has the place of its first and is no later string.
        settled = ~((ids[doc] == ids[doc[head]]) & (none[doc] == none[doc[head]])
                    & (keys[doc] == keys[doc[head]]) & (off == off[head]))
        spread = mix(mix((ids[doc] ^ keys[doc]).view(np.uint64)) + off.astype(np.uint64))
        at = pa.array(doc)
        return [signed(np.where(settled, spread, h)), signed(around), batch.column("doc_id").take(at),
                batch.column("tkey").take(at), off, settled]

    return arrow_map(docs.select("doc_id", "tkey", "text"), fn,
                     "part long, around long, doc_id long, tkey long, off long, settled boolean")


def settle(found: DataFrame, hot: int) -> DataFrame:
    """doc_id, tkey, off, kind of the anchors that matter: 0 loses all its
    strings, 1 is to be compared string by string, 2 as well, in a group too
    large for one task."""
    group = Window.partitionBy("part")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "tkey", "off")
    return (found.withColumn("lo", F.min("around").over(group)).withColumn("hi", F.max("around").over(group))
            .withColumn("n", F.count("*").over(group))
            .withColumn("place", place)
            .withColumn("first", F.min("place").over(Window.partitionBy("part", "around")))
            .withColumn("kind", F.when(F.col("settled") | (F.col("first") != F.col("place")), 0)
                        .when(F.col("lo") == F.col("hi"), None)
                        .when(F.col("n") > hot, 2).otherwise(1))
            .filter("kind is not null").select("doc_id", "tkey", "off", "kind"))


def spans_of(ranges: np.ndarray, size: int, length: int) -> np.ndarray:
    """Maximal byte runs [from, end) covered by windows starting in the ranges."""
    d = np.zeros(size + 1, np.int32)
    if len(ranges):
        np.add.at(d, ranges[:, 0], 1)
        np.add.at(d, ranges[:, 1] + length - 1, -1)
    inside = np.concatenate([[False], np.cumsum(d[:size]) > 0, [False]])
    return np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)


def without(data: bytes, spans: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in spans.tolist():
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


#: Columns of a settled document.
RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _result(data: bytes, ranges: np.ndarray, length: int, with_text: bool) -> list:
    spans = spans_of(ranges, len(data), length)
    kept = without(data, spans)
    return [len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(),
            kept.decode("utf-8", "ignore").encode() if with_text else None]


def surroundings(docs: DataFrame, kind: int, length: int) -> DataFrame:
    """(part, doc_id, tkey, off, lo, bytes) of the anchors of a kind: the
    bytes of all windows of the anchor."""

    def fn(batch, _):
        texts, wanted = _bytes(batch.column("text")), batch.column("open").to_pylist()
        doc, off, h, _, lo, hi = anchors(texts, length)
        ask = {(i, o["off"]) for i, x in enumerate(wanted) for o in x if o["kind"] == kind}
        keep = [j for j, x in enumerate(zip(doc.tolist(), off.tolist())) if x in ask]
        doc, off, h, lo, hi = doc[keep], off[keep], h[keep], lo[keep], hi[keep]
        at = pa.array(doc, pa.int64())
        return [signed(h), batch.column("doc_id").take(at), batch.column("tkey").take(at), off, lo,
                [texts[d][a:b + length - 1] for d, a, b in zip(doc.tolist(), lo.tolist(), hi.tolist())]]

    return arrow_map(docs.select("doc_id", "tkey", "text", "open"), fn,
                     "part long, doc_id long, tkey long, off long, lo long, bytes binary")


def _windows(blobs: list[bytes], length: int):
    """(row, window, 128-bit name in two columns) of all windows of blobs."""
    sizes = np.array([len(b) for b in blobs])
    data = np.frombuffer(b"".join(blobs), np.uint8)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    count = sizes - length + 1
    row = np.repeat(np.arange(len(blobs)), count)
    within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = start[row] + within
    h = names(data.astype(np.uint16), GRAM)
    a, b = np.zeros(len(at), np.uint64), np.full(len(at), GOLD)
    for step in [*range(0, length - GRAM, GRAM), length - GRAM]:
        a, b = mix(a * GOLD + h[at + step]), mix((b ^ h[at + step]) * MULT)
    return row, within, a, b


WINDOW_ROWS = "a long, b long, doc_id long, tkey long, at long"


def later_in_groups(rows: DataFrame, length: int) -> DataFrame:
    """(doc_id, tkey, at): windows that start earlier elsewhere, compared
    within each rank; a rank's rows are in one task (at most HOT, unless
    settled before)."""
    ready = rows.repartition("part").sortWithinPartitions("part")

    def run(batches):
        hold: list[pa.RecordBatch] = []

        def flush(rows_):
            t = pa.Table.from_batches(rows_).combine_chunks()
            none, ids, keys = _order(t.column("doc_id").combine_chunks(), t.column("tkey").combine_chunks())
            row, within, a, b = _windows(t.column("bytes").to_pylist(), length)
            part = np.array(t.column("part"))[row]
            start = np.array(t.column("lo"))[row] + within
            order = np.lexsort((start, keys[row], ids[row], none[row], b, a, part))
            p, x, y = part[order], a[order], b[order]
            lead = np.r_[True, (p[1:] != p[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
            head = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
            same = ((ids[row[order]] == ids[row[head]]) & (none[row[order]] == none[row[head]])
                    & (keys[row[order]] == keys[row[head]]) & (start[order] == start[head]))
            late = order[~same]
            at = pa.array(row[late])
            return pa.RecordBatch.from_arrays(
                [t.column(c).combine_chunks().take(at) for c in ("doc_id", "tkey")] + [pa.array(start[late])],
                names=["doc_id", "tkey", "at"])

        size = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                b = batch.slice(lo, 2000)
                parts = np.array(b.column("part"))
                if hold and size >= 4000:
                    # Finish the ranks that ended before this slice's last one.
                    cut = int(np.searchsorted(parts != hold[-1].column("part")[-1].as_py(), True))
                    if cut < len(parts):
                        yield flush([*hold, b.slice(0, cut)] if cut else hold)
                        hold, size, b = [], 0, b.slice(cut)
                hold.append(b)
                size += b.num_rows
        if hold:
            yield flush(hold)

    return ready.mapInArrow(run, "doc_id long, tkey long, at long")


def later_by_window(rows: DataFrame, length: int) -> DataFrame:
    """The same, window by window, for ranks of very many rows."""

    def fn(batch, _):
        row, within, a, b = _windows(batch.column("bytes").to_pylist(), length)
        at = pa.array(row)
        return [signed(a), signed(b), batch.column("doc_id").take(at), batch.column("tkey").take(at),
                np.array(batch.column("lo"))[row] + within]

    each = (arrow_map(rows, fn, WINDOW_ROWS)
            .withColumn("place", F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "tkey", "at")))
    # Stored, so that the join can split a string that very many rows share.
    first = stored(each.groupBy("a", "b").agg(F.min("place").alias("first"), F.max("place").alias("last"))
                   .filter("first <> last").drop("last"), "first")
    return each.join(first, ["a", "b"]).filter("place <> first").select("doc_id", "tkey", "at")


def deduplicate(docs: DataFrame, length: int = 100, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes, if
    ``with_text``, as whole characters, with ``was_null`` and ``row``, a struct
    of any other columns) per row of docs, beside doc_id and tkey.

    Earlier means a smaller doc_id (null ids last; rows of one id by a hash
    of their text), or an earlier start in the same document.  Rows equal in
    id and text count as one document and get equal results.  Null and empty
    texts have no bytes; texts shorter than ``length`` lose nothing.  Texts
    of any length are cut into overlapping segments."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), document_key(docs).alias("tkey"), "text",
                      *([F.col("text").isNull().alias("was_null"), F.struct(
                          F.lit(0).alias(""), *[F.col(f"`{c}`") for c in others]).alias("row")] if with_text else []))
    carried = [c for c in src.columns if c != "text"]
    marks = (settle(first_anchors(src, length), hot).groupBy("doc_id", "tkey")
             .agg(F.collect_list(F.struct("off", "kind")).alias("marks"))
             .withColumnsRenamed({"doc_id": "m_id", "tkey": "m_key"}))
    joined = (src.join(marks, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("tkey") == F.col("m_key")), "left")
              .drop("m_id", "m_key"))

    def fn(batch, _):
        texts, marks_ = _bytes(batch.column("text")), batch.column("marks").to_pylist()
        some = [i for i, m in enumerate(marks_) if m]
        doc, off, _, _, lo, hi = anchors([texts[i] for i in some], length)
        cut = np.searchsorted(doc, np.arange(len(some) + 1))
        out = [[], [], [], [], [], [], [], []]
        for i, m in enumerate(marks_):
            own = slice(0, 0)
            if m:
                own = slice(*cut[np.searchsorted(some, i) + np.array([0, 1])])
            gone = {x["off"] for x in m or () if x["kind"] == 0}
            open_ = [x for x in m or () if x["kind"]]
            keep = np.array([o in gone for o in off[own].tolist()], bool)
            ranges = np.stack([lo[own], hi[own]], axis=1)[keep]
            done = [None] * 5 if open_ else _result(texts[i], ranges, length, with_text)
            for c, v in zip(out, [*done, texts[i].decode("utf-8", "surrogatepass") if open_ else None,
                                  open_ or None, ranges.ravel().tolist() if open_ else None]):
                c.append(v)
        return [batch.column(c) for c in carried] + out

    schema = with_fields(src.select(*carried).schema, RESULT
                         + ", text string, open array<struct<off:long,kind:int>>, ranges array<long>")
    settled = stored(arrow_map(joined, fn, schema, slice_rows=256), "settled")
    todo = settled.filter("open is not null")
    late = later_in_groups(surroundings(todo, 1, length), length)
    if not settled.filter(F.exists("open", lambda x: x["kind"] == 2)).isEmpty():
        late = late.unionByName(later_by_window(surroundings(todo, 2, length), length))
    late = (late.groupBy("doc_id", "tkey").agg(F.collect_set("at").alias("late"))
            .withColumnsRenamed({"doc_id": "m_id", "tkey": "m_key"}))
    names_ = [c.split()[0] for c in RESULT.split(", ")]
    last = (todo.select(*carried, "text", "ranges")
            .join(late, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("tkey") == F.col("m_key")), "left"))

    def finish(batch, _):
        rows = []
        for t, r, w in zip(_bytes(batch.column("text")), batch.column("ranges").to_pylist(),
                           batch.column("late").to_pylist()):
            starts = np.sort(np.array(w or [], np.int64))
            edge = np.flatnonzero(np.diff(starts, prepend=-9) != 1)
            runs = np.stack([starts[edge], starts[np.r_[edge[1:], len(starts)] - 1] + 1], axis=1) if len(starts) \
                else np.empty((0, 2), np.int64)
            rows.append(_result(t, np.concatenate([np.array(r, np.int64).reshape(-1, 2), runs]), length, with_text))
        return [batch.column(c) for c in carried] + [list(c) for c in zip(*rows)]

    schema = with_fields(src.select(*carried).schema, RESULT)
    return (settled.filter("open is null").select(*carried, *names_)
            .unionByName(arrow_map(last, finish, schema, slice_rows=256)))

