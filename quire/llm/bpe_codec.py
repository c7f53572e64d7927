"""Byte-pair encoding of whole texts with content-defined chunk reuse, and
decoding.

1. Every text is cut where a rolling hash of the 32 bytes before a place says
   so, so equal passages are cut alike wherever they stand.  Only the chunks'
   128-bit hashes, not their texts, are shuffled to find the chunks that
   stand in several places, and each such chunk gets one owner.
2. The owner's task encodes the chunk, once; the ids go to the documents that
   hold it.  What no other document shares is encoded in place.
3. A chunk's ids may be wrong beside its ends, where a word was cut.  Each
   join is repaired: the text from a word end before it to a word end behind
   it is encoded anew, with a word more on either side, and taken only if the
   ids of those words agree with both chunks'; else the window grows, at last
   to the whole text.  Where a non-space character meets a space no token
   reaches across and none depends on what is beyond, so agreement there is
   exact.
4. The bytes of the ids are compared with the text (a guard against equal
   hashes of unlike chunks); a text that differs is encoded whole.

A copied passage is so encoded once, whatever the number of its copies; ids
are those of encoding each whole text by itself.

Null text counts as empty (no ids).  Texts of any length are encoded whole.
Repeated ids and rows keep one result row each; a null id is an id.  An empty
table gives an empty table.  Other columns, whatever their names, are left
out.  The special token's own text in a document becomes the special id, as
the tokenizers library has it.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, document_key, stored

TOKENIZER = "byte_bpe_50k.json"
#: Bytes that decide about a cut; least chunk; one place in SPREAD is a cut.
WINDOW, LEAST, SPREAD = 32, 256, 1024
#: Slices are small, so that the hash arrays stay in cache.
SLICE = 256


# ------------------------------------------------------------------ vocabulary

class Codec:
    """The vocabulary of a byte-level tokenizer file: ids of texts, bytes of ids."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, token)): i
                 for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens=special)
        self.bytes = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for token, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            self.bytes[i] = token
        self.sizes = np.fromiter(map(len, self.bytes), np.int64)

    def encode(self, data: bytes) -> np.ndarray:
        return np.array(self.encoding.encode(data.decode(), allowed_special="all"), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


_codecs: dict[str, Codec] = {}


def codec(name: str) -> Codec:
    """The vocabulary, read in the task and kept by its worker."""
    if name not in _codecs:
        _codecs[name] = Codec(name)
    return _codecs[name]


# ------------------------------------------------------------------ chunks

def _rolling(data: np.ndarray) -> np.ndarray:
    """A polynomial hash of the WINDOW bytes from each place on, by doubling."""
    h = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    size, base = 1, 0x85EBCA6B
    while size < WINDOW:
        h = h[:-size] * np.uint32(base) + h[size:] if len(h) > size else h[:0]
        size, base = size * 2, base * base & 0xFFFFFFFF
    return h


def cuts(data: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Where the texts data[bounds[i]:bounds[i + 1]] are cut: for each the
    places, its start and end included (an empty text: none)."""
    h = _rolling(data)
    h ^= h >> np.uint32(16)
    at = np.flatnonzero(h * np.uint32(0xC2B2AE35) < np.uint32(0x100000000 // SPREAD)) + WINDOW
    # A cut stands before a character, not inside one.
    inside = np.flatnonzero(at < len(data))
    at = at[inside]
    while len(at) and (bad := (data[at] & 0xC0) == 0x80).any():
        at = at + bad
        at = at[at < len(data)]
    first = np.searchsorted(at, bounds)
    out = []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if a == b:
            out.append([])
            continue
        found = [a]
        for c in at[first[i]:first[i + 1]].tolist():
            if c - found[-1] >= LEAST and c < b:
                found.append(c)
        out.append([*found, b])
    return out


def _buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column (null: empty) and the bounds of its rows."""
    rows = [b"" if v is None else v for v in col.cast(pa.binary()).to_pylist()]
    return (np.frombuffer(b"".join(rows), np.uint8),
            np.concatenate([[0], np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))]).astype(np.int64))


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(ident, start, size, h1, h2): the chunks of (ident, text)."""
    def fn(batch, _):
        import xxhash
        data, bounds = _buffers(batch.column(1))
        raw = data.tobytes()
        ident, start, size, h = [], [], [], []
        for name, a, places in zip(batch.column(0).to_pylist(), bounds.tolist(), cuts(data, bounds)):
            for x, y in zip(places, places[1:]):
                ident.append(name), start.append(x - a), size.append(y - x)
                h.append(xxhash.xxh3_128_digest(raw[x:y]))
        h = np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)
        return [pa.array(ident, pa.string()), start, size, h[:, 0], h[:, 1]]

    return arrow_map(docs.select("ident", "text"), fn, "ident string, start int, size int, h1 long, h2 long", SLICE)


# ------------------------------------------------------------------ joins of chunks

def word_ends(data: np.ndarray) -> np.ndarray:
    """Places where a character that is surely no space meets a space."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    solid = (data > 32) & (data < 127)
    two = np.zeros(len(data), bool)  # the last byte of a two-byte letter
    two[1:] = ((data[1:] & 0xC0) == 0x80) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    return np.flatnonzero((solid | two)[:-1] & space[1:]) + 1


def repair(raw: bytes, joins: list[int], ids: np.ndarray, ends: np.ndarray, encode) -> np.ndarray:
    """ids of the whole text, from ids whose tokens end at the byte places
    ``ends`` and that may be wrong beside the ``joins``."""
    size = len(raw)
    stops = word_ends(np.frombuffer(raw, np.uint8))
    starts = np.concatenate([[0], ends])

    def token_at(place: int) -> int:
        i = int(np.searchsorted(starts, place))
        return i if i < len(starts) and starts[i] == place else -1

    done: list[tuple[int, int, np.ndarray]] = []  # replaced: from, to, new ids
    k = 0
    while k < len(joins):
        margin = 1
        while True:
            # To the left: the last word end before the join, and ``margin``
            # more words, all behind what an earlier join replaced.
            n, low = k, done[-1][1] if done else 0
            before = joins[k - 1] if k else 0
            at = int(np.searchsorted(stops, joins[k], "right")) - margin
            p_in, p_out = (int(stops[at]), int(stops[at - margin])) if at >= margin else (0, 0)
            if p_out < max(low, before):
                p_in = p_out = 0
                if done:
                    p_in = p_out = done[-1][0]
            # To the right: the same, between this join and the next; a next
            # join that stands too near is taken into the window.
            while True:
                at = int(np.searchsorted(stops, joins[n])) + margin - 1
                q_in, q_out = ((int(stops[at]), int(stops[at + margin])) if at + margin < len(stops)
                               else (size, size))
                if n + 1 < len(joins) and q_out > joins[n + 1]:
                    n += 1
                    continue
                break
            new = encode(raw[p_out:q_out])
            old = [token_at(p) for p in (p_out, p_in, q_in, q_out)]
            left, right = old[1] - old[0], old[3] - old[2]
            if (min(old) >= 0 and left + right <= len(new) and np.array_equal(new[:left], ids[old[0]:old[1]])
                    and np.array_equal(new[len(new) - right:], ids[old[2]:old[3]])):
                break
            if p_out == 0 and q_out == size:
                return new
            margin *= 2
        if done and p_in == done[-1][0]:
            done.pop()
        done.append((p_in, q_in, new[left:len(new) - right]))
        k = n + 1
    parts, at = [], 0
    for p, q, new in done:
        parts += [ids[at:token_at(p)], new]
        at = token_at(q)
    return np.concatenate([*parts, ids[at:]])


def assemble(raw: bytes, known: list[tuple[int, int, bytes]], c: Codec) -> np.ndarray:
    """ids of a text, of which the chunks ``known`` (start, size, their ids as
    16-bit integers, in order) are encoded already."""
    if not known:
        return c.encode(raw)
    parts, joins, at = [], [], 0
    for start, size, packed in known:
        if start > at:
            parts.append(c.encode(raw[at:start]))
            joins.append(start)
        parts.append(np.frombuffer(packed, "<u2").astype(np.uint32))
        at = start + size
        joins.append(at)
    if at < len(raw):
        parts.append(c.encode(raw[at:]))
    joins = [j for j in joins if 0 < j < len(raw)]
    ids = np.concatenate(parts)
    ends = np.cumsum(c.sizes[ids])
    if len(ends) and ends[-1] == len(raw):
        ids = repair(raw, joins, ids, ends, c.encode)
        if c.decode(ids) == raw:
            return ids
    return c.encode(raw)


# ------------------------------------------------------------------ operators

def encode(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids): the ids of every whole text as little-endian unsigned
    32-bit integers."""
    ident = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), document_key(docs))
    named = docs.select("doc_id", ident.alias("ident"), "text")
    chunks = stored(chunk_rows(named), "bpe-chunks")
    # Chunks of several places, each with the place that encodes it.
    shared = stored(chunks.groupBy("h1", "h2", "size")
                    .agg(F.count("*").alias("n"), F.min(F.struct("ident", "start")).alias("owner"))
                    .filter("n > 1").select("h1", "h2", "size", "owner"), "bpe-shared")
    # Texts move once, compressed: both joins below read one exchange, so
    # both ask for the same columns under the same filter.
    id_type = named.schema["doc_id"].dataType.simpleString()
    packed = arrow_map(named, lambda b, _: [b.column(0), b.column(1), _packed(b.column(2))],
                       f"doc_id {id_type}, ident string, raw binary", SLICE).filter("ident is not null")
    owners = (shared.groupBy(F.col("owner.ident").alias("ident"))
              .agg(F.sort_array(F.collect_list(F.struct("owner.start", "size", "h1", "h2"))).alias("own")))
    name = tokenizer

    def own(batch, c):
        h1, h2, size, ids = [], [], [], []
        for raw, spans in zip(_unpacked(batch.column(1)), batch.column(2).to_pylist()):
            for s in spans:
                found = c.encode(raw[s["start"]:s["start"] + s["size"]])
                h1.append(s["h1"]), h2.append(s["h2"]), size.append(s["size"])
                ids.append(found.astype("<u2").tobytes())
        return [h1, h2, size, pa.array(ids, pa.binary())]

    found = arrow_map(packed.join(owners, "ident").select("doc_id", "raw", "own"), own,
                      "h1 long, h2 long, size int, ids binary", SLICE, lambda: codec(name))
    held = (chunks.join(found, ["h1", "h2", "size"]).groupBy("ident")
            .agg(F.sort_array(F.collect_list(F.struct("start", "size", "ids"))).alias("known")))

    def whole(batch, c):
        out = []
        for raw, known in zip(_unpacked(batch.column(1)), batch.column(2).to_pylist()):
            out.append(assemble(raw, [(k["start"], k["size"], k["ids"]) for k in known or []], c)
                       .astype("<u4").tobytes())
        return [batch.column(0), pa.array(out, pa.binary())]

    return arrow_map(packed.join(held, "ident", "left").select("doc_id", "raw", "known"), whole,
                     f"doc_id {id_type}, ids binary", SLICE, lambda: codec(name))


def _packed(col: pa.Array) -> pa.Array:
    """Texts (null: empty) as zstd frames, for a smaller shuffle."""
    import zstandard
    z = zstandard.ZstdCompressor(level=3)
    return pa.array([z.compress(v or b"") for v in col.cast(pa.binary()).to_pylist()], pa.binary())


def _unpacked(col: pa.Array):
    import zstandard
    z = zstandard.ZstdDecompressor()
    return map(z.decompress, col.to_pylist())


def decode(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids, text): the text of ids as ``encode`` returns them; special
    tokens keep their own text, bytes that are no UTF-8 become U+FFFD.  Null
    ids give a null text."""
    name = tokenizer

    def fn(batch, c):
        text = [None if v is None else c.decode(np.frombuffer(v, "<u4")).decode("utf-8", "replace")
                for v in batch.column(1).to_pylist()]
        return [batch.column(0), batch.column(1), pa.array(text, pa.string())]

    cols = encoded.select("doc_id", "ids")
    return arrow_map(cols, fn, f"doc_id {cols.schema['doc_id'].dataType.simpleString()}, ids binary, text string",
                     SLICE, lambda: codec(name))
