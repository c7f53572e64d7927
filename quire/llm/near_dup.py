"""MinHash near-duplicates with sequential Bayesian verification.

Steps, all joins and groupings in Spark:

1. one pass hashes each text's distinct word shingles into a signature;
   documents with equal sets become one node, so a group of copies costs
   one row from here on;
2. banded candidates: nodes that share a band's signature rows.  Every node
   of a band bucket is paired with the bucket's smallest and largest only;
3. candidate signatures are compared batch by batch; a pair leaves when the
   posterior probability of reaching the threshold falls below ``miss``;
4. survivors are verified on the full shingle sets;
5. a bucket may still hold nodes of different components, for no link to
   those two does not rule out one among the others.  The nodes of
   such buckets are joined on the rarest shingles of their sets: two sets
   that reach the threshold share one of them, at places that leave room for
   the overlap (prefix and positional filtering).  Pairs that pass go through
   3 and 4 too.  So no link is lost to the star of step 2, and a large group
   of copies that are near their source but not each other adds few pairs.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WordHashes, arrow_map, mix, shingle_hashes, signed, stored, text_key
from quire.llm.components import components

BANDS, ROWS = 32, 4
SEED = 20


def shingles(text: str | None, cache_: WordHashes, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes; empty for null or wordless texts."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(shingle_hashes(cache_.of(words), k))


@cache
def _hashers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return (r.integers(1, 2**32, n, dtype=np.uint32) | np.uint32(1),
            r.integers(0, 2**32, n, dtype=np.uint32))


def signature(sets: np.ndarray, n: int) -> np.ndarray:
    a, b = _hashers(n)
    x = (sets ^ (sets >> np.uint64(32))).astype(np.uint32)
    sig = np.full(n, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 1024):
        y = x[at:at + 1024][:, None] * a
        y ^= b
        y *= np.uint32(0x85EBCA6B)
        np.minimum(sig, y.min(axis=0), out=sig)
    return sig


def nodes(docs: DataFrame, k: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, tkey, n_shingles, node (digest of the set; null if empty), sig."""

    def fn(batch, words):
        sizes, keys, sigs = [], [], []
        for t in batch.column("text").to_pylist():
            s = shingles(t, words, k)
            sizes.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sigs.append(signature(s, bands * rows).tobytes() if len(s) else None)
        return [batch.column("doc_id"), batch.column("tkey"), sizes, keys, sigs]

    return arrow_map(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tkey"), "text"),
        fn, "doc_id long, tkey long, n_shingles long, node binary, sig binary", start=WordHashes)


def band_rows(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """(band long, node): one row per node and band; the band number is
    part of the key."""

    def fn(batch, _):
        ids = batch.column("node")
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32)
        sig = sig.reshape(len(ids), bands, rows).astype(np.uint64)
        h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(ids), bands))
        for r in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
        return [signed(h).ravel(), ids.take(pa.array(np.repeat(np.arange(len(ids)), bands)))]

    return arrow_map(reps.select("node", "sig"), fn, "band long, node binary")


@cache
def least_matches(n: int, step: int, threshold: float, miss: float) -> list[int]:
    """For each prefix of step, 2*step, ... n hashes, the fewest matches at
    which P(similarity >= threshold | matches) >= miss, uniform prior."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for m in range(step, n + 1, step):
        for hit in range(m + 1):
            logp = hit * np.log(grid) + (m - hit) * np.log1p(-grid)
            p = np.exp(logp - logp.max())
            if p[grid >= threshold].sum() >= miss * p.sum():
                out.append(hit)
                break
    return out


def bayes_prune(pairs: DataFrame, reps: DataFrame, threshold: float, miss: float,
                n: int, step: int = 16) -> DataFrame:
    """Pairs (a, b) whose signatures survive every batch."""
    sig = reps.select("node", "sig")
    joined = (pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
              .join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b"))
    need = least_matches(n, step, threshold, miss)

    def fn(batch, _):
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, n)
                for c in ("sa", "sb"))
        alive, hits = np.arange(len(x)), np.zeros(len(x), np.int64)
        for i, least in enumerate(need):
            cut = slice(i * step, (i + 1) * step)
            hits = hits + (x[alive, cut] == y[alive, cut]).sum(axis=1)
            keep = hits >= least
            alive, hits = alive[keep], hits[keep]
        take = pa.array(alive)
        return [batch.column("a").take(take), batch.column("b").take(take)]

    return arrow_map(joined, fn, "a binary, b binary")


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold:
    100 * intersection >= percent * union."""
    joined = (pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
              .join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a"))

    def start():
        return {"words": WordHashes(), "last": (None, None)}

    def fn(batch, state):
        keep = []
        for i, (a, ta, tb) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "ta", "tb")))):
            if state["last"][0] != a:
                state["last"] = (a, shingles(ta, state["words"], k))
            x, y = state["last"][1], shingles(tb, state["words"], k)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                keep.append(i)
        take = pa.array(keep, pa.int64())
        return [batch.column("a").take(take), batch.column("b").take(take)]

    return arrow_map(joined.select("a", "b", "ta", "tb"), fn, "a binary, b binary", slice_rows=256,
                     start=start)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, miss: float = 1e-7,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, tkey, n_shingles, component_id, first_key per document.

    ``component_id`` is the smallest doc_id of the component (a null id only
    if all are null) and ``first_key`` the text key of that document.  Null,
    empty and wordless texts have no shingles and stand alone.  Repeated
    rows and equal texts share a node.  Extra columns are ignored.  With 32
    bands of 4, a pair at similarity 0.75 is no candidate with probability
    5e-6; ``miss`` bounds the loss in each Bayesian batch."""
    n = bands * rows
    all_nodes = stored(nodes(docs, k, bands, rows), "nodes")
    reps = stored(all_nodes.filter("node is not null").groupBy("node")
                  .agg(F.min(F.struct(*order_cols(), "sig")).alias("r"))
                  .select("node", "r.no", "r.doc_id", "r.tkey", "r.sig"), "reps")
    band = band_rows(reps, bands, rows)
    hubs = stored(band.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
                  .filter("lo <> hi"), "hubs")
    members = stored(band.join(hubs, "band"), "members")
    star = (members.filter("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b"))
            .union(members.filter("node <> hi").select("node", "hi")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tkey"), "text")
    once = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()

    def texts_of(some):
        """The texts of these nodes, stored: whole texts move once for all uses."""
        where = reps.join(some, "node").select("node", "doc_id", "tkey")
        found = texts.alias("t").join(where.alias("w"), F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))
                                      & (F.col("t.tkey") == F.col("w.tkey"))).select("node", "text")
        # Repeated rows, where there are any, are the only repeated nodes.
        return stored(found if once else found.dropDuplicates(["node"]), "texts")

    def close_pairs(pairs):
        return stored(bayes_prune(pairs, reps, percent / 100, miss, n), "close")

    close = close_pairs(star)
    used = close.select(F.col("a").alias("node")).union(close.select("b")).distinct()
    links = stored(verify(close, texts_of(used), k, percent), "links")
    roots = stored(components(links), "roots")
    mixed = mixed_nodes(members, roots)
    mixed_texts = texts_of(mixed.select("node"))
    rest = stored(cross_pairs(mixed, mixed_texts, star, k, percent), "rest")
    if not rest.isEmpty():
        more = stored(verify(close_pairs(rest), mixed_texts, k, percent), "links")
        if not more.isEmpty():
            roots = stored(components(links.unionByName(more)), "roots")
    named = (reps.join(roots, "node", "left")
             .select("node", F.coalesce("root", "node").alias("root"), "no", "doc_id", "tkey"))
    heads = named.groupBy("root").agg(F.min(F.struct("no", "doc_id", "tkey")).alias("h"))
    heads = stored(named.select("node", "root").join(heads, "root")
                   .select("node", F.col("h.doc_id").alias("component_id"),
                           F.col("h.tkey").alias("first_key")), "heads")
    return (all_nodes.drop("sig").join(heads, "node", "left")
            .select("doc_id", "tkey", "n_shingles",
                    F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
                    .alias("component_id"),
                    F.when(F.col("node").isNull(), F.col("tkey")).otherwise(F.col("first_key"))
                    .alias("first_key")))


def order_cols():
    """Smallest doc_id first, null ids last, then the text key."""
    return [F.col("doc_id").isNull().alias("no"), F.col("doc_id"), F.col("tkey")]


def mixed_nodes(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) of the nodes in buckets of more than one component."""
    named = (members.select("band", "node").join(roots.withColumnRenamed("root", "r"), "node", "left")
             .select("band", "node", F.coalesce("r", "node").alias("root")))
    mixed = (named.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
             .filter("lo <> hi").select("band"))
    return stored(named.join(mixed, "band", "left_semi").select("node", "root").distinct(), "mixed")


def cross_pairs(mixed: DataFrame, texts: DataFrame, tested: DataFrame, k: int, percent: int) -> DataFrame:
    """Untested pairs of mixed nodes of different components that can reach
    the threshold by their sizes and the places of a shared rare shingle."""

    def fn(batch, words):
        sets = [shingles(t, words, k) for t in batch.column("text").to_pylist()]
        size = [len(x) for x in sets]
        at = pa.array(np.repeat(np.arange(len(sets)), size))
        return [batch.column("node").take(at), np.repeat(size, size), signed(np.concatenate(sets))]

    each = arrow_map(texts, fn, "node binary, size long, shingle long", slice_rows=256, start=WordHashes)
    # Stored, so that the join can split a shingle that very many sets have.
    often = stored(each.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1"), "often")
    turn = Window.partitionBy("node").orderBy(F.coalesce("df", F.lit(1)), "shingle")
    rare = (each.join(often, "shingle", "left").withColumn("i", F.row_number().over(turn))
            .filter(f"i <= size - ceil({percent} * size / 100) + 1 and df is not null")
            .join(mixed, "node").select("shingle", "node", "size", "i", "root"))
    shared = rare.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    rare = stored(rare.join(shared.filter("lo <> hi"), "shingle", "left_semi"), "rare")
    x, y = (rare.select("shingle", F.col("node").alias(n), F.col("root").alias("r" + n),
                        F.col("size").alias("s" + n), F.col("i").alias("i" + n)) for n in "ab")
    # Overlap needed: percent / (100 + percent) of both sizes.
    can = (f"a < b and ra <> rb and {100 + percent} * (1 + least(sa - ia, sb - ib)) >= {percent} * (sa + sb)")
    pairs = x.join(y, "shingle").filter(can).select("a", "b").distinct()
    return pairs.join(tested, ["a", "b"], "left_anti")
