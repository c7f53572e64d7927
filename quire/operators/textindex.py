"""Substring search of many queries at once through a stored gram index
(O-12, O-43 in batch).

A query is the inside of ``LIKE '%q%'``: ASCII case-insensitive, ``%`` and
``_`` are wildcards, there is no escape character.  The index holds which
documents contain which one, two and three character grams, and how long
they are; a query names grams that every match must contain, its documents
are those that have all of them, and LIKE itself then decides on their
texts.  Results equal scanning every text for every query.

Every query takes that path:

* a run of three or more plain characters gives its trigrams,
* else its longest runs, of two or one character, give their grams,
* a query of wildcards alone matches texts of at least as many characters as
  it has ``_``: it looks up a length mark (the power of two not above that
  number), of which each document has one for every power up to its length.

Of a query's grams the rarest few are looked up; a gram that stands nowhere
ends the query there.  All is equi-joins; a gram that most documents have is
a long key only where a query has no rarer one.

The index is kept in segments: every task writes the lists of its own
documents, a row for each gram of a block of texts, by gram in a block.
Building it shuffles nothing and holds one block.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import config
from quire.functions import text as T
from quire.operators import search
from quire.session import shared_path, written

# Executors need not have this package: what tasks run is pickled by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Grams that are looked up for a query: its rarest.
LOOKED_UP = 4
#: Characters of a block of texts, whose grams are sorted in one array.
BLOCK_CHARS = 2_000_000
#: Looked-up grams that are broadcast; more are joined by a shuffle.
BROADCAST_GRAMS = 1_000_000


class GramIndex(NamedTuple):
    postings: DataFrame  #: (gram, docs, uids), a row for each block of texts, by gram in a block
    grams: DataFrame     #: (gram, df)


def _inside(n: int):
    """The windows of n characters of a run."""
    def windows(run: Column) -> Column:
        last = F.char_length(run) - F.lit(n - 1)
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(run, i, F.lit(n)))) \
            .otherwise(F.array().cast("array<string>"))
    return windows


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys.sort()
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def text_grams(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(grams, counts, texts): all different grams of one to three characters
    of each text, and its length marks (four characters or more, so no gram
    equals one); of each gram its number of texts, and their places, gram by
    gram."""
    n = len(texts)
    sizes = np.fromiter(map(len, texts), "i8", n)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype("i8")
    points[(points >= 65) & (points <= 90)] += 32
    # Characters are numbered from 1 in their order; 0 stands for none.
    number = np.zeros(0x110000, "i8")
    number[points] = 1
    letters = np.flatnonzero(number)
    base = len(letters) + 1
    if base ** 3 * n >= 1 << 63 and n > 1:
        (left, few, at), (right, more, behind) = text_grams(texts[:n // 2]), text_grams(texts[n // 2:])
        return left + right, np.append(few, more), np.append(at, behind + n // 2)
    number[letters] = np.arange(1, base)
    first = number[points]
    ends = np.cumsum(sizes)[sizes > 0] - 1
    second = np.append(first[1:], 0)
    second[ends] = 0
    third = np.append(second[1:], 0)
    third[ends] = 0
    text = np.repeat(np.arange(n), sizes)
    longest = _distinct(((first * base + second) * base + third) * n + text)
    # Whatever is shorter starts a longer window, or stands at the end.
    window, text = longest // n, longest % n
    keys = _distinct(np.concatenate([longest] + [window // b * b * n + text for b in (base, base * base)]))
    window, text = keys // n, keys % n
    starts = np.flatnonzero(np.append(True, window[1:] != window[:-1])) if len(window) else np.zeros(0, "i8")
    codes = window[starts]
    parts = np.stack([codes // (base * base), codes // base % base, codes % base], 1)
    characters = np.append(0, letters)[parts][parts > 0].astype("<u4").tobytes().decode("utf-32-le")
    bounds = np.append(0, np.cumsum((parts > 0).sum(1))).tolist()
    grams = [characters[i:j] for i, j in zip(bounds, bounds[1:])]
    counts = np.diff(np.append(starts, len(window)))
    marks = [np.arange(n)] + [np.flatnonzero(sizes >> j) for j in range(int(sizes.max(initial=0)).bit_length())]
    names = ["size"] + [f"size{j}" for j in range(len(marks) - 1)]
    return grams + names, np.append(counts, [len(m) for m in marks]), np.concatenate([text, *marks])


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BLOCK_CHARS characters; one at least."""
    start = chars = 0
    for i, t in enumerate(texts):
        if i > start and chars + len(t) > BLOCK_CHARS:
            yield start, i
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield start, len(texts)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, docs, uids) of the blocks of each batch of (uid, text)."""
    for batch in batches:
        uids = batch.column(0)
        texts = [t.decode("utf-8", "replace") for t in batch.column(1).cast(pa.binary()).to_pylist()]
        for start, end in _blocks(texts):
            grams, counts, at = text_grams(texts[start:end])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()),
                                             uids.take(pa.array(at + start)))
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(counts, pa.int32()), lists],
                                             ["gram", "docs", "uids"])


def single_wildcards(q: Column) -> Column:
    return F.char_length(q) - F.char_length(F.replace(q, F.lit("_"), F.lit("")))


def query_grams(q: str | Column) -> Column:
    """Grams that every match of the query contains."""
    t = T.ascii_lower(q)
    runs = F.split(t, "[%_]", -1)
    of = [F.array_distinct(F.flatten(F.transform(runs, _inside(n)))) for n in (3, 2, 1)]
    least = single_wildcards(t)
    mark = F.when(least > 0, F.concat(F.lit("size"), F.floor(F.log2(least)).cast("int").cast("string"))) \
        .otherwise(F.lit("size"))
    return (F.when(F.size(of[0]) > 0, of[0]).when(F.size(of[1]) > 0, of[1]).when(F.size(of[2]) > 0, of[2])
            .otherwise(F.array(mark)))


def build(document: DataFrame, path: str | None = None, key: str = "uid", text: str = "full_text") -> GramIndex:
    """Build the index below ``path`` (default: the shared folder).  Null
    texts match nothing and are not in it."""
    path = path or shared_path(document.sparkSession, "gram-index")
    rows = document.where(F.col(text).isNotNull()).select(F.col(key).alias("uid"), F.col(text).alias("text"))
    kind = rows.schema["uid"].dataType.simpleString()
    # Not sorted over blocks: a task holds one of them, however large its part of the table.
    rows.mapInArrow(_lists, f"gram string, docs int, uids array<{kind}>").write.parquet(f"{path}/postings")
    found = document.sparkSession.read.parquet(f"{path}/postings")
    (found.groupBy("gram").agg(F.sum("docs").alias("df")).repartitionByRange("gram").sortWithinPartitions("gram")
     .write.parquet(f"{path}/grams"))
    return load(document.sparkSession, path)


def load(spark: SparkSession, path: str) -> GramIndex:
    return GramIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/grams"))


def candidates(index: GramIndex, queries: DataFrame) -> DataFrame:
    """``(qid, uid)``: documents that have the rarest grams of a query."""
    named = queries.where("q is not null").select("qid", F.explode(query_grams("q")).alias("gram"))
    counted = named.join(index.grams, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = Window.partitionBy("qid").orderBy("df", "gram")
    few = written(counted.withColumn("_r", F.row_number().over(rarest)).where(F.col("_r") <= LOOKED_UP)
                  .withColumn("needed", F.count(F.lit(1)).over(Window.partitionBy("qid")))
                  .select("qid", "gram", "needed"), "looked-up")
    if few.count() <= BROADCAST_GRAMS:
        few = F.broadcast(few)
    return (index.postings.join(few, "gram").select("qid", "needed", F.explode("uids").alias("uid"))
            .groupBy("qid", "uid", "needed").agg(F.count(F.lit(1)).alias("has"))
            .where("has = needed").select("qid", "uid"))


def _in_order(text: str, runs: str) -> Column:
    """Whether the runs stand in the text, one behind the other."""
    return F.aggregate(runs, F.lit(1), lambda at, run: F.when(at == 0, 0).otherwise(
        F.when(F.position(run, F.col(text), at) == 0, 0).otherwise(
            F.position(run, F.col(text), at) + F.char_length(run)))) > 0


def matches(document: DataFrame, index: GramIndex, queries: DataFrame) -> DataFrame:
    """``(qid, uid)`` of every match of ``queries(qid, q)`` (O-12); query ids
    must differ.  A null query matches nothing.

    Texts are read only where they decide: a plain query of one to three
    characters is a gram itself, and wildcards alone ask for a length."""
    q = T.ascii_lower("q")
    like = F.concat(F.lit("%"), F.replace(q, F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    kinds = written(queries.where("q is not null").select(
        "qid", "q", F.filter(F.split(q, "[%_]", -1), lambda run: run != "").alias("runs"),
        F.when(F.contains(q, F.lit("_")), like).alias("like"),
        F.when(F.translate(q, "%_", "") == "", single_wildcards(q)).alias("least"),
        ((F.translate(q, "%_", "") == q) & F.char_length(q).between(1, 3)).alias("is_gram")), "queries")
    few = written(candidates(index, kinds.select("qid", "q")), "candidates")
    by_length = few.join(kinds.where("least is not null").select("qid", "least"), "qid")
    by_text = few.join(kinds.where("least is null and not is_gram").select("qid", "runs", "like"), "qid")
    grams = few.where("uid is not null").join(kinds.where("is_gram").select("qid"), "qid")
    lengths = document.select("uid", F.char_length("full_text").alias("n"))
    texts = document.select("uid", T.ascii_lower("full_text").alias("t"))
    # The cheapest question first: all runs of a plain query or one with %,
    # their order if there are several, and LIKE only where there is a _.
    hit = (F.forall("runs", lambda run: F.contains(F.col("t"), run))
           & ((F.size("runs") == 1) | _in_order("t", "runs")) & (F.col("like").isNull() | F.like("t", "like")))
    return (grams.unionByName(by_length.join(lengths, "uid").where("n >= least").select("qid", "uid"))
            .unionByName(by_text.join(texts, "uid").where(hit).select("qid", "uid")))


def search_batch(document: DataFrame, index: GramIndex, queries: DataFrame, k: int = config.SEARCH_LIMIT,
                 preview_words: int = config.PREVIEW_FEED) -> DataFrame:
    """The ``k`` newest matches of every query, with rank and listing (O-43):
    by ``u_date`` descending, then uid.  Spark limits each query to k rows
    before the ranking shuffle."""
    found = matches(document, index, queries).join(document.select("uid", "u_date"), "uid")
    newest = Window.partitionBy("qid").orderBy(F.col("u_date").desc(), F.col("uid"))
    top = found.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= k).select("qid", "rank", "uid")
    listing = document.select(*search.LISTING)
    return top.join(listing, "uid").select(
        "qid", "rank", "uid", "doc_date", "title", T.preview("full_text", preview_words).alias("preview"),
        "from_auth", "from_bur")
