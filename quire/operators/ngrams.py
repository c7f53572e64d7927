"""Frequent n-grams level by level (the counting behind O-38, O-42, O-44).

An n-gram stands in no more documents than each of its parts.  So when only
n-grams above a document frequency are of interest, words are counted first,
pairs are built only of neighbouring words that are both above it, triples
only of two such pairs that overlap, and so on.  A rare word is never
exploded into n-grams, shuffled with them or stored.

What is left of a document after a level is one row with an array of
``(pos, term, last)``; the next level is made inside that row, without a
shuffle: each task looks its terms up in the set of frequent ones, so no text
and no word moves.  With the default band a kept term stands in more than 5 % of all
documents, so a level keeps at most 20 times the number of different
n-grams of an average document, whatever the size of the corpus.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import config
from quire.operators import tfidf
from quire.session import written


#: Frequent terms that tasks look up in a set of their own; more are joined.
LOOKED_UP_TERMS = 10_000


class Level(NamedTuple):
    """The n-grams of one length above the bound."""

    documents: DataFrame  #: (key, grams array<struct<pos, term, last>>), by position
    frequency: DataFrame  #: (term, df)


def _exploded(documents: DataFrame, key: str) -> DataFrame:
    return documents.select(key, F.explode("grams").alias("g")).select(key, "g.*")


def _collected(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "term", "last"))).alias("grams"))


def _frequency(documents: DataFrame, key: str, terms: Column, lower: Column, only: DataFrame | None) -> DataFrame:
    """(term, df) of the terms above the bound; with ``only``, of those that
    stand in the documents it names."""
    terms = F.array_distinct(terms)
    # An outer explode: of a plain one Spark asks the size before, and so
    # makes all terms twice.
    post = documents.select(F.explode_outer(terms).alias("term")).where("term is not null")
    if only is not None:
        shown = (documents.join(only.select(key), key, "left_semi")
                 .select(F.explode(terms).alias("term")).distinct())
        post = post.join(written(shown, "shown-terms"), "term", "left_semi")
    return written(post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > lower),
                   "frequent-terms")


def _looked_up(frequency: DataFrame) -> list[str] | None:
    """The frequent terms, or None where they are too many for a set."""
    terms = [r["term"] for r in frequency.select("term").limit(LOOKED_UP_TERMS + 1).collect()]
    return terms if len(terms) <= LOOKED_UP_TERMS else None


def _among(documents: DataFrame, key: str, grams: Column, terms: list[str]) -> DataFrame:
    """What the terms leave of each document, in its row."""
    return documents.select(key, F.filter(grams, lambda g: g["term"].isin(terms)).alias("grams"))


def longer(grams: Column) -> Column:
    """n + 1-grams of overlapping n-grams at neighbouring positions."""
    both = F.zip_with(grams, F.slice(grams, 2, F.greatest(F.size(grams), F.lit(1))), lambda a, b: F.when(
        b["pos"] == a["pos"] + 1, F.struct(a["pos"].alias("pos"), F.concat(a["term"], F.lit(" "), b["last"]).alias("term"),
                                           b["last"].alias("last"))))
    return F.filter(both, lambda g: g.isNotNull())


def levels(docs: DataFrame, key: str, text: str, lower: Column, n_max: int = config.NGRAM_MAX,
           stop_words: list[str] | None = None, only: DataFrame | None = None) -> list[Level]:
    """The n-grams of 1 to ``n_max`` words with a document frequency above
    ``lower``; with ``only`` (a small table of keys) those among them that
    stand in the documents it names, frequencies counted over all."""
    tokens = tfidf.tokenize(docs, key, text, stop_words)
    frequency = _frequency(tokens, key, F.col("tokens"), lower, only)
    # Rows of a repeated key are one document, and are gathered by a shuffle.
    one_row = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    terms = _looked_up(frequency) if one_row else None
    if terms is not None:
        words = F.transform("tokens", lambda t, i: F.struct(i.alias("pos"), t.alias("term"), t.alias("last")))
        kept = _among(tokens, key, words, terms)
    else:
        # Whole texts are dealt out by document (they are smaller than their
        # exploded words), so that collecting what is left needs no shuffle; of
        # the words of a few documents so little is left that it moves instead.
        whole = docs.select(key, text)
        rows = (tfidf.tokenize(whole.repartition(key) if only is None else whole, key, text, stop_words)
                .select(key, F.posexplode("tokens").alias("pos", "term"))
                .join(frequency.select("term"), "term", "left_semi").withColumn("last", F.col("term")))
        kept = _collected(rows, key)
    out = [Level(written(kept, "frequent-words"), frequency)]
    while len(out) < n_max:
        pairs = out[-1].documents.select(key, longer(F.col("grams")).alias("grams"))
        frequency = _frequency(pairs, key, F.transform("grams", lambda g: g["term"]), lower, only)
        terms = _looked_up(frequency)
        if terms is not None:
            kept = _among(pairs, key, F.col("grams"), terms)
        else:
            kept = _collected(_exploded(pairs, key).join(frequency.select("term"), "term", "left_semi"), key)
        out.append(Level(written(kept, "frequent-grams"), frequency))
    return out


def postings(found: list[Level], key: str, upper: Column, only: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, df) of the levels' n-grams below the upper bound.
    Documents are dealt out by key with all their n-grams in one row, so that
    counting them needs no shuffle."""
    out = None
    for level in found:
        docs = (level.documents.repartition(key) if only is None
                else level.documents.join(only.select(key), key, "left_semi"))
        rows = (_exploded(docs, key).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
                .join(level.frequency.where(F.col("df") < upper), "term"))
        out = rows if out is None else out.unionByName(rows)
    return out
