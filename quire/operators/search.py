"""Reader queries over the document table (O-10..O-14, O-41..O-44, O-49).

Every query is a filter / projection / top-k over ``document``; Spark
plans ``orderBy(...).limit(k)`` as a per-partition top-k plus a final merge
(``TakeOrderedAndProject``), so no full sort or shuffle of the table.  Ties
are broken by ``uid`` so results do not depend on partitioning.
"""

from __future__ import annotations

import urllib.parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import config
from quire.functions import text as T

LISTING = ["uid", "doc_date", "title", "full_text", "from_auth", "from_bur"]


def _listing(df: DataFrame, preview_words: int) -> DataFrame:
    return df.select("uid", "doc_date", "title",
                     T.preview("full_text", preview_words).alias("preview"),
                     "from_auth", "from_bur")


def where_equal(document: DataFrame, column: str, value, k: int | None = None,
                columns: list[str] | None = None) -> DataFrame:
    """Equality filter, optionally the first ``k`` by uid (O-10); pushed to
    the Parquet scan when ``column`` is stored."""
    out = document.where(F.col(column) == F.lit(value))
    if columns:
        out = out.select(*columns)
    if k is not None:
        out = out.orderBy("uid").limit(k)
    return out


def parsed_doc_date(doc_date: str | Column = "doc_date") -> Column:
    """``December 26, 2012`` text to a date; null for ``unknown`` and other
    unparsable values."""
    c = F.col(doc_date) if isinstance(doc_date, str) else doc_date
    return F.to_date(F.try_to_timestamp(c, F.lit("MMMM d, yyyy")))


def feed(document: DataFrame, k: int = config.FEED_LIMIT,
         preview_words: int = config.PREVIEW_FEED, parse_dates: bool = False) -> DataFrame:
    """Recent documents (O-41): by ``doc_date`` descending, best ``k``.  As in
    the portal the date is ordered as text; ``parse_dates`` orders by the
    parsed date instead (unparsable last)."""
    key = parsed_doc_date() if parse_dates else F.col("doc_date")
    top = document.select(*LISTING).orderBy(key.desc_nulls_last(), F.col("uid")).limit(k)
    return _listing(top, preview_words)


def search(document: DataFrame, q: str, k: int = config.SEARCH_LIMIT,
           preview_words: int = config.PREVIEW_FEED, quoted: bool = False) -> DataFrame:
    """Substring search (O-43, O-12): ``full_text LIKE '%q%'`` with the
    portal's semantics, newest ``u_date`` first, best ``k``.  With
    ``quoted`` the term arrives form-encoded (O-49) and is decoded first."""
    if quoted:
        q = urllib.parse.unquote_plus(q)
    hits = document.select(*LISTING, "u_date").where(T.like_contains("full_text", q))
    top = hits.orderBy(F.col("u_date").desc(), F.col("uid")).limit(k)
    return _listing(top, preview_words)


DETAIL = ["uid", "classification", "title", "doc_date", "from_auth", "from_bur",
          "category", "addressee", "file_name", "html", "full_text", "top_terms"]


def detail(document: DataFrame, uid: str) -> DataFrame:
    """One document's page fields (O-44), ``top_terms`` as an array and the
    display label of its classification; zero rows when absent."""
    d = document.where(F.col("uid") == uid).select(*DETAIL)
    return d.select(*[c for c in DETAIL if c != "top_terms"],
                    T.csv_to_array("top_terms").alias("top_terms"),
                    T.classification_label("classification").alias("label"))


def newest(document: DataFrame, n_docs: int = config.TRENDING_DOCS,
           columns: tuple[str, ...] = ("uid",)) -> DataFrame:
    """The ``n_docs`` newest documents by ``u_date`` (ties by uid)."""
    return (document.select("uid", "u_date", *[c for c in columns if c != "uid"])
            .orderBy(F.col("u_date").desc(), F.col("uid")).limit(n_docs))


def trending(document: DataFrame, n_docs: int = config.TRENDING_DOCS,
             k: int = config.TRENDING_TERMS, offset: int = 0) -> DataFrame:
    """Trending terms (O-42, O-50): the top terms of the ``n_docs`` newest
    documents (``u_date``), counted, by (count, term) descending, ``k``
    after ``offset``."""
    recent = newest(document, n_docs, ("uid", "top_terms"))
    terms = recent.select(F.explode(T.csv_to_array("top_terms")).alias("term")) \
        .where(F.col("term") != "")
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col("term").desc()).offset(offset).limit(k)


def previews(document: DataFrame, preview_words: int = config.PREVIEW_FEED) -> DataFrame:
    """Preview of every document (O-13)."""
    return document.select("uid", T.preview("full_text", preview_words).alias("preview"))


def labels(document: DataFrame) -> DataFrame:
    """Display label of every document's classification (O-14)."""
    return document.select("uid", "classification",
                           T.classification_label("classification").alias("label"))


def url_round_trip(df: DataFrame, column: str) -> DataFrame:
    """Form-encode a text column and decode it again (O-49)."""
    return df.withColumn("quoted", T.quote_plus(column)) \
        .withColumn("unquoted", T.unquote_plus("quoted"))
