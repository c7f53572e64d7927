"""Term weights over a document table (O-30..O-33, O-36..O-40).

Weights follow the usual smoothed TF-IDF: raw count times
``ln((1 + n) / (1 + df)) + 1``, then L2 normalised per document.  Everything
is a long postings table ``(key, term, ...)``; no vectors, no dense matrix.

Shuffles: whole texts are dealt out by document, in partitions whose counts
fit their task, so counting shuffles no posting.  ``weights`` keeps the
postings on disk where they lie.  Document frequency is a partial+final
aggregate by term.  The most frequent terms, at most ``HEAVY_TERMS`` and with
nearly all postings, meet their frequency by broadcast and stay with their
document; only postings of rare terms are shuffled (``by_frequency``), so no key
of that join has more than 1 / ``HEAVY_TERMS`` of the postings.  Norms are
aggregates by document, one row each, joined back where the postings lie.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import config
from quire.functions import text as T
from quire.session import written


#: Characters of a partition whose n-grams are counted.  A larger one holds
#: more counts than fit its task's memory, and those are spilled.
PARTITION_CHARS = 4_000_000


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def tokenize(docs: DataFrame, key: str | list[str] = "uid", text: str = "full_text",
             stop_words: list[str] | None = None) -> DataFrame:
    """``(key..., tokens)``: lower-cased word runs without stop words (O-30)."""
    keys = _keys(key)
    raw = docs.select(*keys, T.raw_tokens(text).alias("_raw"))
    return T.drop_stop_words(raw, "_raw", "tokens", stop_words).select(*keys, "tokens")


def stop_word_table(spark, stop_words: list[str] | None = None) -> DataFrame:
    words = config.english_stop_words() if stop_words is None else list(stop_words)
    return spark.createDataFrame([(w,) for w in words], "term string")


def unigram_counts(docs: DataFrame, key: str | list[str] = "uid", text: str = "full_text",
                   stop_words: list[str] | None = None) -> DataFrame:
    """Postings ``(key..., term, tf)`` of single words.  Stop words are
    dropped with an anti-join against the stop list, broadcast because the
    list is a fixed, small parameter; this avoids rebuilding token arrays.
    Texts move, in small partitions by the first key; their words do not."""
    keys = _keys(key)
    raw = _small_partitions(docs, keys[:1], text).select(*keys, F.explode(T.raw_tokens(text)).alias("term"))
    stop = F.broadcast(stop_word_table(docs.sparkSession, stop_words))
    kept = raw.join(stop, "term", "left_anti")
    return kept.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def postings(docs: DataFrame, key: str | list[str] = "uid", text: str = "full_text",
             n_max: int = 1, stop_words: list[str] | None = None) -> DataFrame:
    """Postings of 1..n_max-grams; single words take the cheaper path.

    For n-grams the texts are first hash-partitioned by document: the
    n-gram rows are several times larger than the text, and with whole
    documents in each partition the per-document count needs no shuffle.
    Partitions are small enough for their counts to stay in memory."""
    if n_max == 1:
        return unigram_counts(docs, key, text, stop_words)
    keys = _keys(key)
    return term_counts(tokenize(_small_partitions(docs, keys, text), key, text, stop_words), key, n_max)


def _small_partitions(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Whole documents, about PARTITION_CHARS characters to a partition."""
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    least = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(max(least, -(-chars // PARTITION_CHARS)), *keys)


def term_counts(tokens: DataFrame, key: str | list[str] = "uid",
                n_max: int = 1) -> DataFrame:
    """Postings ``(key..., term, tf)`` of the 1..n_max-grams (O-31)."""
    keys = _keys(key)
    terms = tokens.select(*keys, F.explode(T.ngrams("tokens", n_max)).alias("term"))
    return terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def n_documents(docs: DataFrame) -> Column:
    """Number of documents as a scalar subquery (evaluated once, in Spark)."""
    return docs.select(F.count(F.lit(1))).scalar()


#: Terms broadcast with their frequency, at most.
HEAVY_TERMS = 100_000


def by_frequency(postings: DataFrame, frequency: DataFrame, n_postings: int,
                 heavy_terms: int = HEAVY_TERMS) -> tuple[DataFrame, DataFrame]:
    """``postings`` with the columns of ``frequency(term, df, ...)``, in two
    parts: those of heavy hitters and the rest.

    A term of more than n_postings / heavy_terms postings is a heavy hitter.
    There are fewer than ``heavy_terms`` of them, whatever the data, so they
    are broadcast and their postings stay where they are; the rest is
    shuffled, at most n_postings / heavy_terms rows to a key.  ``df`` must
    not be below a term's number of postings."""
    limit = max(1, n_postings // heavy_terms)
    heavy = F.broadcast(frequency.where(F.col("df") > limit))
    return postings.join(heavy, "term"), (postings.join(heavy.select("term"), "term", "left_anti")
                                          .join(frequency.where(F.col("df") <= limit), "term"))


def with_frequency(postings: DataFrame, frequency: DataFrame, n_postings: int,
                   heavy_terms: int = HEAVY_TERMS) -> DataFrame:
    """Both parts of ``by_frequency``."""
    heavy, rest = by_frequency(postings, frequency, n_postings, heavy_terms)
    return heavy.unionByName(rest)


def weights(postings: DataFrame, n_docs: Column, key: str = "uid",
            heavy_terms: int = HEAVY_TERMS) -> DataFrame:
    """``(key, term, tf, df, weight)``, weight L2-normalised per document
    (O-32, O-33).  Documents without terms have no rows (zero vectors).  With
    a column ``copies`` a posting stands for so many documents.

    The postings stay on disk where they were counted, dealt by document, so
    that neither norms nor weights of frequent terms shuffle them."""
    post = postings.persist(StorageLevel.DISK_ONLY)
    copies = F.sum("copies") if "copies" in post.columns else F.count(F.lit(1))
    df = written(post.groupBy("term").agg(copies.alias("df")), "frequencies")
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    # Frequencies with copies are at least as high as numbers of postings.
    parts = [p.withColumn("_w", F.col("tf") * idf)
             for p in by_frequency(post, df, df.agg(F.sum("df")).first()[0] or 0, heavy_terms)]
    squares = [p.groupBy(key).agg(F.sum(F.col("_w") * F.col("_w")).alias("_s")) for p in parts]
    norms = written(squares[0].unionByName(squares[1]).groupBy(key).agg(F.sqrt(F.sum("_s")).alias("_norm")), "norms")
    # A null key is a document too, but meets nothing in a join.
    of_null = norms.where(F.col(key).isNull()).select("_norm").scalar()
    heavy, rest = (p.join(norms.hint("shuffle_hash"), key, "left").select(
        key, "term", "tf", "df", (F.col("_w") / F.coalesce("_norm", of_null)).alias("weight")) for p in parts)
    return heavy.unionByName(rest)


def tfidf(docs: DataFrame, key: str = "uid", text: str = "full_text",
          n_max: int = 1, stop_words: list[str] | None = None) -> DataFrame:
    """Weighted postings of a document table in one call."""
    return weights(postings(docs, key, text, n_max, stop_words), n_documents(docs), key)


def ranked_terms(weighted: DataFrame, key: str = "uid") -> DataFrame:
    """Every term of every document ranked by (weight, term) descending
    (O-36).  One window by document."""
    w = Window.partitionBy(key).orderBy(F.col("weight").desc(), F.col("term").desc())
    return weighted.withColumn("rank", F.row_number().over(w))


def band(n_docs: Column, lower: int = 0, upper: int = 0) -> tuple[Column, Column]:
    """Document-frequency band; 0 means the default share of n (O-38)."""
    lo = F.lit(lower) if lower else F.floor(n_docs * F.lit(config.BAND_LOWER)).cast("long")
    hi = F.lit(upper) if upper else F.floor(n_docs * F.lit(config.BAND_UPPER)).cast("long")
    return lo, hi


def top_terms(weighted: DataFrame, n_docs: Column, key: str = "uid",
              length: int = config.TOP_TERMS, lower: int = 0,
              upper: int = 0) -> DataFrame:
    """``(key, top_terms array, top_terms_csv)``: the first ``length`` terms
    of each document, in rank order, among terms whose document frequency
    lies strictly inside the band (O-38).  Spark inserts a per-partition
    group limit before the shuffle, so at most ``length`` rows per document
    move.  Documents with no allowed term are absent; callers left-join."""
    lo, hi = band(n_docs, lower, upper)
    allowed = weighted.where((F.col("df") > lo) & (F.col("df") < hi))
    w = Window.partitionBy(key).orderBy(F.col("weight").desc(), F.col("term").desc())
    top = allowed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= length)
    agg = top.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("_r", "term"))).alias("_t"))
    terms = F.transform("_t", lambda s: s["term"])
    return agg.select(key, terms.alias("top_terms"),
                      F.array_join(terms, ",").alias("top_terms_csv"))


def term_statistics(weighted: DataFrame) -> DataFrame:
    """Per term: number of documents and sum of weights (O-37)."""
    return weighted.groupBy("term").agg(
        F.count(F.lit(1)).alias("doc_count"), F.sum("weight").alias("score_sum"))


def df_histogram(weighted: DataFrame, n_docs: Column, lower: int = 0,
                 upper: int = 0) -> DataFrame:
    """Document count -> number of n-grams, flagged when strictly inside the
    band, ascending (O-39)."""
    lo, hi = band(n_docs, lower, upper)
    per_term = weighted.groupBy("term").agg(F.count(F.lit(1)).alias("doc_count"))
    hist = per_term.groupBy("doc_count").agg(F.count(F.lit(1)).alias("n_terms"))
    flag = F.when((F.col("doc_count") > lo) & (F.col("doc_count") < hi), "**") \
        .otherwise("")
    return hist.select("doc_count", "n_terms", flag.alias("in_band")).orderBy("doc_count")


def parity(docs: DataFrame, tokens: DataFrame, key: str = "uid",
           text: str = "full_text") -> DataFrame:
    """Keys, texts and vectors must have equal counts; a mismatch stops the
    query with an error (O-40)."""
    d = docs.agg(F.count(key).alias("n_keys"), F.count(text).alias("n_texts"))
    v = tokens.agg(F.count(F.lit(1)).alias("n_vectors"))
    joined = d.select("*", v.select("n_vectors").scalar().alias("n_vectors"))
    ok = (F.col("n_keys") == F.col("n_texts")) & (F.col("n_texts") == F.col("n_vectors"))
    return joined.select(
        "n_keys", "n_texts", "n_vectors",
        F.when(ok, F.lit(True)).otherwise(
            F.raise_error(F.lit("parity check failed: keys, texts and vectors differ"))
            .cast("boolean")).alias("ok"))
