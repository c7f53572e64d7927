"""Column expressions over text: tokens, n-grams, previews, labels, urls.

All of these are built-in Spark expressions, so they stay inside whole-stage
code generation; none needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import config


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def raw_tokens(text: str | Column) -> Column:
    """Lower-cased runs of two or more word characters, in order (O-30)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))),
                                F.lit(config.TOKEN_PATTERN), 0)


def drop_stop_words(df: DataFrame, input_col: str, output_col: str,
                    stop_words: list[str] | None = None) -> DataFrame:
    """Remove stop words from an array column with a hash-set lookup.

    ``isin`` over a literal list is a set membership for each token; a
    literal ``array_contains`` would scan the whole list for every token.
    """
    words = config.english_stop_words() if stop_words is None else list(stop_words)
    kept = F.filter(input_col, lambda w: ~w.isin(words)) if words else F.col(input_col)
    return df.withColumn(output_col, kept)


def _gram_at(t: Column, n: int):
    # one-argument lambda: transform() passes (element, index) to two-argument ones
    return lambda i: F.array_join(F.slice(t, i, n), " ")


def ngrams(tokens: str | Column, n_max: int = config.NGRAM_MAX,
           n_min: int = 1) -> Column:
    """All n-grams, n_min <= n <= n_max, space joined, grouped by n then by
    position (O-31).  Short arrays give no n-grams of that size."""
    t = _col(tokens)
    parts = []
    for n in range(n_min, n_max + 1):
        if n == 1:
            parts.append(t)
            continue
        grams = F.transform(F.sequence(F.lit(1), F.size(t) - F.lit(n - 1)),
                            _gram_at(t, n))
        parts.append(F.when(F.size(t) >= n, grams).otherwise(
            F.array().cast("array<string>")))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def preview(text: str | Column, length: int) -> Column:
    """First ``length`` single-space separated words plus `` ...`` when the
    text has more words (O-13).  Empty words count, as in str.split(" ")."""
    t = _col(text)
    words = F.split(t, " ", -1)
    return F.when(F.size(words) > length,
                  F.concat(F.array_join(F.slice(words, 1, length), " "),
                           F.lit(" ..."))).otherwise(t)


def classification_label(classification: str | Column) -> Column:
    """Display label of a classification value, else Uncategorized (O-14)."""
    c = _col(classification)
    expr = None
    for value, label in config.CLASSIFICATION_LABELS.items():
        expr = (F.when(c == value, label) if expr is None
                else expr.when(c == value, label))
    return expr.otherwise(config.UNCATEGORIZED)


def ascii_lower(c: str | Column) -> Column:
    """Fold only A-Z, like SQLite's LIKE does."""
    return F.translate(_col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")


def like_contains(text: str | Column, query: str) -> Column:
    """``text LIKE '%q%'`` with SQLite semantics: ASCII case-insensitive,
    ``%`` and ``_`` in q stay wildcards, no escape character (O-12)."""
    q = query.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                      "abcdefghijklmnopqrstuvwxyz"))
    # Spark's LIKE treats backslash as escape; double it to keep it literal.
    pattern = "%" + q.replace("\\", "\\\\") + "%"
    return ascii_lower(text).like(pattern)


def url_file_name(url: str | Column) -> Column:
    """Last path segment of a url, or the one before it when the url ends
    with a slash (O-17)."""
    parts = F.split(_col(url), "/", -1)
    last = F.element_at(parts, -1)
    return F.when(F.length(last) == 0,
                  F.when(F.size(parts) >= 2, F.element_at(parts, -2))
                  .otherwise(F.lit(""))).otherwise(last)


def quote_plus(q: str | Column) -> Column:
    """Form-encode a search term like ``urllib.parse.quote_plus`` (O-49):
    space becomes ``+``; ``*`` is escaped and ``~`` kept, where Java's
    encoder does the opposite."""
    enc = F.url_encode(_col(q))
    return F.replace(F.replace(enc, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def unquote_plus(q: str | Column) -> Column:
    """Decode a form-encoded term; malformed escapes keep the raw text."""
    c = _col(q)
    return F.coalesce(F.try_url_decode(c), c)


def csv_to_array(c: str | Column) -> Column:
    """Comma-joined text to an array; null gives an empty array (O-50)."""
    col = _col(c)
    return F.when(col.isNull() | (col == ""), F.array().cast("array<string>")) \
        .otherwise(F.split(col, ",", -1))
