"""HTML pages to ordered text blocks (O-08, O-17..O-20, O-26, O-27).

The block job is the one place the library parses HTML, which Spark has no
expression for: ``mapInPandas`` hands Arrow batches of pages to a small
``html.parser`` helper.  Each page is independent, so the job is a narrow
map with no shuffle; de-duplication of a page's blocks happens inside the
same call.  Everything around it (status filter, file names, character
removal, the cut of descriptions) is built-in expressions.
"""

from __future__ import annotations

import hashlib
import itertools
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire import config
from quire.functions import html as H
from quire.functions import text as T

# Python workers need not have this package installed: the helpers they
# run are pickled by value with the task.
cloudpickle.register_pickle_by_value(H)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_FIELDS = "pos int, tag string, text string, html string"


#: Characters of blocks held before they are handed to Spark.
FLUSH_CHARS = 4_000_000


def _block_job(pages: DataFrame, key: str, html: str, fn) -> DataFrame:
    key_type = pages.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, {BLOCK_FIELDS}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, size = [], 0

            def flush():
                out = pd.DataFrame(rows, columns=[key, "pos", "tag", "text", "html"])
                return out.astype({key: pdf[key].dtype, "pos": "int32"})

            for k, markup in zip(pdf[key], pdf[html]):
                for i, (tag, text, h) in enumerate(fn(markup)):
                    rows.append((k, i, tag, text, h))
                    size += len(text) + len(h)
                    if size > FLUSH_CHARS:
                        yield flush()
                        rows, size = [], 0
            if rows:
                yield flush()

    return pages.select(key, html).mapInPandas(run, schema)


def _dedup_first(blocks):
    """Blocks whose html came before are left out; hashes are kept, not texts."""
    seen = set()
    for b in blocks:
        h = hashlib.blake2b(b[2].encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if h not in seen:
            seen.add(h)
            yield b


def page_blocks(pages: DataFrame, key: str = "page_id", html: str = "html",
                remove_chars: str = config.REMOVE_CHARS, dedup: bool = True,
                keep_empty: bool = False, implied_ends: bool = False) -> DataFrame:
    """``(key, pos, tag, text, html)``: the flattened body of every page
    (O-19), listed characters removed (O-18), repeated blocks dropped,
    first one kept (O-20), positions 0.. in document order.  With
    ``keep_empty`` a page without blocks has one empty paragraph; with
    ``implied_ends`` an open paragraph ends where the next block starts."""
    def fn(markup):
        b = H.tidy_blocks(markup, remove_chars, implied_ends)
        b = _dedup_first(b) if dedup else b
        first = next(b, ("p", "", "<p></p>") if keep_empty else None)
        return () if first is None else itertools.chain([first], b)
    return _block_job(pages, key, html, fn)


def scrape_blocks(pages: DataFrame, html_ids: list[str] | None = None,
                  key: str = "page_id", html: str = "html",
                  prefix: str = "(U) ") -> DataFrame:
    """``(key, pos, tag, text, html)``: headings (as ``h3``) and paragraphs
    inside the element with a listed id, prefixed (O-26)."""
    ids = list(config.SCRAPE_HTML_IDS if html_ids is None else html_ids)
    return _block_job(pages, key, html, lambda m: H.scrape_blocks(m, ids, prefix))


def fetched(pages: DataFrame, status: str = "status") -> DataFrame:
    """Landed pages that were fetched successfully (O-08): status 200 when
    the table has a status column, else every page with markup."""
    if status in pages.columns:
        return pages.where(F.col(status) == 200)
    return pages.where(F.col("html").isNotNull())


def output_name(url: str | Column = "url") -> Column:
    """File name of a scraped url (O-17)."""
    return T.url_file_name(url)


def remove_chars(c: str | Column, chars: str = config.REMOVE_CHARS) -> Column:
    """Delete the listed characters (O-18)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.translate(col, chars, "")


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    import html as _html
    return s.map(lambda x: None if x is None else _html.unescape(x))


def trim_description(c: str | Column) -> Column:
    """Feed description: unescape HTML entities (Arrow-batched Python, no
    built-in exists), then cut from the first ``<div`` (O-27)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(_unescape(col), r"(?s)<div.*", "")
