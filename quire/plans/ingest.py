"""The ingest job: landed HTML to rows of the ``document`` table.

files or pages -> block job (one map, no shuffle) -> memo parse (one
shuffle by document) -> records.  The portal ran these steps file by file
in one process; here each step is one distributed pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import blocks, memo
from quire.sources import files, tables


def records(pages: DataFrame, key: str, file_name, has_footer: bool = False,
            content_uid: bool = True, html: str = "html") -> DataFrame:
    """Document rows from ``pages(key, html)``; ``file_name`` is a column
    expression over ``key``.  With ``content_uid`` the uid is a hash of the
    key, so re-ingesting a file yields the same uid (upsert-safe); without
    it a random uid, as the portal did."""
    # A page without blocks keeps a row, with the placeholder body.
    b = blocks.page_blocks(pages.select(key, html), key=key, html=html, keep_empty=True)
    parsed = memo.parse(b, key=key, has_footer=has_footer)
    uid = F.sha2(F.col(key).cast("string"), 256) if content_uid else None
    return memo.to_records(parsed, file_name, uid=uid)


def records_from_files(files_df: DataFrame, has_footer: bool = False,
                       content_uid: bool = True) -> DataFrame:
    """Rows from ``(path, file_name, html)`` as read by ``sources.files``; the
    path tells files of one name apart."""
    return records(files_df.select("path", "html"), "path",
                   F.element_at(F.split(F.col("path"), "/", -1), -1),
                   has_footer=has_footer, content_uid=content_uid)


def ingest_folder(spark: SparkSession, folder: str, root: str, glob: str = "*",
                  has_footer: bool = False) -> None:
    """Read a folder of memos and upsert them into the document table."""
    new = records_from_files(files.read_html_files(spark, folder, glob), has_footer)
    rows = new
    if tables.exists(spark, root, "document"):
        old = tables.read_table(spark, root, "document")
        rows = tables.upsert(old, tables.conform(new, tables.DOCUMENT_SCHEMA), ["uid"])
    tables.replace_table(rows, root, "document")


def page_records(pages: DataFrame, has_footer: bool = False) -> DataFrame:
    """Rows from the ``pages`` table, named ``<page_id>.html``."""
    return records(pages.select("page_id", "html"), "page_id",
                   F.concat(F.col("page_id").cast("string"), F.lit(".html")),
                   has_footer=has_footer)
