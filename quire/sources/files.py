"""Landed files as a source (O-01, O-51).

A folder of HTML files becomes ``(path, file_name, html)`` through Spark's
``binaryFile`` source: files are listed and read by the executors, the
bytes decoded as Latin-1 (the encoding the memos were saved in).  The
streaming form picks up only files not seen before, tracked in the
query's checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODING = "ISO-8859-1"
BINARY_FILE_SCHEMA = ("path string, modificationTime timestamp, length long, "
                      "content binary")


def _decode(df: DataFrame, encoding: str) -> DataFrame:
    return df.select(
        F.col("path"),
        F.element_at(F.split(F.col("path"), "/", -1), -1).alias("file_name"),
        F.decode(F.col("content"), encoding).alias("html"))


def read_html_files(spark: SparkSession, folder: str, glob: str = "*",
                    encoding: str = ENCODING, recursive: bool = False) -> DataFrame:
    """Every file of ``folder`` matching ``glob`` (O-01)."""
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
           .option("recursiveFileLookup", str(recursive).lower()).load(folder))
    return _decode(raw, encoding)


def stream_html_files(spark: SparkSession, folder: str, glob: str = "*",
                      encoding: str = ENCODING, max_files_per_trigger: int | None = None
                      ) -> DataFrame:
    """Streaming form of ``read_html_files``: new files only (O-51)."""
    r = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
         .option("pathGlobFilter", glob))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return _decode(r.load(folder), encoding)

