"""Tables in the order of one column, read from its end (O-41, O-42, O-43).

The portal's lists want the newest few rows of a table of any size.  A table
written here is ranged by a column and has a bounds table, one row a file:
its least and greatest value and its rows.  ``last`` opens files from the
greatest value on, until the rows in them are sure to hold the k greatest;
all others stay unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files looked at first; doubled until they hold enough rows.
FIRST_FILES = 4


def write(df: DataFrame, path: str, by: str, ties: str = "uid") -> None:
    """Write ``df`` ranged and sorted by a column (ties by another, so one
    value that very many rows have is dealt out to several files)."""
    df.repartitionByRange(by, ties).sortWithinPartitions(by, ties).write.parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    (rows.groupBy(F.col("_metadata.file_path").alias("file"))
     .agg(F.min(by).alias("low"), F.max(by).alias("high"), F.count(F.lit(1)).alias("n"), F.count(by).alias("known"))
     .write.parquet(f"{path}/bounds"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def newest_files(spark: SparkSession, path: str, k: int) -> list[str] | None:
    """Files that hold the rows of the ``k`` greatest values and every row
    that ties with the last of them; None where rows without a value are
    among them, or the table has no more rows than k."""
    bounds = spark.read.parquet(f"{path}/bounds")
    m = FIRST_FILES
    while True:
        top = bounds.where("high is not null").orderBy(F.col("high").desc(), F.col("low").desc()).limit(m).collect()
        rows, floor = 0, None
        for f in top:
            rows, floor = rows + f["known"], f["low"] if floor is None else min(floor, f["low"])
            if rows >= k:
                # Files that reach the least value of these may tie with it.
                return [r["file"] for r in bounds.where(F.col("high") >= F.lit(floor)).select("file").collect()]
        if len(top) < m:
            return None
        m *= 2


def last(spark: SparkSession, path: str, by: str, k: int, ties: Column | str = "uid") -> DataFrame:
    """The ``k`` rows with the greatest values, ties by another column: the
    rows that ``orderBy(by desc, ties).limit(k)`` of the whole table gives."""
    files = newest_files(spark, path, k)
    df = read(spark, path)
    if files is not None:
        df = spark.read.schema(df.schema).parquet(*files)
    return df.orderBy(F.col(by).desc(), F.col(ties) if isinstance(ties, str) else ties).limit(k)
