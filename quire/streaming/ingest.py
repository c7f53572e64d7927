"""Streaming ingest: new HTML files to parsed document rows (O-51 + O-19..O-24).

Each micro-batch goes through the same batch functions as the one-shot
ingest (``quire.plans.ingest``) inside ``foreachBatch``; the block job is a
per-file map and the memo parse groups by file, so every batch is
self-contained and no state crosses batches.  Output goes to a Parquet
table; the checkpoint makes a restarted query skip files already
done, and each micro-batch overwrites its own ``batch_id=N`` partition, so
a batch replayed after a failure replaces its rows instead of adding them
again (exactly-once output).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.sources import files, tables, versioned


def start(spark: SparkSession, folder: str, table_path: str, checkpoint: str,
          glob: str = "*", has_footer: bool = False, available_now: bool = True,
          content_uid: bool = True) -> StreamingQuery:
    """Start the ingest stream; with ``available_now`` it processes what is
    there and stops (incremental batch runs)."""
    from quire.plans import ingest

    src = files.stream_html_files(spark, folder, glob)

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = ingest.records_from_files(batch, has_footer=has_footer,
                                         content_uid=content_uid)
        rows.write.mode("overwrite").parquet(f"{table_path}/batch_id={batch_id}")

    return _started(src, each, checkpoint, available_now)


def start_table(spark: SparkSession, folder: str, root: str, checkpoint: str,
                glob: str = "*", has_footer: bool = False, available_now: bool = True,
                stream: str | None = None) -> StreamingQuery:
    """The same into the ``document`` table below ``root``, kept in versions
    and made if it is not there (O-51 with O-05).

    Rows are merged by uid, which follows from the file, so a file that
    lands again replaces its row.  The batch's number is committed together
    with its rows, under the name ``stream`` (default: the checkpoint's): a
    batch that is replayed after a stop changes nothing."""
    from quire.plans import ingest

    path, name = f"{root}/document", stream or checkpoint
    if not versioned.latest(spark, path):
        versioned.create(spark, path, tables.DOCUMENT_SCHEMA, ["uid"])

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = ingest.records_from_files(batch, has_footer=has_footer, content_uid=True)
        versioned.upsert(tables.conform(rows, tables.DOCUMENT_SCHEMA), path, name, batch_id)

    return _started(files.stream_html_files(spark, folder, glob), each, checkpoint, available_now)


def _started(src: DataFrame, each, checkpoint: str, available_now: bool) -> StreamingQuery:
    w = src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
