"""Streams give the same rows as the batch jobs."""

import os
import shutil

from quire.plans import ingest
from quire.sources import files
from quire.streaming import ingest as stream_ingest
from quire.streaming import ledger
from conftest import SF_SMALL

MEMO = ("<html><body><p>SECRET May 1, 2014</p><p>Action Memo FOR The Secretary</p>"
        "<p>FROM: EAP - Jane Doe</p><p>SUBJECT: Talks</p><p>(U) Body {n} caf\xe9.</p>"
        "</body></html>")


def _land(folder, names):
    os.makedirs(folder, exist_ok=True)
    for i, n in enumerate(names):
        with open(os.path.join(folder, n), "w", encoding="latin-1") as f:
            f.write(MEMO.format(n=i))


def test_file_stream_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    _land(src, ["a.htm", "b.htm"])
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    q = stream_ingest.start(spark, src, out, ck)
    q.awaitTermination(120)
    _land(src, ["c.htm"])  # only the new file is processed next time
    q = stream_ingest.start(spark, src, out, ck)
    q.awaitTermination(120)
    streamed = spark.read.parquet(out)
    assert sorted(r["batch_id"] for r in streamed.collect()) == [0, 0, 1]
    batch = ingest.records_from_files(files.read_html_files(spark, src))
    cols = [c for c in batch.columns if c != "u_date"]
    assert {tuple(r) for r in streamed.select(cols).collect()} == \
        {tuple(r) for r in batch.select(cols).collect()}
    row = batch.where("file_name = 'a.htm'").collect()[0]
    assert row["title"] == "Talks" and row["full_text"] == "U Body 0 caf\xe9."


def test_ledger_stream_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "events")
    os.makedirs(src)
    shutil.copy(f"{SF_SMALL}/events.parquet", os.path.join(src, "part-0.parquet"))
    out, ck = os.path.join(tmp_dir, "ledger"), os.path.join(tmp_dir, "ck")
    q = ledger.start(spark, src, out, ck)
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    want = {tuple(r) for r in ledger.actions(spark.read.parquet(src)).collect()}
    assert got == want and len(got) == 1000
