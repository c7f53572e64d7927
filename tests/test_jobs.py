"""The two jobs that write tables: analysis and folder ingest."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from quire import fixtures
from quire.operators import similarity as S
from quire.plans import analysis, ingest
from quire.sources import tables

MEMO = ("<html><body><p>CONFIDENTIAL June 3, 2015</p><p>Action Memo FOR The Secretary</p>"
        "<p>FROM: AF - Ann Lee</p><p>SUBJECT: Visit {n}</p><p>(U) Text {n}.</p></body></html>")


def test_analysis_run_writes_pairs_and_top_terms(spark, tmp_dir):
    doc = fixtures.document(spark, SF_SMALL)
    tables.init_tables(spark, tmp_dir)
    analysis.run(doc, tmp_dir)
    analysis.run(doc, tmp_dir)  # a re-run replaces scores, it does not add rows
    sim = tables.read_table(spark, tmp_dir, "similar")
    assert sim.count() == S.pair_table(doc).count()
    stored = tables.read_table(spark, tmp_dir, "document")
    assert stored.count() == doc.count()
    assert stored.where(F.col("top_terms").isNull()).count() == 0
    want = {r["uid"]: r["top_terms"] for r in analysis.document_top_terms(doc).collect()}
    got = {r["uid"]: r["top_terms"] for r in stored.select("uid", "top_terms").collect()}
    assert got == want


def test_ingest_folder_upserts_by_file(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    for i in range(3):
        with open(os.path.join(src, f"m{i}.htm"), "w", encoding="latin-1") as f:
            f.write(MEMO.format(n=i))
    root = os.path.join(tmp_dir, "db")
    ingest.ingest_folder(spark, src, root)
    ingest.ingest_folder(spark, src, root)  # same files again: same uids, no duplicates
    rows = tables.read_table(spark, root, "document").collect()
    assert len(rows) == 3
    assert {r["title"] for r in rows} == {"Visit 0", "Visit 1", "Visit 2"}
    assert {r["from_bur"] for r in rows} == {"AF"}
    assert all(r["classification"] == "confidential" for r in rows)
