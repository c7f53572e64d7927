"""Goldens of rules mended after review: marks, clearances, scrape nesting,
files of one name, pages without blocks, table replacement, checkpoint folder."""

import os

import pytest

from quire import session
from quire.functions import html as H
from quire.operators import memo
from quire.plans import ingest
from quire.sources import files, tables


def test_mark_inside_a_word_stands_apart(spark):
    df = spark.createDataFrame([("alpha(U)beta",)], "text string")
    assert df.select(memo.mark_text("text")).first()[0] == "alpha U beta"


def test_clearances_start_at_the_first_line(spark):
    lines = ["SUBJECT: x", "Body", "Cleared: early", "between", "Approved: AF - Ann", "Cleared: late", "last"]
    b = spark.createDataFrame([(1, i, "p", t, f"<p>{t}</p>") for i, t in enumerate(lines)],
                              "doc_id long, pos int, tag string, text string, html string")
    row = memo.parse(b, key="doc_id", has_footer=True).first()
    assert row["clear_blob"] == ["early", "between", "Approved: AF - Ann", "Cleared: late", "last"]


def test_scrape_closes_an_open_paragraph():
    page = "<div id=a><p>One<p>Two<button>no</button><h2>Head</h2></div>"
    assert [t for _, t, _ in H.scrape_blocks(page, ["a"], prefix="")] == ["One", "Two", "Head"]


def test_files_of_one_name_and_pages_without_blocks(spark, tmp_dir):
    for d, body in (("a", "<p>first</p>"), ("b", "<p>second</p>"), ("c", "<div>no block</div>")):
        os.makedirs(os.path.join(tmp_dir, d))
        with open(os.path.join(tmp_dir, d, "m.htm"), "w") as f:
            f.write(body)
    rows = ingest.records_from_files(files.read_html_files(spark, tmp_dir, recursive=True)).collect()
    assert len(rows) == 3 and len({r["uid"] for r in rows}) == 3 and {r["file_name"] for r in rows} == {"m.htm"}


def test_replace_survives_a_stop_between_renames(spark, tmp_dir):
    def rows(*uids):
        return spark.createDataFrame([(u, u, 1.0) for u in uids], "uid_1 string, uid_2 string, score double")
    tables.replace_table(rows("a"), tmp_dir, "similar")
    path = os.path.join(tmp_dir, "similar")
    os.rename(path, path + ".prev")             # stopped before the new version was whole
    assert tables.read_table(spark, tmp_dir, "similar").count() == 1
    rows("b", "c").write.parquet(path + ".next")
    os.rename(path, path + ".prev")             # stopped between the two renames
    assert tables.read_table(spark, tmp_dir, "similar").count() == 2
    tables.replace_table(rows("d"), tmp_dir, "similar")
    assert [r.uid_1 for r in tables.read_table(spark, tmp_dir, "similar").collect()] == ["d"]
    assert not tables.exists(spark, tmp_dir, "other")


def test_errors_of_a_broken_table_come_out(spark, tmp_dir):
    os.makedirs(os.path.join(tmp_dir, "in"))
    with open(os.path.join(tmp_dir, "in", "m.htm"), "w") as f:
        f.write("<p>x</p>")
    os.makedirs(os.path.join(tmp_dir, "db", "document"))
    with open(os.path.join(tmp_dir, "db", "document", "part-0.parquet"), "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        ingest.ingest_folder(spark, os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "db"))
    assert os.listdir(os.path.join(tmp_dir, "db", "document")) == ["part-0.parquet"]


def test_no_local_checkpoint_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())
