"""Kept-up frequencies, date-ordered tables, Latin-1 scan, body by position."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.operators import memo, search, termstats, tfidf
from quire.sources import clustered, tables, versioned


def _docs(spark, texts):
    d = spark.createDataFrame([(u, t) for u, t in texts.items()], "uid string, full_text string")
    return tables.conform(d.withColumns({c: F.lit("x") for c in (
        "u_date", "classification", "from_bur", "from_auth", "title", "html", "file_name")}).withColumn(
            "has_attachments", F.lit(0)), tables.DOCUMENT_SCHEMA)


def test_frequencies_equal_a_full_count(spark, tmp_dir, monkeypatch):
    """Random new and changed documents; one batch stops halfway, one is replayed."""
    r = random.Random(4)
    state = {}
    termstats.create(spark, tmp_dir)
    for batch in range(3):
        new = {f"u{r.randrange(12)}": " ".join(r.choice("red green blue the yellow".split()) for _ in range(r.randrange(9)))
               for _ in range(6)}
        state |= new
        if batch == 1:
            def stop(*a, **k):
                raise RuntimeError("stopped")
            with monkeypatch.context() as m:
                m.setattr(versioned, "upsert", stop)
                with pytest.raises(RuntimeError):
                    termstats.ingest(_docs(spark, new), tmp_dir, "s", batch)
        termstats.ingest(_docs(spark, new), tmp_dir, "s", batch)
    termstats.ingest(_docs(spark, {"u0": "other words"}), tmp_dir, "s", 1)
    full = tfidf.postings(_docs(spark, state), n_max=3).groupBy("term").count()
    want = {tuple(x) for x in full.collect()}
    assert {tuple(x) for x in termstats.frequencies(spark, tmp_dir).collect()} == want
    termstats.compact(spark, tmp_dir)
    kept = versioned.read(spark, f"{tmp_dir}/terms")
    assert {tuple(x) for x in kept.collect()} == want and kept.count() == len(want)


def test_newest_rows_come_from_few_files(spark, tmp_dir):
    rows = [(f"u{i:04d}", f"2024-{1 + i % 12:02d}", "t") for i in range(2000)]
    df = spark.createDataFrame(rows, "uid string, day string, title string")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # tiny tables would be one file
    try:
        clustered.write(df, f"{tmp_dir}/a", "day")
    finally:
        spark.conf.set(coalesce, "true")
    every = clustered.read(spark, f"{tmp_dir}/a").inputFiles()
    assert len(every) >= 4
    for k in (1, 10, 170, 1999, 5000):
        got = [tuple(x) for x in clustered.last(spark, f"{tmp_dir}/a", "day", k).collect()]
        assert got == sorted(sorted(rows), key=lambda x: x[1], reverse=True)[:k]
    assert len(clustered.newest_files(spark, f"{tmp_dir}/a", 10)) <= 2
    assert clustered.newest_files(spark, f"{tmp_dir}/a", 5000) is None
    odd = spark.createDataFrame([("a", None, "x"), ("b", "2", "x"), ("c", None, "x")], df.schema)
    clustered.write(odd, f"{tmp_dir}/b", "day")
    assert [x[0] for x in clustered.last(spark, f"{tmp_dir}/b", "day", 1).collect()] == ["b"]
    assert [x[0] for x in clustered.last(spark, f"{tmp_dir}/b", "day", 3).collect()] == ["b", "a", "c"]


def test_body_from_a_position(spark):
    lines = ["one", "SUBJECT: x", "(U) two", "three", "END", "four"]
    b = spark.createDataFrame([(d, i, "p", t, f"<p>{t}</p>") for d, ls in ((1, lines), (2, lines[2:4])) for i, t in enumerate(ls)],
                              "doc_id long, pos int, tag string, text string, html string")
    def body(**kw):
        return {r["doc_id"]: r["full_text"] for r in memo.parse(b, has_header=False, **kw).collect()}
    assert body()[1] == "U two three END four" and body()[2].startswith("Could not locate")
    assert body(start=0) == {1: "one SUBJECT: x U two three END four", 2: "U two three"}
    assert body(start=3, end_regex="^END") == {1: "three", 2: ""}
