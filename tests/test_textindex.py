"""Batch search through the gram index against LIKE as SQLite has it."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quire import fixtures
from quire.operators import search, textindex

TEXTS = ["Hello World", "hello\nworld", "50% off_now", "a\\b c\\%d", "ÄÖ straße", "äö Straße", "ab", "a", "", None, "aaaa",
         "xyz" * 50, "日本語のテキスト", "tab\there", "HELLO", "😀 smile"]
QUERIES = ["hello", "HELLO w", "lo_wo", "h%d", "%", "_", "__", "", "____", "a", "AB", "%%", "_%_%_", "50%", "f_n", "\\", "\\%",
           "b\\", "ß", "ÄÖ", "äö", "zxyz", "nowhere at all", "zz", "語の", "_b", "b_", "a%a", "\t", "\n", "😀", "_" * 140, "_" * 151,
           None, "l%o", "lo%lo"]


def _like(q, text):
    """One character for _, any run for %, A-Z equal a-z, nothing else."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    if q is None or text is None:
        return False
    pattern = "".join("." if c == "_" else ".*" if c == "%" else re.escape(c) for c in q.translate(fold))
    return re.search(pattern, text.translate(fold), re.S) is not None


@pytest.fixture(scope="module")
def frames(spark):
    doc = spark.createDataFrame([(f"u{i:02d}", f"2024-01-{1 + i % 9:02d}", t) for i, t in enumerate(TEXTS)],
                                "uid string, u_date string, full_text string").repartition(3)
    for c in ("doc_date", "title", "from_auth", "from_bur"):
        doc = doc.withColumn(c, F.concat(F.lit(c), "uid"))
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "qid long, q string")
    return doc, textindex.build(doc), queries


def test_matches_equal_like(spark, frames):
    got = {tuple(r) for r in textindex.matches(*frames).collect()}
    assert got == {(i, f"u{j:02d}") for i, q in enumerate(QUERIES) for j, t in enumerate(TEXTS) if _like(q, t)}
    few = textindex.candidates(frames[1], frames[2])
    n = {i: few.where(F.col("qid") == i).count() for i in (0, 16, 22)}
    assert n[0] == 3 and n[16] == 1 and n[22] == 0


def test_batch_equals_single_searches(spark, frames):
    doc, index, queries = frames
    got = {}
    for r in textindex.search_batch(doc, index, queries, k=3).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["uid"], r["title"], r["preview"]))
    for i in (0, 4, 8, 9, 15):
        want = [(r["uid"], r["title"], r["preview"]) for r in search.search(doc, QUERIES[i], k=3).collect()]
        assert sorted(got.get(i, [])) == sorted(want)


def test_given_documents(spark):
    doc = fixtures.document(spark, SF_SMALL)
    queries = fixtures.search_queries_view(fixtures.read(spark, SF_SMALL, "benchmark"))
    texts = {r["uid"]: r["full_text"] for r in doc.select("uid", "full_text").collect()}
    got = {tuple(r) for r in textindex.matches(doc, textindex.build(doc), queries).collect()}
    want = {(r["qid"], u) for r in queries.collect() for u, t in texts.items() if _like(r["q"], t)}
    assert got == want and len(want) > 100


def test_index_is_lists_of_blocks(spark, monkeypatch):
    """A gram is a row for each block of texts, not for each text."""
    doc = spark.createDataFrame([(f"u{i:02d}", t) for i, t in enumerate(TEXTS)], "uid string, full_text string").coalesce(1)
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = {(t.translate(fold)[i:i + n], f"u{j:02d}") for j, t in enumerate(TEXTS) if t
            for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    for most in (2_000_000, 30, 1):
        monkeypatch.setattr(textindex, "BLOCK_CHARS", most)
        index = textindex.build(doc)
        rows = [r for r in index.postings.collect() if len(r["gram"]) < 4]
        assert all(r["docs"] == len(set(r["uids"])) == len(r["uids"]) for r in rows)
        assert {(r["gram"], u) for r in rows for u in r["uids"]} == want and sum(r["docs"] for r in rows) == len(want)
        assert (len({r["gram"] for r in rows}) == len(rows)) == (most > 30)
        assert {r["gram"]: r["df"] for r in index.grams.collect()}["size"] == len(TEXTS) - 1


def test_grams_of_an_alphabet_too_large_for_one_array():
    texts = ["".join(map(chr, range(0x20000, 0x50000))), "\0a"] + ["ab", ""] * 800
    grams, counts, at = textindex.text_grams(texts)
    places = {}
    for gram, end, n in zip(grams, counts.cumsum(), counts):
        places.setdefault(gram, []).extend(at[end - n:end].tolist())
    assert places["size"] == list(range(len(texts))) and places["ab"] == list(range(2, len(texts), 2))
    assert places["\0a"] == [1] and places[texts[0][7:10]] == [0]


def test_runs_stand_in_order(spark):
    doc = spark.createDataFrame([("a", "2024-01-01", "one two one"), ("b", "2024-01-01", "two one"), ("c", "2024-01-01", "oneone")],
                                "uid string, u_date string, full_text string")
    q = spark.createDataFrame([(1, "one%two"), (2, "two%one"), (3, "one%one"), (4, "%one%%o_e"), (5, "neon%neon")], "qid long, q string")
    got = {tuple(r) for r in textindex.matches(doc, textindex.build(doc), q).collect()}
    assert got == {(1, "a"), (2, "a"), (2, "b"), (3, "a"), (3, "c"), (4, "a"), (4, "c")}
