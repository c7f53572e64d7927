"""What was left open of the findings of round 3, on rows made here."""

import pytest
from pyspark.sql import functions as F

from quire.operators import entities as E
from quire.operators import index, tfidf
from quire.operators import similarity as S
from quire.session import written
from test_similarity import TEXTS, _best, _brute, _frame


@pytest.mark.parametrize("bounded", [False, True])
def test_pieces_of_texts_are_sifted_before_they_are_shuffled(spark, bounded):
    docs = spark.createDataFrame([("1", "in the D-MR, AF and Niger.")], "uid string, full_text string")
    keys = spark.createDataFrame([("x", k, k, "u") for k in ("D-MR", "AF", "ge")],
                                 "kind string, key string, name string, url string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = E.match_substring(docs, keys, bounded=bounded)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {r["entity_key"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {"D-MR", "AF"} | (set() if bounded else {"ge"})
    dealt = [p for p in plan.split("Exchange hashpartitioning(")[1:] if p.startswith("_piece")]
    assert dealt and all("LeftSemi" in p[:p.index("Generate")] for p in dealt if "Generate" in p)


def test_weighing_shuffles_no_posting_of_a_frequent_term(spark):
    """Texts and norms are dealt by document; postings stay where they are."""
    d = spark.range(200).selectExpr("cast(id as string) uid", "concat('common words ', id) full_text")
    plan = tfidf.tfidf(d)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    got = tfidf.tfidf(d).where("term = 'common'").agg(F.min("weight"), F.max("weight"), F.count("*")).first()
    assert got[2] == 200 and 0 < got[0] and got[1] < 1


def test_a_null_key_is_weighed_like_any_other(spark):
    d = spark.createDataFrame([(None, "one two two"), ("a", "one two two"), ("b", None), ("c", "")],
                              "uid string, full_text string")
    got = {(r["uid"], r["term"]): r["weight"] for r in tfidf.tfidf(d).collect()}
    assert len(got) == 4
    for t in ("one", "two"):
        assert got[None, t] == pytest.approx(got["a", t])
    assert sum(got["a", t] ** 2 for t in ("one", "two")) == pytest.approx(1)


@pytest.mark.parametrize("k,cutoff", [(3, 0.95), (40, 1.5)])
def test_many_queries_meet_the_vectors_in_blocks(spark, monkeypatch, k, cutoff):
    """No table of every two texts is written; the best are those of scoring all."""
    monkeypatch.setattr(index, "MANY_TIMES", 0)
    monkeypatch.setattr(S, "BLOCK_POSTINGS", 7)
    monkeypatch.setattr(S, "DEALT_POSTINGS", 5)
    named = []
    monkeypatch.setattr(index, "written", lambda df, name: named.append(name) or written(df, name))
    d = _frame(spark, TEXTS)
    rows = [(r["uid"], r["full_text"]) for r in d.collect()]
    vec, got = _brute(rows), {}
    found = index.search(index.build(d), d.select("uid"), k, cutoff)
    for r in found.best.orderBy("uid_1", "rank").collect():
        got.setdefault(r["uid_1"], []).append((r["uid_2"], round(r["score"], 9)))
    assert got == {u: b for u, _ in rows if u in vec and (b := _best(vec, rows, u, k, cutoff))}
    assert "search-scores" not in named
