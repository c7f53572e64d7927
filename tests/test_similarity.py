"""Similarity against a brute-force TF-IDF written with the standard
library, plus invariants of the pair table."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quire import config, fixtures
from quire.operators import index, ngrams, tfidf
from quire.operators import similarity as S


@pytest.fixture(scope="module")
def docs(spark):
    return fixtures.document(spark, SF_SMALL).select("uid", "full_text")


def _brute(rows):
    stop = set(config.english_stop_words())
    toks = {u: [t for t in re.findall(r"(?u)\b\w\w+\b", (x or "").lower()) if t not in stop]
            for u, x in rows}
    n = len(toks)
    df = Counter(t for ts in toks.values() for t in set(ts))
    vec = {}
    for u, ts in toks.items():
        w = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in Counter(ts).items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        vec[u] = {t: v / norm for t, v in w.items()} if norm else {}
    return vec


def _scores(vec):
    post, out = {}, Counter()
    for u, w in vec.items():
        for t, v in w.items():
            post.setdefault(t, []).append((u, v))
    for plist in post.values():
        for a, va in plist:
            for b, vb in plist:
                out[(a, b)] += va * vb
    return out


def _reps(rows):
    first = {}
    for u, x in sorted(rows):
        first.setdefault(x or "", u)
    return {u: first[x or ""] for u, x in rows}


TEXTS = (["red green blue"] * 6 + ["red green", "green blue", "blue red", "red", "red", "yellow green", "violet", "", None,
                                   "violet violet red", "common x1 x2", "common x1 x3 x3", "red the of and"])


def _frame(spark, texts):
    return spark.createDataFrame([(f"u{i:03d}", f"t {i}", t) for i, t in enumerate(texts)],
                                 "uid string, title string, full_text string").repartition(3)


@pytest.mark.parametrize("threshold,small", [(0.0, True), (0.3, False), (0.9, True)])
def test_join_above_a_threshold_equals_brute_force(spark, docs, threshold, small):
    for d in (_frame(spark, TEXTS) if small else docs,):
        rows = [(r["uid"], r["full_text"]) for r in d.collect()]
        reps = set(_reps(rows).values())
        want = {p: s for p, s in _scores(_brute(rows)).items() if reps.issuperset(p) and round(s, 9) >= threshold}
        got = {(r["uid_1"], r["uid_2"]): r["score"] for r in S.pair_table(d, threshold).collect()}
        assert set(got) == set(want)
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_text_classes(spark):
    d = _frame(spark, TEXTS)
    rows = [(r["uid"], r["full_text"]) for r in d.collect()]
    reps = _reps(rows)
    sizes = Counter(reps.values())
    assert {tuple(r) for r in S.text_classes(d).collect()} == {(u, c, sizes[c]) for u, c in reps.items()}


def test_a_term_in_every_document_makes_no_pairs(spark):
    texts = [f"common w{i} v{i}" for i in range(300)] + ["common w1 v1 more"]
    _, vectors = S.text_vectors(_frame(spark, texts))
    prefix = S.prefixes(vectors, 0.5)
    assert prefix.where("term = 'common'").count() == 0
    assert {tuple(r) for r in S.candidates(prefix, 0.5).collect()} == {("u001", "u300")}


def test_heavy_terms_stay_in_their_partitions(spark):
    """One term in every document: its rows are not sent to one task."""
    post = spark.range(40_000).selectExpr("cast(id as string) uid").selectExpr(
        "uid", "explode(array('everywhere', 'often', concat('w', cast(uid as int) % 9000))) term").withColumn(
        "tf", F.lit(1).cast("long")).repartition(8)
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    joined = tfidf.with_frequency(post, df, 120_000)
    per_task = joined.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert joined.count() == 120_000 and per_task < 2 * 80_000 / 8
    w = tfidf.weights(post, F.lit(40_000))
    assert w.count() == 120_000 and w.where("term = 'everywhere' and df <> 40000").isEmpty()


def _best(vec, rows, uid, k, cutoff):
    s = _scores(vec)
    hits = [(-round(v, 9), b) for (a, b), v in s.items() if a == uid and v < cutoff]
    return [(b, -v) for v, b in sorted(hits)[:k]]


@pytest.mark.parametrize("k,cutoff,small", [(3, 0.95, False), (5, 1.5, True), (40, 0.6, True)])
def test_index_search_equals_scoring_all(spark, docs, k, cutoff, small):
    for d, asked in (((_frame(spark, TEXTS), [f"u{i:03d}" for i in range(19)]) if small
                      else (docs, ["7", "42", "0", "111", "none"])),):
        rows = [(r["uid"], r["full_text"]) for r in d.collect()]
        vec = _brute(rows)
        found = index.search(index.build(d), spark.createDataFrame([(u,) for u in asked * 2], "uid string"), k, cutoff)
        got = {}
        for r in found.best.orderBy("uid_1", "rank").collect():
            got.setdefault(r["uid_1"], []).append((r["uid_2"], round(r["score"], 9)))
        assert got == {u: b for u in asked if u in vec and (b := _best(vec, rows, u, k, cutoff))}


def test_index_search_leaves_frequent_terms_unread(spark):
    texts = [f"common every where near{i // 4} near{i // 4} own{i}" for i in range(400)]
    idx = index.build(_frame(spark, texts))
    found = index.search(idx, spark.createDataFrame([("u008",)], "uid string"))
    assert [r["uid_2"] for r in found.best.orderBy("rank").collect()] == ["u009", "u010", "u011"]
    report = found.report.first()
    assert report["postings_all"] > 800 and report["postings_read"] < 20


def test_counts_and_highest_scores_equal_brute_force(spark, docs):
    for d, cutoff, k in ((docs, 0.99, 10), (_frame(spark, TEXTS), 0.4, 25)):
        rows = [(r["uid"], r["full_text"]) for r in d.collect()]
        s = _scores(_brute(rows))
        members, vectors = S.text_vectors(d)
        n = len(rows) ** 2
        assert tuple(S.pair_counts(members, vectors, cutoff).first()) == (n, n - sum(v >= cutoff for v in s.values()))
        want = sorted((round(v, 9) for v in s.values() if v < cutoff), reverse=True)[:k]
        assert [round(r[0], 9) for r in S.top_scores(members, vectors, cutoff, k).collect()] == want


def test_related_on_demand_equals_index(spark, docs):
    doc = fixtures.document(spark, SF_SMALL)
    idx = index.build(doc)
    for uid in ["42"]:
        a = {(r["uid"], round(r["score"], 9)) for r in S.related_on_demand(doc, uid).collect()}
        b = {(r["uid_2"], round(r["score"], 9)) for r in index.search(
            idx, spark.createDataFrame([(uid,)], "uid string")).best.collect()}
        assert a == b and a


def test_pruned_ngrams_hold_no_rare_part(spark, docs):
    rows = {r["uid"]: r["tokens"] for r in tfidf.tokenize(docs).collect()}
    df = [Counter(), Counter(), Counter()]
    for t in rows.values():
        for n in range(3):
            df[n].update({" ".join(t[i:i + n + 1]) for i in range(len(t) - n)})
    for lower in (2, 10):
        found = ngrams.levels(docs, "uid", "full_text", F.lit(lower))
        for n, level in enumerate(found):
            assert {tuple(r) for r in level.frequency.collect()} == {(t, c) for t, c in df[n].items() if c > lower}
            kept = {(r["uid"], g["pos"], g["term"]) for r in level.documents.collect() for g in r["grams"]}
            assert kept == {(u, i, g) for u, t in rows.items() for i in range(len(t) - n)
                            if df[n][g := " ".join(t[i:i + n + 1])] > lower}
        some = spark.createDataFrame([("7",), ("42",)], "uid string")
        for a, b in zip(found, ngrams.levels(docs, "uid", "full_text", F.lit(lower), only=some)):
            shown = {g["term"] for r in a.documents.where("uid in ('7', '42')").collect() for g in r["grams"]}
            assert {tuple(r) for r in b.frequency.collect()} == {
                tuple(r) for r in a.frequency.collect() if r["term"] in shown}


def test_levels_inside_rows_equal_joined_levels(spark, monkeypatch):
    rows = [("1", "red fox jumps, red fox sleeps"), ("2", "red fox sleeps now"), ("3", None), ("4", "blue fox sleeps")]

    def both(docs, **kw):
        return [(sorted((r["uid"] or "", *map(tuple, r["grams"])) for r in lv.documents.where("size(grams) > 0").collect()),
                 sorted(map(tuple, lv.frequency.collect()))) for lv in ngrams.levels(docs, "uid", "full_text", F.lit(1), **kw)]

    def frame(rows):
        return spark.createDataFrame(rows, "uid string, full_text string").repartition(2)

    only = frame([("2", "")]).select("uid")
    with monkeypatch.context() as m:
        m.setattr(ngrams, "LOOKED_UP_TERMS", 1)     # more terms than that are joined
        joined = both(frame(rows)), both(frame(rows), only=only)
    with monkeypatch.context() as m:
        # No row of words moves where every document has one row.
        m.setattr(ngrams, "_collected", lambda *_: pytest.fail("words were shuffled"))
        assert (both(frame(rows)), both(frame(rows), only=only)) == joined
    assert joined[0][2][1] == [("red fox sleeps", 2)]
    # Rows of one key are one document.
    twice = both(frame([("1", "red fox"), ("1", "blue dog"), ("2", "red fox"), (None, "blue fox"), (None, "red dog")]))
    assert [d[0] for d in twice[0][0]] == ["", "1", "2"]


def test_top_terms_band_and_ties(spark):
    d = spark.createDataFrame([(str(i), t) for i, t in enumerate(
        ["alpha beta", "alpha gamma", "beta gamma", "delta"] * 5)], "uid string, full_text string")
    w = tfidf.tfidf(d, n_max=1)
    top = tfidf.top_terms(w, tfidf.n_documents(d), lower=1, upper=10)
    got = {r["uid"]: r["top_terms_csv"] for r in top.collect()}
    # df: alpha 10, beta 10, gamma 10, delta 5 -> only delta inside (1, 10)
    assert got == {str(i): "delta" for i in range(3, 20, 4)}


def test_parity_raises_on_mismatch(spark):
    d = spark.createDataFrame([("a", "x y"), (None, "z")], "uid string, full_text string")
    with pytest.raises(Exception):
        tfidf.parity(d, tfidf.tokenize(d)).collect()


@pytest.mark.parametrize("cutoff", [0.95, 1.5])
def test_related_all_ranks_copies_by_uid(spark, cutoff):
    d = _frame(spark, TEXTS)
    rows = [(r["uid"], r["full_text"]) for r in d.collect()]
    vec = _brute(rows)
    members, vectors = S.text_vectors(d)
    got = {}
    for r in S.related_all(d, members, S.oriented(vectors, S.cosine_join(vectors, 0.0)), 3, cutoff).orderBy(
            "uid_1", "rank").collect():
        got.setdefault(r["uid_1"], []).append((r["uid"], round(r["score"], 9)))
    assert got == {u: b for u, _ in rows if (b := _best(vec, rows, u, 3, cutoff))}
