"""Physical plan checks: pushdown, no nested loops, Python only where meant."""

from conftest import SF_SMALL
from quire import fixtures
from quire.operators import search, similarity, tfidf
from quire.plans import registry


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_equality_filter_pushed_to_parquet(spark):
    df = search.where_equal(fixtures.document(spark, SF_SMALL), "category", "en", k=5,
                            columns=["category", "uid"])
    p = _plan(df)
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in p
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in p


def test_similarity_has_no_nested_loop_or_python(spark):
    """The plans that are run: each step's input is a written table."""
    _, vectors = similarity.text_vectors(fixtures.document(spark, SF_SMALL))
    prefix = similarity.prefixes(vectors, 0.5)
    for df in (prefix, similarity.candidates(prefix, 0.5), similarity.cosine_join(vectors, 0.5)):
        p = _plan(df)
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "Arrow"):
            assert bad not in p


def test_entity_match_has_no_nested_loop(spark):
    p = _plan(registry.entity_matches(spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_on_demand_related_broadcasts_only_the_query_document(spark):
    p = _plan(similarity.related_on_demand(fixtures.document(spark, SF_SMALL), "7"))
    assert "BroadcastHashJoin" in p
    assert "CartesianProduct" not in p


def test_top_k_uses_take_ordered(spark):
    p = _plan(search.feed(fixtures.document(spark, SF_SMALL)))
    assert "TakeOrderedAndProject" in p


def test_tfidf_stays_in_jvm(spark):
    p = _plan(tfidf.tfidf(fixtures.document(spark, SF_SMALL), n_max=3))
    assert "Python" not in p and "ArrowEval" not in p
