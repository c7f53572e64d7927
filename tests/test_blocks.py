"""Goldens for the HTML block job (worked out from the parser rules)."""

from quire.functions import html as H
from quire.operators import blocks


def _tidy(*a, **k):
    return list(H.tidy_blocks(*a, **k))


def _scrape(*a, **k):
    return list(H.scrape_blocks(*a, **k))


def test_unclosed_p_holds_what_follows():
    got = _tidy("<body><p>a<p>b</p>c</p></body>")
    assert got == [("p", "abc", "<p>abc</p>"), ("p", "b", "<p>b</p>")]


def test_end_tag_without_open_element_is_ignored():
    got = _tidy("<body></p><h2> T </h2></b><p>x</p></body>")
    assert got == [("h2", "T", "<h2>T</h2>"), ("p", "x", "<p>x</p>")]


def test_list_block_holds_direct_children_and_walk_continues():
    got = _tidy("<body><ul>x<li>y</li><li> </li><p>z</p></ul></body>")
    assert got == [("ul", "xyz", "<ul><li>x</li><li>y</li><p>z</p></ul>"),
                   ("p", "z", "<p>z</p>")]


def test_nbsp_removed_and_empty_blocks_dropped():
    got = _tidy("<body><p>\xa0</p><p>a&nbsp;b</p><h1>  </h1></body>")
    assert got == [("p", "ab", "<p>ab</p>")]


def test_script_style_comment_are_not_text():
    got = _tidy('<body><p>a<script>var t="</p>";</script><!-- c -->b</p>'
                        "<style>p{}</style></body>")
    assert got == [("p", "ab", "<p>ab</p>")]


def test_void_elements_close_at_once():
    got = _tidy("<body><p>a<br>b<img src=x>c</p></body>")
    assert got == [("p", "abc", "<p>abc</p>")]


def test_text_outside_body_is_ignored():
    got = _tidy("<html><head><title>t</title></head><body><p>in</p></body></html>")
    assert got == [("p", "in", "<p>in</p>")]


def test_markup_in_text_is_escaped():
    got = _tidy("<body><p>a &lt;b&gt; &amp; c</p></body>")
    assert got == [("p", "a <b> & c", "<p>a &lt;b&gt; &amp; c</p>")]


def test_scrape_uses_last_listed_id_found_and_prefix():
    page = ('<div id="a"><p>first</p></div><div id="b"><h2>Head</h2><p>x</p>'
            "<p>body</p><script>s</script></div>")
    got = _scrape(page, ["a", "b"])
    assert got == [("h3", "(U) Head", "<h3>(U) Head</h3>"), ("p", "(U) body", "<p>(U) body</p>")]
    assert _scrape(page, ["zzz"]) == []


def test_description_cut():
    assert H.unescape_description("A &amp; B&lt;div class=x&gt;rest") == "A & B"


def test_page_blocks_job_dedups_in_order(spark):
    pages = spark.createDataFrame(
        [(1, "<body><p>x</p><p>y</p><p>x</p></body>"), (2, "<body><h1>t</h1></body>")],
        "page_id long, html string")
    rows = sorted(tuple(r) for r in blocks.page_blocks(pages).collect())
    assert rows == [(1, 0, "p", "x", "<p>x</p>"), (1, 1, "p", "y", "<p>y</p>"),
                    (2, 0, "h1", "t", "<h1>t</h1>")]


def test_page_blocks_over_given_pages(spark):
    from conftest import SF_SMALL
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    b = blocks.page_blocks(pages)
    n_pages = pages.count()
    per_page = b.groupBy("page_id").count()
    assert per_page.count() == n_pages
    # positions are 0..n-1 in every page
    bad = b.groupBy("page_id").agg({"pos": "max", "*": "count"}).where("`max(pos)` + 1 != `count(1)`")
    assert bad.count() == 0


def test_deep_and_unclosed_pages(spark):
    """Pages that a recursive walk cannot read."""
    deep = "<body><p>" + "<b>" * 5000 + "x" + "</b>" * 5000 + "</p></body>"
    assert _tidy(deep) == [("p", "x", "<p>x</p>")]
    open_ = "<body>" + "".join(f"<p>w{i} " for i in range(900))
    got = _tidy(open_)
    assert len(got) == 900 and got[0][1].split() == [f"w{i}" for i in range(900)] and got[-1][1] == "w899"
    assert [t for _, t, _ in _tidy(open_, implied_ends=True)] == [f"w{i}" for i in range(900)]
    assert [t for _, t, _ in _scrape("<div id=a>" + open_, ["a"], prefix="")] == [f"w{i} " for i in range(900)]
    stray = "<body>" + "<div>" * 8000 + "</i>" * 8000 + "<ul>a<li>b<ul><li>c</ul></ul>"
    assert _tidy(stray)[:2] == [("ul", "abc", "<ul><li>a</li><li>bc</li></ul>"), ("ul", "c", "<ul><li>c</li></ul>")]
    pages = spark.createDataFrame([(1, deep), (2, open_), (3, stray), (4, None), (5, "")], "page_id long, html string")
    n = {r[0]: r[1] for r in blocks.page_blocks(pages, keep_empty=True).groupBy("page_id").count().collect()}
    assert n == {1: 1, 2: 900, 3: 2, 4: 1, 5: 1}


def test_long_broken_pages_take_linear_time():
    import time
    for page in ("<div>" * 100_000 + "</p>" * 100_000, "<p><b>" * 100_000, "<ul><li>" * 50_000 + "x"):
        t = time.time()
        H.Page(page)
        assert time.time() - t < 20


def test_template_text_is_not_text():
    assert _tidy("<body><p>a<template><p>no</p></template>b</p></body>") == [("p", "ab", "<p>ab</p>")]
