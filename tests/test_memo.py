"""Goldens for memo parsing edge cases."""

import pytest

from quire.operators import memo


def _blocks(spark, docs):
    rows = [(d, i, "p", t) for d, lines in docs.items() for i, t in enumerate(lines)]
    return spark.createDataFrame(rows, "doc_id long, pos int, tag string, text string")


def _parse(spark, docs, **kw):
    out = memo.parse(_blocks(spark, docs), has_footer=True, **kw)
    return {r["doc_id"]: r.asDict() for r in out.collect()}


FULL = [
    "UNCLASSIFIED December 26, 2012",
    "Information Memo FOR The Secretary",
    "FROM: EAP - Jane Doe and John Roe",
    "SUBJECT: Trade (and more): talks",
    "(U) First (SBU) paragraph.",
    "(C) Second  paragraph.",
    "Attachments: Tab 1",
    "Approved: EAP – Kurt Smith",
    "Drafted: EAP/J - Ann Lee, ext. 7-4567 and 202-647-4567",
    "Cleared: EAP/CM: BLee",
    "L - Counsel",
]


def test_full_memo(spark):
    r = _parse(spark, {1: FULL})[1]
    assert r["classification"] == "unclassified"  # "sensitive but" absent
    assert r["doc_date"] == "December 26, 2012"
    assert (r["category"], r["addressee"]) == ("Information Memo", "The Secretary")
    assert (r["from_bur"], r["from_auth"]) == ("EAP", "Jane Doe")  # co-author dropped
    assert r["title"] == "Trade (and more): talks"
    assert r["full_text"].startswith("U First SBU paragraph. C Second paragraph.")
    assert '<span class="label label-u">U</span> First' in r["html"]
    assert r["html"].startswith('<div class="document"> <p>')
    assert r["has_attachments"] == 1
    assert (r["approved_bur"], r["approved_name"]) == ("EAP", "Kurt Smith")  # en dash
    assert (r["draft_bur"], r["draft_name"]) == ("EAP/J", "Ann Lee")
    assert (r["draft_ext"], r["draft_phone"]) == ("7-4567", "202-647-4567")
    assert r["clear_blob"] == ["EAP/CM", "L - Counsel"]


def test_defects_give_unknown_and_defaults(spark):
    doc = ["SECRET", "A FOR B FOR C", "FROM: nobody", "SUBJECT:NoSpace", "text"]
    r = _parse(spark, {2: doc})[2]
    assert r["classification"] == "secret"
    assert r["doc_date"] == "unknown"
    assert (r["category"], r["addressee"]) == ("unknown", "unknown")
    assert (r["from_bur"], r["from_auth"]) == ("unknown", "unknown")
    assert r["title"] == "unknown"
    # no "^SUBJECT:" start line -> placeholder body
    assert r["full_text"] == "text" or r["full_text"].startswith("Could not locate")


def test_no_for_line_keeps_defaults_and_subject_with_for(spark):
    doc = ["CONFIDENTIAL", "FROM: A - B", "SUBJECT: plans FOR 2013", "body"]
    r = _parse(spark, {3: doc})[3]
    # the subject holds " FOR " so it is read as the addressee line
    assert (r["category"], r["addressee"]) == ("SUBJECT: plans", "2013")
    assert r["title"] == "unknown"
    assert r["full_text"] == "body"


def test_classification_order_and_first_block_only(spark):
    doc = ["SENSITIVE BUT UNCLASSIFIED May 1, 2014", "SECRET June 2, 2015", "SUBJECT: t", "b"]
    r = _parse(spark, {4: doc})[4]
    assert r["classification"] == "sensitive but unclassified"
    assert r["doc_date"] == "May 1, 2014"


def test_footer_needs_exactly_one_approval(spark):
    doc = ["SUBJECT: t", "b", "Approved: A - B", "Approved: C - D", "Cleared: X: Y", "Z"]
    r = _parse(spark, {5: doc})[5]
    assert r["approved_bur"] is None and r["clear_blob"] == []


def test_footer_off_gives_zero_attachments(spark):
    out = memo.parse(_blocks(spark, {6: ["SUBJECT: t", "Attachments: 1"]}), has_footer=False)
    r = out.collect()[0]
    assert r["has_attachments"] == 0 and r["clear_blob"] == []


def test_empty_document(spark):
    r = _parse(spark, {7: [""]})[7]
    assert r["classification"] == "unknown"
    assert r["full_text"].startswith("Could not locate start")


def test_dedup_keeps_first_and_renumbers(spark):
    b = _blocks(spark, {8: ["a", "b", "a", "c", "b"]})
    rows = [(r["pos"], r["text"]) for r in memo.dedup_blocks(b).orderBy("pos").collect()]
    assert rows == [(0, "a"), (1, "b"), (2, "c")]


def test_line_numbers(spark):
    b = _blocks(spark, {9: ["(U) a", "b", "(U) c"]})
    assert memo.line_numbers(b, r"^\(U\)").collect()[0]["positions"] == [0, 2]


def test_header_repair_splits_tags(spark):
    b = _blocks(spark, {10: ["SECRET May 1, 2014 FROM : EAP - X SUBJECT: Hi", "other"]})
    rows = [r["text"] for r in memo.repair_header(b).orderBy("pos", "sub").collect()]
    assert rows == ["SECRET May 1, 2014", "FROM: EAP - X", "SUBJECT: Hi"]


def test_records_have_document_columns(spark):
    from quire.sources import tables
    parsed = memo.parse(_blocks(spark, {11: FULL}), has_footer=True)
    rec = memo.to_records(parsed, "doc_id")
    assert rec.columns == [f.name for f in tables.DOCUMENT_SCHEMA.fields][:-1]
