"""Memo parsing over a block table (O-15, O-16, O-20..O-25, O-28).

Input: ``(key, pos, tag, text[, html])`` — the ordered blocks of each
document (see ``quire.operators.blocks``).  Every rule is a column
expression; per-document positions (start of body, approval line, first
clearance) are window aggregates over the document, and all fields come
out of one ``groupBy(key)`` that reuses the window's partitioning, so the
whole parse costs one shuffle by document.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import config

# --- fixed values: patterns of the memo format ---
DATE_PATTERN = r"[JFMASOND][a-z]* [0-9]*, [0-9]..."
DASH_SPLIT = " [-–] "
EXT_PATTERN = r"[0-9]-[0-9]..."
PHONE_PATTERN = r"[0-9]..-[0-9]..-[0-9]..."
START_PATTERN = "^SUBJECT:"
# Header repair: (pattern, tag), applied in this order (last header tag first).
REPAIR_PATTERNS = ([(r"SUBJECT\s?:", "SUBJECT:"), (r"FROM\s?:", "FROM:")]
                   + [(c.upper(), c.upper()) for c in config.CLASSIFICATIONS])
# --- end of fixed values ---



def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pystrip(c: str | Column) -> Column:
    """Strip leading and trailing whitespace (not only spaces)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def escape_html(c: str | Column) -> Column:
    return F.replace(F.replace(F.replace(_c(c), F.lit("&"), F.lit("&amp;")),
                               F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def block_html(tag: str | Column = "tag", text: str | Column = "text") -> Column:
    """Markup of a plain block: ``<tag>escaped text</tag>``."""
    t = _c(tag)
    return F.concat(F.lit("<"), t, F.lit(">"), escape_html(text), F.lit("</"), t, F.lit(">"))


def with_html(blocks: DataFrame) -> DataFrame:
    return blocks if "html" in blocks.columns else blocks.withColumn("html", block_html())


# ---------------------------------------------------------------- O-20, O-21

def dedup_blocks(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ordered de-duplication within a document, first wins (O-20); the
    kept blocks are renumbered 0.. in order.  Blocks are hash-partitioned by
    document once; the de-duplication, the renumbering window and a later
    parse by document all reuse that partitioning."""
    b = with_html(blocks).repartition(key)
    first = b.groupBy(key, "tag", "html").agg(F.min("pos").alias("pos"),
                                              F.first("text").alias("text"))
    w = Window.partitionBy(key).orderBy("pos")
    return first.select(key, (F.row_number().over(w) - 1).cast("int").alias("pos"),
                        "tag", "text", "html")


def line_numbers(blocks: DataFrame, regex: str, key: str = "doc_id") -> DataFrame:
    """Positions of the blocks whose text matches ``regex``, ascending, per
    document that has any (O-21)."""
    hits = blocks.where(F.col("text").rlike(regex))
    return hits.groupBy(key).agg(F.sort_array(F.collect_list("pos")).alias("positions"))


# ---------------------------------------------------------------- O-25

def paragraph_mark(text: str | Column = "text",
                   marks: list[str] = config.PARA_MARKINGS) -> Column:
    """The paragraph mark a block starts with, or null."""
    alt = "|".join(marks)
    m = F.regexp_extract(_c(text), rf"^\(({alt})\)", 1)
    return F.when(m == "", F.lit(None)).otherwise(m)


def mark_spans(html: str | Column, marks: list[str] = config.PARA_MARKINGS) -> Column:
    """Every ``(MARK)`` becomes a labelled span, marks in order (O-25)."""
    out = _c(html)
    for m in marks:
        out = F.regexp_replace(out, rf"\({m}\)",
                               f'<span class="label label-{m.lower()}">{m}</span>')
    return out


def mark_text(text: str | Column, marks: list[str] = config.PARA_MARKINGS) -> Column:
    """Text as rendered after ``mark_spans``: ``(MARK)`` reads ``MARK`` with a
    space on both sides, as the span's text stands apart from its neighbours."""
    out = _c(text)
    for m in marks:
        out = F.regexp_replace(out, rf"\({m}\)", f" {m} ")
    return out


# ---------------------------------------------------------------- O-22

def _classification(text: Column) -> Column:
    low = F.lower(text)
    expr = None
    for c in config.CLASSIFICATIONS:
        cond = F.instr(low, c) > 0
        expr = F.when(cond, F.lit(c)) if expr is None else expr.when(cond, F.lit(c))
    return expr


def _nonempty(c: Column) -> Column:
    return F.when(c == "", F.lit(None)).otherwise(c)


def _exactly(parts: Column, n: int, i: int) -> Column:
    return F.when(F.size(parts) == n, F.try_element_at(parts, F.lit(i)))


def _header_items(text: Column) -> dict[str, Column]:
    is_for = F.instr(text, " FOR ") > 0
    is_from = ~is_for & text.startswith("FROM:")
    is_subject = ~is_for & ~is_from & text.startswith("SUBJECT:")
    for_parts = F.split(text, " FOR ", -1)
    seg = F.try_element_at(F.split(text, "FROM:", -1), F.lit(2))
    from_parts = F.split(pystrip(F.replace(seg, F.lit(" and "), F.lit(" - "))), DASH_SPLIT, -1)
    colon = F.instr(text, ": ")
    return {
        "cls": _classification(text),
        "date": _nonempty(F.regexp_extract(text, DATE_PATTERN, 0)),
        "is_for": is_for, "is_from": is_from, "is_subject": is_subject,
        "category": _exactly(for_parts, 2, 1),
        "addressee": _exactly(for_parts, 2, 2),
        "from_bur": F.when(F.size(from_parts) >= 2,
                           pystrip(F.try_element_at(from_parts, F.lit(1)))),
        "from_auth": F.when(F.size(from_parts) >= 2,
                            pystrip(F.try_element_at(from_parts, F.lit(2)))),
        "title": F.when(colon > 0, pystrip(F.substr(text, colon + 2))),
    }


def header_aggregates(header_lines: int = config.HEADER_LINES) -> dict[str, Column]:
    """Aggregates of the header fields over a document's blocks (O-22):
    classification and its date from the first block (of the first
    ``header_lines``) naming a classification; category/addressee, FROM and
    SUBJECT from the last block of each kind (tested in that order, so a
    subject holding " FOR " reads as an addressee line)."""
    it = _header_items(F.col("text"))
    hdr = F.col("pos") < header_lines
    cls = F.min(F.when(hdr & it["cls"].isNotNull(),
                       F.struct(F.col("pos"), it["cls"].alias("v"), it["date"].alias("d"))))
    fr = F.max(F.when(hdr & it["is_for"], F.struct(
        F.col("pos"), it["category"].alias("a"), it["addressee"].alias("b"))))
    fm = F.max(F.when(hdr & it["is_from"], F.struct(
        F.col("pos"), it["from_bur"].alias("a"), it["from_auth"].alias("b"))))
    sj = F.max(F.when(hdr & it["is_subject"], F.struct(F.col("pos"), it["title"].alias("a"))))
    return {"_cls": cls, "_for": fr, "_from": fm, "_subj": sj}


def header_fields() -> list[Column]:
    """Final header columns from ``header_aggregates``, with the defaults
    and ``unknown`` for what is missing (O-16)."""
    unk = F.lit(config.UNKNOWN)
    return [
        F.coalesce(F.col("_cls.v"), unk).alias("classification"),
        F.coalesce(F.col("_cls.d"), unk).alias("doc_date"),
        F.when(F.col("_for").isNull(), F.lit(config.DEFAULT_ADDRESSEE))
        .otherwise(F.coalesce(F.col("_for.b"), unk)).alias("addressee"),
        F.when(F.col("_for").isNull(), F.lit(config.DEFAULT_CATEGORY))
        .otherwise(F.coalesce(F.col("_for.a"), unk)).alias("category"),
        F.coalesce(F.col("_from.a"), unk).alias("from_bur"),
        F.coalesce(F.col("_from.b"), unk).alias("from_auth"),
        F.coalesce(F.col("_subj.a"), unk).alias("title"),
    ]


HEADER = ["classification", "doc_date", "addressee", "category", "from_bur",
          "from_auth", "title"]
FOOTER = ["has_attachments", "attach_urls", "approved_bur", "approved_name", "draft_bur",
          "draft_name", "draft_ext", "draft_phone", "clear_blob"]


def parse_header(blocks: DataFrame, key: str = "doc_id",
                 header_lines: int = config.HEADER_LINES) -> DataFrame:
    """Header fields per document (O-22, O-16)."""
    agg = blocks.where(F.col("pos") < header_lines).groupBy(key).agg(
        *[v.alias(k) for k, v in header_aggregates(header_lines).items()])
    return agg.select(key, *header_fields())


# ---------------------------------------------------------------- O-23, O-24

def _positions(blocks: DataFrame, key: str, start_regex: str,
               end_regex: str | None, start: int | None = None) -> DataFrame:
    w = Window.partitionBy(key)
    t = F.col("text")
    approved = t.startswith("Approved:")
    # The body begins behind the start line; a given start is its first block.
    begin = (F.min(F.when(t.rlike(start_regex), F.col("pos"))).over(w) if start is None
             else F.lit(start - 1))
    b = blocks.select(
        "*",
        begin.cast("int").alias("_start"),
        (F.min(F.when(t.rlike(end_regex), F.col("pos"))).over(w) if end_regex
         else F.lit(None).cast("int")).alias("_end"),
        F.count(F.when(approved, 1)).over(w).alias("_n_appr"),
        F.min(F.when(approved, F.col("pos"))).over(w).alias("_appr"),
    )
    cleared = t.startswith("Cleared:") & (F.col("pos") >= F.col("_appr"))
    # A clearance line from the approval on opens the list, which starts at
    # the document's first such line, even one before the approval.
    return b.select("*", F.min(F.when(cleared, F.col("pos"))).over(w).alias("_clr"),
                    F.min(F.when(t.startswith("Cleared:"), F.col("pos"))).over(w).alias("_clr0"))


def body_aggregates() -> dict[str, Column]:
    in_body = (F.col("_start").isNotNull() & (F.col("pos") > F.col("_start"))
               & (F.col("_end").isNull() | (F.col("pos") < F.col("_end"))))
    item = F.struct(F.col("pos"), mark_spans("html").alias("h"), mark_text("text").alias("t"))
    return {"_body": F.sort_array(F.collect_list(F.when(in_body, item))),
            "_has_start": F.max(F.col("_start").isNotNull())}


def body_fields(html_class: str = config.HTML_CLASS) -> list[Column]:
    """``full_text`` (block texts, marks as words, single spaces) and
    ``html`` (blocks with mark spans inside the document div) (O-23)."""
    placeholder_html = F.lit(config.NO_START_BODY)
    placeholder_text = F.lit(re.sub("<[^>]*>", "", config.NO_START_BODY))
    htmls = F.transform("_body", lambda s: s["h"])
    texts = F.transform("_body", lambda s: s["t"])
    div_open, div_close = f'<div class="{html_class}">', "</div>"
    html = F.when(F.col("_has_start"), F.array_join(htmls, " ")).otherwise(placeholder_html)
    text = F.when(F.col("_has_start"), F.array_join(texts, " ")).otherwise(placeholder_text)
    return [pystrip(F.regexp_replace(text, r"\s+", " ")).alias("full_text"),
            F.concat_ws(" ", F.lit(div_open), html, F.lit(div_close)).alias("html")]


def footer_aggregates() -> dict[str, Column]:
    t = F.col("text")
    one = F.col("_n_appr") == 1
    appr_seg = F.try_element_at(F.split(t, ":", -1), F.lit(2))
    appr_parts = F.split(appr_seg, DASH_SPLIT, -1)
    data = F.substr(t, F.instr(t, ":") + 1)
    data_parts = F.split(data, ",", -1)
    person = F.split(F.try_element_at(data_parts, F.lit(1)), DASH_SPLIT, -1)
    contact = F.try_element_at(data_parts, F.lit(2))
    ext = _nonempty(F.regexp_extract(contact, EXT_PATTERN, 0))
    phone = _nonempty(F.regexp_extract(contact, PHONE_PATTERN, 0))
    drafted_ok = ((F.size(data_parts) == 2) & (F.size(person) == 2)
                  & ext.isNotNull() & phone.isNotNull())
    is_drafted = (one & t.startswith("Drafted:") & (F.col("pos") >= F.col("_appr"))
                  & (F.col("_clr").isNull() | (F.col("pos") < F.col("_clr"))))
    clr_first = F.try_element_at(F.split(t, ": ", -1), F.lit(2))
    return {
        "_att": F.max(t.startswith("Attachments:").cast("int")),
        "_appr_f": F.max(F.when(one & (F.col("pos") == F.col("_appr")) & (F.size(appr_parts) == 2),
                                F.struct(pystrip(F.try_element_at(appr_parts, F.lit(1))).alias("a"),
                                         pystrip(F.try_element_at(appr_parts, F.lit(2))).alias("b")))),
        "_draft_f": F.max(F.when(is_drafted & drafted_ok, F.struct(
            F.col("pos"),
            pystrip(F.try_element_at(person, F.lit(1))).alias("bur"),
            pystrip(F.try_element_at(person, F.lit(2))).alias("name"),
            ext.alias("ext"), phone.alias("phone")))),
        "_clr_list": F.sort_array(F.collect_list(F.when(
            one & F.col("_clr").isNotNull() & (F.col("pos") >= F.col("_clr0")),
            F.struct(F.col("pos"), F.when(F.col("pos") == F.col("_clr0"), clr_first)
                     .otherwise(t).alias("t"))))),
    }


def footer_fields() -> list[Column]:
    clr = F.filter(F.transform("_clr_list", lambda s: s["t"]), lambda x: x.isNotNull())
    return [
        F.coalesce(F.col("_att"), F.lit(0)).cast("int").alias("has_attachments"),
        F.lit(None).cast("string").alias("attach_urls"),
        F.col("_appr_f.a").alias("approved_bur"), F.col("_appr_f.b").alias("approved_name"),
        F.col("_draft_f.bur").alias("draft_bur"), F.col("_draft_f.name").alias("draft_name"),
        F.col("_draft_f.ext").alias("draft_ext"), F.col("_draft_f.phone").alias("draft_phone"),
        clr.alias("clear_blob"),
    ]


def parse(blocks: DataFrame, key: str = "doc_id", has_header: bool = True,
          has_footer: bool = False, start_regex: str = START_PATTERN,
          end_regex: str | None = None, html_class: str = config.HTML_CLASS,
          header_lines: int = config.HEADER_LINES, start: int | None = None) -> DataFrame:
    """One row per document: header, body and footer fields (O-22..O-24c).

    The body begins behind the first line that matches ``start_regex``, or,
    if ``start`` is given, with the block of that position, whatever it says.

    Without header the header columns are null; without footer
    ``has_attachments`` is 0 and the other footer fields null, as the
    portal's record builder does."""
    b = _positions(with_html(blocks), key, start_regex, end_regex, start)
    aggs = dict(body_aggregates())
    if has_header:
        aggs.update(header_aggregates(header_lines))
    if has_footer:
        aggs.update(footer_aggregates())
    g = b.groupBy(key).agg(*[v.alias(k) for k, v in aggs.items()])
    null = F.lit(None).cast("string")
    hdr = header_fields() if has_header else [null.alias(c) for c in HEADER]
    ftr = footer_fields() if has_footer else (
        [F.lit(0).cast("int").alias("has_attachments")]
        + [null.alias(c) for c in FOOTER[1:-1]]
        + [F.array().cast("array<string>").alias("clear_blob")])
    return g.select(key, *hdr, *body_fields(html_class), *ftr)


# ---------------------------------------------------------------- O-15

def to_records(parsed: DataFrame, file_name: str | Column, uid: Column | None = None,
               today: Column | None = None) -> DataFrame:
    """Rows of the ``document`` table from parsed memos (O-15): a new
    ``uid`` (random by default; pass a content hash for idempotent
    re-runs), today's ``u_date``, the clearance list as JSON text."""
    uid = F.expr("uuid()") if uid is None else uid
    today = F.date_format(F.current_date(), "yyyy-MM-dd") if today is None else today
    return parsed.select(
        uid.alias("uid"), today.alias("u_date"), "doc_date", "addressee", "classification",
        "category", "from_bur", "from_auth", "title", "full_text", "html",
        _c(file_name).alias("file_name"), *[F.col(c) for c in FOOTER[:-1]],
        F.to_json("clear_blob").alias("clear_blob"))


# ---------------------------------------------------------------- O-28

def repair_header(blocks: DataFrame, key: str = "doc_id", header_len: int = 3,
                  patterns: list[tuple[str, str]] | None = None) -> DataFrame:
    """Split header lines that hold several header tags into one block per
    tag (O-28).  For each of the first ``header_len`` blocks the patterns
    are tried in order; a match cuts the line, the part after it becomes
    ``<tag> <rest>`` and the part before is searched further.  Pieces come
    out in reverse order of the patterns (the list runs last tag first);
    text before the first match and lines without any match are dropped.
    Off by default in the parse; returns ``(key, pos, sub, text)``.

    Each step is its own projection, so the remainder is computed once per
    step instead of being inlined into an ever-growing expression."""
    pats = REPAIR_PATTERNS if patterns is None else patterns
    df = blocks.where(F.col("pos") < header_len).select(key, "pos", F.col("text").alias("_rem"))
    names = []
    for j, (pat, tag) in enumerate(pats):
        rem = F.col("_rem")
        found = rem.rlike(pat)
        after = F.regexp_extract(rem, rf"(?s)^.*?(?:{pat})(.*)$", 1)
        before = F.regexp_extract(rem, rf"(?s)^(.*?)(?:{pat})", 1)
        name = f"_p{j}"
        names.append(name)
        df = df.select("*", F.when(found, F.concat(F.lit(tag + " "), pystrip(after))).alias(name))
        df = df.withColumn("_rem", F.when(F.col(name).isNotNull(), before).otherwise(rem))
    pieces = F.filter(F.array(*[F.col(n) for n in names[::-1]]), lambda x: x.isNotNull())
    return df.select(key, "pos", F.posexplode(pieces).alias("sub", "text"))
