"""Derived views over the given tables (FIXTURES.md section 3).

The given tables are generic (``documents``, ``pages``, ``events`` ...); the
portal works on memos.  These views are pure Spark expressions over the
given tables, so their size grows with them, and the SQL oracle mirrors
them word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import config


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    """values[index] for a 0-based integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def document_view(documents: DataFrame) -> DataFrame:
    """The portal's ``document`` table built from ``documents``."""
    d = F.col("doc_id")
    first_line = F.substring_index(F.col("text"), "\n", 1)
    title = F.array_join(F.slice(F.split(first_line, " ", -1), 1, 6), " ")
    u_date = F.date_add(F.lit("2024-01-01").cast("date"), (d % 60).cast("int"))
    doc_day = F.date_add(F.lit("2023-01-01").cast("date"), (d % 365).cast("int"))
    null = F.lit(None).cast("string")
    return documents.select(
        d.cast("string").alias("uid"),
        F.date_format(u_date, "yyyy-MM-dd").alias("u_date"),
        F.date_format(doc_day, "MMMM d, yyyy").alias("doc_date"),
        F.lit(config.DEFAULT_ADDRESSEE).alias("addressee"),
        _pick(config.CLASSIFICATIONS, d % 5).alias("classification"),
        F.col("lang").alias("category"),
        F.col("source").alias("from_bur"),
        F.concat(F.lit("Author "), (d % 17).cast("string")).alias("from_auth"),
        title.alias("title"),
        F.col("text").alias("full_text"),
        F.concat(F.lit(f'<div class="{config.HTML_CLASS}">'), F.col("text"),
                 F.lit("</div>")).alias("html"),
        F.concat(d.cast("string"), F.lit(".htm")).alias("file_name"),
        F.lit(0).alias("has_attachments"),
        null.alias("attach_urls"), null.alias("approved_bur"),
        null.alias("approved_name"), null.alias("draft_bur"),
        null.alias("draft_name"), null.alias("draft_ext"),
        null.alias("draft_phone"), null.alias("clear_blob"),
        null.alias("top_terms"),
    )


def document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_view(read(spark, sf_dir, "documents"))


MARKS = config.PARA_MARKINGS + [""]


def memo_blocks_view(documents: DataFrame) -> DataFrame:
    """``(doc_id, pos, tag, text)``: each document laid out as a flattened
    memo.  Five header blocks (classification and date; category FOR
    addressee; FROM; SUBJECT; a reference line), one block per non-empty
    line of the text with a paragraph mark chosen by ``(doc_id + pos) % 6``,
    and a footer on every third document.  Some documents carry the known
    defects: two FOR (``% 23``), no FROM (``% 13``), no dash (``% 31``),
    co-authors with an en dash (``% 7``), no SUBJECT colon (``% 29``), a
    header line holding FROM too (``% 11``), two approvals (``% 27``)."""
    doc = document_view(documents).select(
        F.col("uid").cast("long").alias("doc_id"), "classification", "doc_date",
        "from_bur", "from_auth", "title", "full_text")
    d = F.col("doc_id")
    s = lambda x: x.cast("string")
    cls_line = F.concat(F.upper("classification"), F.lit(" "), F.col("doc_date"))
    h0 = F.when(d % 11 == 0, F.concat(cls_line, F.lit(" FROM: "), F.col("from_bur"),
                                       F.lit(" - "), F.col("from_auth"))).otherwise(cls_line)
    cat = F.when(d % 2 == 0, F.lit("Information Memo")).otherwise(F.lit("Action Memo"))
    addr = F.when(d % 4 < 2, F.lit("The Secretary")).otherwise(F.lit("The Deputy Secretary"))
    h1 = F.when(d % 23 == 0, F.concat(cat, F.lit(" FOR "), addr, F.lit(" FOR Staff"))) \
        .otherwise(F.concat(cat, F.lit(" FOR "), addr))
    h2 = (F.when(d % 13 == 0, F.lit("DRAFT"))
          .when(d % 31 == 0, F.concat(F.lit("FROM: "), F.col("from_bur"), F.lit(" "),
                                      F.col("from_auth")))
          .when(d % 7 == 0, F.concat(F.lit("FROM: "), F.col("from_bur"), F.lit(" – "),
                                     F.col("from_auth"), F.lit(" and Author "), s(d % 5)))
          .otherwise(F.concat(F.lit("FROM: "), F.col("from_bur"), F.lit(" - "),
                              F.col("from_auth"))))
    h3 = F.when(d % 29 == 0, F.concat(F.lit("SUBJECT "), F.col("title"))) \
        .otherwise(F.concat(F.lit("SUBJECT: "), F.col("title")))
    h4 = F.concat(F.lit("REF: "), s(d))
    header = doc.select("doc_id", F.posexplode(F.array(h0, h1, h2, h3, h4)).alias("pos", "text"))

    lines = doc.select("doc_id", F.posexplode(F.split("full_text", "\n", -1)).alias("i", "line"))
    pos = F.col("i") + 5
    mark = F.element_at(F.array(*[F.lit(m) for m in MARKS]),
                        ((F.col("doc_id") + pos) % 6).cast("int") + 1)
    body = lines.where(F.trim("line") != "").select(
        "doc_id", pos.alias("pos"),
        F.when(mark == "", F.col("line"))
        .otherwise(F.concat(F.lit("("), mark, F.lit(") "), F.col("line"))).alias("text"))

    n4 = F.lpad(s(d % 10000), 4, "0")
    f = [
        F.when(d % 6 == 0, F.concat(F.lit("Attachments: "), s(d % 4))),
        F.concat(F.lit("Approved: "), F.col("from_bur"), F.lit(" - Director "), s(d % 9)),
        F.when(d % 27 == 0, F.concat(F.lit("Approved: "), F.col("from_bur"),
                                     F.lit(" - Deputy "), s(d % 5)))
        .otherwise(F.concat(F.lit("Drafted: "), F.col("from_bur"), F.lit(" - Officer "),
                            s(d % 11), F.lit(", x"), s(d % 9), F.lit("-"), n4,
                            F.lit(" and 202-555-"), n4)),
        F.concat(F.lit("Cleared: "), F.col("from_bur"), F.lit("/Clearer "), s(d % 5)),
        F.concat(F.lit("OES - Reviewer "), s(d % 7)),
        F.lit("L - Counsel"),
    ]
    nl = F.size(F.split("full_text", "\n", -1))
    footer = (doc.where(d % 3 == 0)
              .select("doc_id", nl.alias("nl"), F.posexplode(F.array(*f)).alias("k", "text"))
              .where(F.col("text").isNotNull())
              .select("doc_id", (F.col("nl") + 5 + F.col("k")).alias("pos"), "text"))
    return (header.unionByName(body).unionByName(footer)
            .select("doc_id", F.col("pos").cast("int").alias("pos"), F.lit("p").alias("tag"),
                    "text"))


def memo_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memo_blocks_view(read(spark, sf_dir, "documents"))


def scrape_pages_view(pages: DataFrame) -> DataFrame:
    """``pages`` with the article wrapped in a known id: odd pages use the
    first configured id, even pages the second, every tenth page none."""
    p = F.col("page_id")
    ids = config.SCRAPE_HTML_IDS
    tag = F.when(p % 2 == 1, F.lit(f'<article id="{ids[0]}">')) \
        .otherwise(F.lit(f'<article id="{ids[1]}">'))
    html = F.when(p % 10 == 0, F.col("html")).otherwise(
        F.replace(F.col("html"), F.lit("<article>"), tag))
    return pages.select("page_id", "url", html.alias("html"))


def fetched_pages_view(pages: DataFrame) -> DataFrame:
    """``pages`` with a fetch status: every 17th page failed (404)."""
    status = F.when(F.col("page_id") % 17 == 0, F.lit(404)).otherwise(F.lit(200))
    return pages.select("page_id", "url", "html", status.alias("status"))


def _escape_all(c: Column) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                 ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def descriptions_view(pages: DataFrame) -> DataFrame:
    """Feed items from ``pages``: the escaped page title and markup, followed
    by an escaped ``<div>`` carrying the url, as feeds deliver descriptions.
    What stands before the page's own first ``<div`` is the description."""
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    raw = F.concat(title, F.lit(" "), F.col("html"), F.lit('<div class="more">'), F.col("url"), F.lit("</div>"))
    return pages.select("page_id", _escape_all(raw).alias("description"))


def search_queries_view(benchmark: DataFrame) -> DataFrame:
    """``(qid, q)``: a search term from every benchmark text: ten characters,
    the same with a wildcard character, with a wildcard run, two characters
    only, and wildcards only."""
    s = F.substring("text", 5, 10)
    kind = F.col("item_id") % 5
    q = (F.when(kind == 0, s).when(kind == 1, F.concat(F.substring(s, 1, 3), F.lit("_"), F.substring(s, 5, 6)))
         .when(kind == 2, F.concat(F.substring(s, 1, 4), F.lit("%"), F.substring(s, 7, 4)))
         .when(kind == 3, F.substring(s, 1, 2))
         .otherwise(F.repeat(F.lit("_"), (F.col("item_id") * 37 % 3000).cast("int"))))
    return benchmark.select(F.col("item_id").alias("qid"), q.alias("q"))


WORD_RUN = r"[\p{L}\p{N}_]+"


def entity_dim_view(benchmark: DataFrame, conversations: DataFrame) -> DataFrame:
    """``(kind, key, name, url)`` dictionaries drawn from the given tables,
    all of them, without a limit: bureaus are the words (two characters or
    more) of the benchmark texts, partners their opening word and their first
    fourteen characters (keys with spaces and marks), countries the
    capitalised words (5+ letters) of the conversations, so that some country
    keys are prefixes of others."""
    def dim(kind, keys, name, folder):
        return keys.where(F.col("k") != "").distinct().select(
            F.lit(kind).alias("kind"), F.col("k").alias("key"), F.concat(F.lit(name), "k").alias("name"),
            F.concat(F.lit(f"https://example.org/{folder}/"), "k").alias("url"))

    def words(table, pattern):
        return table.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("k"))

    bureaus = dim("bureau", words(benchmark, WORD_RUN).where(F.length("k") >= 2), "Bureau of ", "bureaus")
    opening = benchmark.select(F.regexp_extract("text", "^" + WORD_RUN, 0).alias("k")).unionByName(
        benchmark.select(F.substring("text", 1, 14).alias("k")))
    partners = dim("partner", opening, "Partner ", "partners")
    countries = dim("country", words(conversations, r"\p{Lu}\p{Ll}{4,}"), "", "countries")
    return bureaus.unionByName(partners).unionByName(countries)


def entity_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_dim_view(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "conversations"))
