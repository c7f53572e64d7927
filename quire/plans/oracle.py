"""Independent DuckDB SQL for every registered query.

Written from the operator definitions, not from the Spark code: plain
joins and window functions over the given tables.  Scores are rounded to 6
digits in the output and ranked at 9 digits, with key tie-breaks, so that
summation order cannot change a result between engines.
"""

from __future__ import annotations

from quire import config


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


STOP_LIST = _list(config.english_stop_words())
CLASSES = _list(config.CLASSIFICATIONS)

DOCUMENT = f"""
document AS (
  SELECT CAST(doc_id AS VARCHAR) AS uid,
         strftime(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER), '%Y-%m-%d') AS u_date,
         strftime(DATE '2023-01-01' + CAST(doc_id % 365 AS INTEGER), '%B %-d, %Y') AS doc_date,
         'The Secretary' AS addressee,
         ({CLASSES})[CAST(doc_id % 5 AS INTEGER) + 1] AS classification,
         lang AS category,
         source AS from_bur,
         'Author ' || CAST(doc_id % 17 AS VARCHAR) AS from_auth,
         array_to_string(string_split(split_part(text, chr(10), 1), ' ')[1:6], ' ') AS title,
         text AS full_text,
         '<div class="document">' || text || '</div>' AS html,
         CAST(doc_id AS VARCHAR) || '.htm' AS file_name,
         0 AS has_attachments
  FROM documents
)"""

# Tokens without stop words, as a list per document.
TOKENS = f"""
toks AS (
  SELECT uid,
         list_filter(regexp_extract_all(lower(coalesce(full_text, '')), '{config.TOKEN_PATTERN}'),
                     lambda x: NOT list_contains({STOP_LIST}, x)) AS t
  FROM document
),
ndocs AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM document)"""

UNIGRAMS = """
grams AS (SELECT uid, unnest(t) AS term FROM toks)"""

NGRAMS = """
grams AS (
  SELECT uid, unnest(t) AS term FROM toks
  UNION ALL
  SELECT uid, unnest(list_transform(range(1, len(t)),
                                    lambda i: t[i] || ' ' || t[i + 1])) FROM toks WHERE len(t) >= 2
  UNION ALL
  SELECT uid, unnest(list_transform(range(1, len(t) - 1),
                                    lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))
  FROM toks WHERE len(t) >= 3
)"""

WEIGHTS = """
tf AS (SELECT uid, term, count(*) AS tf FROM grams GROUP BY uid, term),
dfreq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w0 AS (
  SELECT tf.uid, tf.term, tf.tf, dfreq.df,
         tf.tf * (ln((1 + ndocs.n) / (1 + dfreq.df)) + 1) AS w
  FROM tf JOIN dfreq ON tf.term = dfreq.term CROSS JOIN ndocs
),
vec AS (
  SELECT uid, term, tf, df, w / sqrt(sum(w * w) OVER (PARTITION BY uid)) AS weight
  FROM w0
)"""

PAIRS = """
sim AS (
  SELECT a.uid AS uid_1, b.uid AS uid_2, sum(a.weight * b.weight) AS score
  FROM vec a JOIN vec b ON a.term = b.term
  GROUP BY a.uid, b.uid
)"""

#: Pairs are stored from this score on.
THRESHOLD = 0.7

CLASSES_OF_TEXTS = """
cls AS (
  SELECT uid, min(uid) OVER (PARTITION BY coalesce(full_text, '')) AS rep,
         count(*) OVER (PARTITION BY coalesce(full_text, '')) AS copies
  FROM document
)"""

REP_PAIRS = f"""
pairs AS MATERIALIZED (
  SELECT uid_1, uid_2, score FROM sim
  WHERE round(score, 9) >= {THRESHOLD} AND uid_1 IN (SELECT rep FROM cls) AND uid_2 IN (SELECT rep FROM cls)
)"""

ALL_REP_PAIRS = """
pairs AS MATERIALIZED (
  SELECT uid_1, uid_2, score FROM sim
  WHERE uid_1 IN (SELECT rep FROM cls) AND uid_2 IN (SELECT rep FROM cls)
)"""

BAND = f"""
band AS (
  SELECT CAST(floor(n * {config.BAND_LOWER}) AS BIGINT) AS lo,
         CAST(floor(n * {config.BAND_UPPER}) AS BIGINT) AS hi
  FROM ndocs
)"""

TOP_TERMS = """
allowed AS (
  SELECT vec.* FROM vec CROSS JOIN band WHERE vec.df > band.lo AND vec.df < band.hi
),
ranked AS (
  SELECT uid, term, row_number() OVER (PARTITION BY uid ORDER BY weight DESC, term DESC) AS r
  FROM allowed
),
topterms AS (
  SELECT uid, string_agg(term, ',' ORDER BY r) AS top_terms_csv,
         list(term ORDER BY r) AS top_terms
  FROM ranked WHERE r <= 3 GROUP BY uid
)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts) + "\n"


def preview_sql(col: str, n: int) -> str:
    words = f"string_split({col}, ' ')"
    return (f"CASE WHEN len({words}) > {n} "
            f"THEN array_to_string({words}[1:{n}], ' ') || ' ...' ELSE {col} END")


def related_on_demand(uid: str) -> str:
    return with_(DOCUMENT, TOKENS, UNIGRAMS, WEIGHTS) + f"""
, q AS (SELECT term, weight AS wq FROM vec WHERE uid = {_q(uid)})
, s AS (SELECT vec.uid, sum(vec.weight * q.wq) AS score
        FROM vec JOIN q ON vec.term = q.term GROUP BY vec.uid)
SELECT d.uid, d.title, {preview_sql('d.full_text', config.PREVIEW_RELATED)} AS preview,
       round(s.score, 6) AS score
FROM s JOIN document d ON d.uid = s.uid
WHERE s.score < {config.RELATED_CUTOFF}
ORDER BY round(s.score, 9) DESC, d.uid
LIMIT {config.RELATED_LIMIT}
"""


SAMPLE_UID = "7"
SEARCH_TERM = "tion ou"
R6 = "round({0}, 6) AS {0}"

UNI = with_(DOCUMENT, TOKENS, UNIGRAMS, WEIGHTS)
NG = with_(DOCUMENT, TOKENS, NGRAMS, WEIGHTS)
TT = with_(DOCUMENT, TOKENS, NGRAMS, WEIGHTS, BAND, TOP_TERMS)
DOC_TT = TT + """, doc_tt AS (
  SELECT d.*, coalesce(t.top_terms_csv, '') AS top_terms
  FROM document d LEFT JOIN topterms t ON d.uid = t.uid
)
"""
SIM = with_(DOCUMENT, TOKENS, UNIGRAMS, WEIGHTS, PAIRS)
LISTING = ("uid, doc_date, title, " + preview_sql("full_text", config.PREVIEW_FEED)
           + " AS preview, from_auth, from_bur")
ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LABEL = ("CASE classification WHEN 'noforn' THEN 'Noforn' WHEN 'secret' THEN 'Secret' "
         "WHEN 'sensitive but unclassified' THEN 'Sensitive But Unclassified' "
         "WHEN 'unclassified' THEN 'Unclassified' ELSE 'Uncategorized' END")
QUOTE = "replace(url_encode({0}), '%20', '+')"
UNQUOTE = "url_decode(replace({0}, '+', ' '))"


def related_top(where: str) -> str:
    """The best related documents of each document, by window."""
    return SIM + f""", r AS (
          SELECT uid_1, uid_2, score,
                 row_number() OVER (PARTITION BY uid_1 ORDER BY round(score, 9) DESC, uid_2) AS rank
          FROM sim WHERE score < {config.RELATED_CUTOFF} AND {where})
        SELECT r.uid_1, r.rank, d.uid, d.title,
               {preview_sql('d.full_text', config.PREVIEW_RELATED)} AS preview,
               round(r.score, 6) AS score
        FROM r JOIN document d ON d.uid = r.uid_2 WHERE r.rank <= {config.RELATED_LIMIT}"""


def _like(q: str) -> str:
    return _q("%" + q.lower() + "%")


ORACLE: dict[str, str] = {
    "related_on_demand": related_on_demand(SAMPLE_UID),
    "tokens": with_(DOCUMENT, TOKENS) + "SELECT uid, t AS tokens FROM toks",
    "tfidf_unigram": UNI + "SELECT uid, term, tf, df, " + R6.format("weight") + " FROM vec",
    "ngram_postings": with_(DOCUMENT, TOKENS, NGRAMS)
    + "SELECT uid, term, count(*) AS tf FROM grams GROUP BY uid, term",
    "ranked_terms": NG + "SELECT uid, term, " + R6.format("weight") + """,
        row_number() OVER (PARTITION BY uid ORDER BY weight DESC, term DESC) AS rank FROM vec""",
    "term_statistics": NG + """SELECT term, count(*) AS doc_count,
        round(sum(weight), 6) AS score_sum FROM vec GROUP BY term""",
    "top_terms": DOC_TT + "SELECT uid, top_terms FROM doc_tt",
    "df_histogram": with_(DOCUMENT, TOKENS, NGRAMS, WEIGHTS, BAND) + """,
        per_term AS (SELECT term, count(*) AS doc_count FROM vec GROUP BY term)
        SELECT doc_count, count(*) AS n_terms,
               CASE WHEN doc_count > band.lo AND doc_count < band.hi THEN '**' ELSE '' END AS in_band
        FROM per_term CROSS JOIN band GROUP BY doc_count, band.lo, band.hi""",
    "parity": with_(DOCUMENT, TOKENS) + """,
        c AS (SELECT count(uid) AS n_keys, count(full_text) AS n_texts FROM document),
        v AS (SELECT count(*) AS n_vectors FROM toks)
        SELECT n_keys, n_texts, n_vectors, (n_keys = n_texts AND n_texts = n_vectors) AS ok
        FROM c CROSS JOIN v""",
    "trending": DOC_TT + f""", recent AS (
          SELECT top_terms FROM doc_tt ORDER BY u_date DESC, uid LIMIT {config.TRENDING_DOCS}),
        terms AS (SELECT unnest(string_split(top_terms, ',')) AS term FROM recent
                  WHERE top_terms <> '')
        SELECT term, count(*) AS n FROM terms WHERE term <> '' GROUP BY term
        ORDER BY n DESC, term DESC LIMIT {config.TRENDING_TERMS}""",
    "feed": with_(DOCUMENT) + f"""SELECT {LISTING} FROM document
        ORDER BY doc_date DESC, uid LIMIT {config.FEED_LIMIT}""",
    "feed_parsed_dates": with_(DOCUMENT) + f"""SELECT {LISTING} FROM document
        ORDER BY try_strptime(doc_date, '%B %-d, %Y') DESC NULLS LAST, uid
        LIMIT {config.FEED_LIMIT}""",
    "search": with_(DOCUMENT) + f"""SELECT {LISTING} FROM document
        WHERE {ASCII_LOWER.format('full_text')} LIKE {_like(SEARCH_TERM)}
        ORDER BY u_date DESC, uid LIMIT {config.SEARCH_LIMIT}""",
    "search_quoted": with_(DOCUMENT) + f"""SELECT {LISTING} FROM document
        WHERE {ASCII_LOWER.format('full_text')} LIKE {_like(SEARCH_TERM)}
        ORDER BY u_date DESC, uid LIMIT {config.SEARCH_LIMIT}""",
    "search_batch": with_(DOCUMENT) + f""", queries AS (
          SELECT item_id AS qid, substr(text, 5, 10) AS s FROM benchmark),
        patterns AS (
          SELECT qid, '%' || {ASCII_LOWER.format("""CASE qid % 5 WHEN 0 THEN s
                 WHEN 1 THEN substr(s, 1, 3) || '_' || substr(s, 5, 6)
                 WHEN 2 THEN substr(s, 1, 4) || '%' || substr(s, 7, 4)
                 WHEN 3 THEN substr(s, 1, 2)
                 ELSE repeat('_', CAST(qid * 37 % 3000 AS INTEGER)) END""")} || '%' AS p FROM queries),
        hits AS (
          SELECT qid, d.*, row_number() OVER (PARTITION BY qid ORDER BY u_date DESC, uid) AS rank
          FROM document d JOIN patterns ON {ASCII_LOWER.format('full_text')} LIKE p)
        SELECT qid, rank, {LISTING} FROM hits WHERE rank <= {config.SEARCH_LIMIT}""",
    "detail": DOC_TT + f"""SELECT uid, classification, title, doc_date, from_auth, from_bur,
        category, addressee, file_name, html, full_text,
        CASE WHEN top_terms = '' THEN []::VARCHAR[] ELSE string_split(top_terms, ',') END
          AS top_terms,
        {LABEL} AS label
        FROM doc_tt WHERE uid = {_q(SAMPLE_UID)}""",
    "category_filter": with_(DOCUMENT) + """SELECT category, uid FROM document
        WHERE category = 'en' ORDER BY uid LIMIT 5""",
    "previews": with_(DOCUMENT) + "SELECT uid, " + preview_sql("full_text", config.PREVIEW_FEED)
    + " AS preview FROM document",
    "labels": with_(DOCUMENT) + f"SELECT uid, classification, {LABEL} AS label FROM document",
    "url_round_trip": with_(DOCUMENT) + f"""SELECT uid, title, {QUOTE.format('title')} AS quoted,
        {UNQUOTE.format(QUOTE.format('title'))} AS unquoted FROM document""",
    "text_classes": with_(DOCUMENT, CLASSES_OF_TEXTS) + "SELECT uid, rep, copies FROM cls",
    "pair_table": with_(DOCUMENT, TOKENS, UNIGRAMS, WEIGHTS, PAIRS, CLASSES_OF_TEXTS, ALL_REP_PAIRS)
    + "SELECT uid_1, uid_2, " + R6.format("score") + " FROM pairs",
    "pair_counts": SIM + f""", c AS (SELECT count(*) AS stored,
            count(*) FILTER (WHERE score < {config.CHECK_CUTOFF}) AS below FROM sim),
        n AS (SELECT count(*) AS n FROM document)
        SELECT n * n AS n_pairs, below + (n * n - stored) AS n_below_cutoff
        FROM c CROSS JOIN n""",
    "top_scores": SIM + f"""SELECT round(score, 6) AS score FROM sim
        WHERE score < {config.CHECK_CUTOFF}
        ORDER BY round(score, 9) DESC LIMIT {config.CHECK_LIMIT}""",
    "similar_titles": SIM + f"""SELECT s.uid_1, s.uid_2, d1.title AS title_1, d2.title AS title_2,
        round(s.score, 6) AS score
        FROM document d1 JOIN sim s ON d1.uid = s.uid_1 JOIN document d2 ON s.uid_2 = d2.uid
        WHERE s.score < {config.CHECK_CUTOFF}
        ORDER BY round(s.score, 9) DESC, s.uid_1, s.uid_2 LIMIT {config.CHECK_LIMIT}""",
    "similar_titles_for": SIM + f"""SELECT s.uid_2, d2.title AS title_2, round(s.score, 6) AS score
        FROM document d1 JOIN sim s ON d1.uid = s.uid_1 JOIN document d2 ON s.uid_2 = d2.uid
        WHERE s.score < {config.CHECK_CUTOFF} AND d1.uid = {_q(SAMPLE_UID)}
        ORDER BY round(s.score, 9) DESC, s.uid_1, s.uid_2 LIMIT {config.CHECK_LIMIT}""",
    "related": SIM + f"""SELECT d.uid, d.title,
        {preview_sql('d.full_text', config.PREVIEW_RELATED)} AS preview, round(s.score, 6) AS score
        FROM document d JOIN sim s ON d.uid = s.uid_2
        WHERE s.uid_1 = {_q(SAMPLE_UID)} AND s.score < {config.RELATED_CUTOFF}
        ORDER BY round(s.score, 9) DESC, d.uid LIMIT {config.RELATED_LIMIT}""",
    "related_all": related_top("true"),
    "related_batch": related_top("CAST(uid_1 AS BIGINT) % 100 = 0"),
}


ORACLE["feed_clustered"] = ORACLE["feed"]
ORACLE["document_frequencies"] = ("WITH " + DOCUMENT.strip().replace("document AS (", "original AS (", 1) + """,
document AS (SELECT uid, CASE WHEN CAST(uid AS BIGINT) % 5 = 0 THEN title ELSE full_text END AS full_text FROM original)"""
                                  + "," + TOKENS + "," + NGRAMS + """
SELECT term, count(DISTINCT uid) AS df FROM grams GROUP BY term""")
ORACLE["related_all_stored"] = ORACLE["related_all"]


# ---------------------------------------------------------------- memos

def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


MEMO_BLOCKS = """
mdoc AS (
  SELECT CAST(uid AS BIGINT) AS doc_id, classification, doc_date, from_bur, from_auth, title,
         full_text FROM document
),
mhead AS (
  SELECT doc_id, unnest(arr) AS text, generate_subscripts(arr, 1) - 1 AS pos FROM (
    SELECT doc_id, [
      CASE WHEN doc_id % 11 = 0
           THEN upper(classification) || ' ' || doc_date || ' FROM: ' || from_bur || ' - ' || from_auth
           ELSE upper(classification) || ' ' || doc_date END,
      CASE WHEN doc_id % 23 = 0
           THEN (CASE WHEN doc_id % 2 = 0 THEN 'Information Memo' ELSE 'Action Memo' END)
                || ' FOR ' || (CASE WHEN doc_id % 4 < 2 THEN 'The Secretary' ELSE 'The Deputy Secretary' END)
                || ' FOR Staff'
           ELSE (CASE WHEN doc_id % 2 = 0 THEN 'Information Memo' ELSE 'Action Memo' END)
                || ' FOR ' || (CASE WHEN doc_id % 4 < 2 THEN 'The Secretary' ELSE 'The Deputy Secretary' END)
      END,
      CASE WHEN doc_id % 13 = 0 THEN 'DRAFT'
           WHEN doc_id % 31 = 0 THEN 'FROM: ' || from_bur || ' ' || from_auth
           WHEN doc_id % 7 = 0 THEN 'FROM: ' || from_bur || ' – ' || from_auth || ' and Author '
                                    || CAST(doc_id % 5 AS VARCHAR)
           ELSE 'FROM: ' || from_bur || ' - ' || from_auth END,
      CASE WHEN doc_id % 29 = 0 THEN 'SUBJECT ' || title ELSE 'SUBJECT: ' || title END,
      'REF: ' || CAST(doc_id AS VARCHAR)
    ] AS arr FROM mdoc)
),
mlines AS (
  SELECT doc_id, unnest(string_split(full_text, chr(10))) AS line,
         generate_subscripts(string_split(full_text, chr(10)), 1) - 1 AS i FROM mdoc
),
mbody AS (
  SELECT doc_id, i + 5 AS pos,
         CASE WHEN mk = '' THEN line ELSE '(' || mk || ') ' || line END AS text
  FROM (SELECT *, (['SBU', 'C', 'S', 'noforn', 'U', ''])[CAST((doc_id + i + 5) % 6 AS INTEGER) + 1] AS mk
        FROM mlines)
  WHERE trim(line) <> ''
),
mfoot0 AS (
  SELECT doc_id, nl, unnest(arr) AS text, generate_subscripts(arr, 1) - 1 AS k FROM (
    SELECT doc_id, len(string_split(full_text, chr(10))) AS nl, [
      CASE WHEN doc_id % 6 = 0 THEN 'Attachments: ' || CAST(doc_id % 4 AS VARCHAR) END,
      'Approved: ' || from_bur || ' - Director ' || CAST(doc_id % 9 AS VARCHAR),
      CASE WHEN doc_id % 27 = 0
           THEN 'Approved: ' || from_bur || ' - Deputy ' || CAST(doc_id % 5 AS VARCHAR)
           ELSE 'Drafted: ' || from_bur || ' - Officer ' || CAST(doc_id % 11 AS VARCHAR) || ', x'
                || CAST(doc_id % 9 AS VARCHAR) || '-' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0')
                || ' and 202-555-' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') END,
      'Cleared: ' || from_bur || '/Clearer ' || CAST(doc_id % 5 AS VARCHAR),
      'OES - Reviewer ' || CAST(doc_id % 7 AS VARCHAR),
      'L - Counsel'
    ] AS arr FROM mdoc WHERE doc_id % 3 = 0)
),
mfoot AS (SELECT doc_id, nl + 5 + k AS pos, text FROM mfoot0 WHERE text IS NOT NULL),
memo_blocks AS (
  SELECT doc_id, CAST(pos AS INTEGER) AS pos, 'p' AS tag, text FROM (
    SELECT doc_id, pos, text FROM mhead UNION ALL
    SELECT doc_id, pos, text FROM mbody UNION ALL
    SELECT doc_id, pos, text FROM mfoot)
)"""

MEMO_DEDUP = """
mhtml AS (
  SELECT *, '<' || tag || '>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
            || '</' || tag || '>' AS html
  FROM memo_blocks
),
mfirst AS (SELECT doc_id, tag, html, min(pos) AS pos, any_value(text) AS text
           FROM mhtml GROUP BY doc_id, tag, html),
mdedup AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos,
         tag, text, html FROM mfirst
)"""

_CLS = "CASE " + " ".join(
    f"WHEN instr(lower(text), {_q(c)}) > 0 THEN {_q(c)}" for c in config.CLASSIFICATIONS) + " END"
_DATE = "nullif(regexp_extract(text, '[JFMASOND][a-z]* [0-9]*, [0-9]...', 0), '')"
_FROM_PARTS = ("regexp_split_to_array(" + _strip(
    "replace(string_split(text, 'FROM:')[2], ' and ', ' - ')") + ", ' [-–] ')")
_MARK_SPANS = "html"
_MARK_TEXT = "text"
for _m in config.PARA_MARKINGS:
    _MARK_SPANS = (f"regexp_replace({_MARK_SPANS}, '\\({_m}\\)', "
                   f"'<span class=\"label label-{_m.lower()}\">{_m}</span>', 'g')")
    _MARK_TEXT = f"regexp_replace({_MARK_TEXT}, '\\({_m}\\)', ' {_m} ', 'g')"

MEMO_HEADER = f"""
hitems AS (
  SELECT doc_id, pos, {_CLS} AS cls, {_DATE} AS dt,
         instr(text, ' FOR ') > 0 AS is_for,
         NOT (instr(text, ' FOR ') > 0) AND starts_with(text, 'FROM:') AS is_from,
         NOT (instr(text, ' FOR ') > 0) AND NOT starts_with(text, 'FROM:')
           AND starts_with(text, 'SUBJECT:') AS is_subject,
         string_split(text, ' FOR ') AS for_parts,
         {_FROM_PARTS} AS from_parts,
         CASE WHEN instr(text, ': ') > 0
              THEN {_strip("substr(text, instr(text, ': ') + 2)")} END AS title
  FROM mdedup WHERE pos < 5
),
hagg AS (
  SELECT doc_id,
    min({{'p': pos, 'v': cls, 'd': dt}}) FILTER (WHERE cls IS NOT NULL) AS c,
    max({{'p': pos, 'a': CASE WHEN len(for_parts) = 2 THEN for_parts[1] END,
              'b': CASE WHEN len(for_parts) = 2 THEN for_parts[2] END}}) FILTER (WHERE is_for) AS f,
    max({{'p': pos, 'a': CASE WHEN len(from_parts) >= 2 THEN {_strip('from_parts[1]')} END,
              'b': CASE WHEN len(from_parts) >= 2 THEN {_strip('from_parts[2]')} END}})
      FILTER (WHERE is_from) AS m,
    max({{'p': pos, 'a': title}}) FILTER (WHERE is_subject) AS s
  FROM hitems GROUP BY doc_id
),
header AS (
  SELECT doc_id,
    coalesce(c.v, 'unknown') AS classification,
    coalesce(c.d, 'unknown') AS doc_date,
    CASE WHEN f IS NULL THEN 'The Secretary' ELSE coalesce(f.b, 'unknown') END AS addressee,
    CASE WHEN f IS NULL THEN 'Information Memo' ELSE coalesce(f.a, 'unknown') END AS category,
    coalesce(m.a, 'unknown') AS from_bur,
    coalesce(m.b, 'unknown') AS from_auth,
    coalesce(s.a, 'unknown') AS title
  FROM hagg
)"""

MEMO_BODY_FOOTER = f"""
mpos0 AS (
  SELECT *,
    min(CASE WHEN regexp_matches(text, '^SUBJECT:') THEN pos END) OVER (PARTITION BY doc_id) AS st,
    count(CASE WHEN starts_with(text, 'Approved:') THEN 1 END) OVER (PARTITION BY doc_id) AS n_appr,
    min(CASE WHEN starts_with(text, 'Approved:') THEN pos END) OVER (PARTITION BY doc_id) AS appr
  FROM mdedup
),
mpos AS (
  SELECT *, min(CASE WHEN starts_with(text, 'Cleared:') AND pos >= appr THEN pos END)
              OVER (PARTITION BY doc_id) AS clr,
    min(CASE WHEN starts_with(text, 'Cleared:') THEN pos END) OVER (PARTITION BY doc_id) AS clr0
  FROM mpos0
),
body AS (
  SELECT doc_id, bool_or(st IS NOT NULL) AS has_start,
    coalesce(string_agg({_MARK_SPANS}, ' ' ORDER BY pos) FILTER (WHERE pos > st), '') AS h,
    coalesce(string_agg({_MARK_TEXT}, ' ' ORDER BY pos) FILTER (WHERE pos > st), '') AS t
  FROM mpos GROUP BY doc_id
),
body_out AS (
  SELECT doc_id,
    {_strip("regexp_replace(CASE WHEN has_start THEN t ELSE 'Could not locate start of document - check logs' END, '\\s+', ' ', 'g')")} AS full_text,
    concat_ws(' ', '<div class="document">',
              CASE WHEN has_start THEN h ELSE '<p>Could not locate start of document - check logs</p>' END,
              '</div>') AS html
  FROM body
),
fitems AS (
  SELECT *,
    regexp_split_to_array(string_split(text, ':')[2], ' [-–] ') AS appr_parts,
    string_split(substr(text, instr(text, ':') + 1), ',') AS data_parts
  FROM mpos
),
fitems2 AS (
  SELECT *,
    regexp_split_to_array(data_parts[1], ' [-–] ') AS person,
    nullif(regexp_extract(data_parts[2], '[0-9]-[0-9]...', 0), '') AS ext,
    nullif(regexp_extract(data_parts[2], '[0-9]..-[0-9]..-[0-9]...', 0), '') AS phone
  FROM fitems
),
footer AS (
  SELECT doc_id,
    CAST(coalesce(max(CAST(starts_with(text, 'Attachments:') AS INTEGER)), 0) AS INTEGER) AS has_attachments,
    max({{'a': {_strip('appr_parts[1]')}, 'b': {_strip('appr_parts[2]')}}})
      FILTER (WHERE n_appr = 1 AND pos = appr AND len(appr_parts) = 2) AS ap,
    max({{'p': pos, 'bur': {_strip('person[1]')}, 'name': {_strip('person[2]')}, 'ext': ext, 'phone': phone}})
      FILTER (WHERE n_appr = 1 AND starts_with(text, 'Drafted:') AND pos >= appr
              AND (clr IS NULL OR pos < clr) AND len(data_parts) = 2 AND len(person) = 2
              AND ext IS NOT NULL AND phone IS NOT NULL) AS dr,
    list(CASE WHEN pos = clr0 THEN string_split(text, ': ')[2] ELSE text END ORDER BY pos)
      FILTER (WHERE n_appr = 1 AND clr IS NOT NULL AND pos >= clr0
              AND (pos > clr0 OR len(string_split(text, ': ')) >= 2)) AS cl
  FROM fitems2 GROUP BY doc_id
),
footer_out AS (
  SELECT doc_id, has_attachments, CAST(NULL AS VARCHAR) AS attach_urls,
    ap.a AS approved_bur, ap.b AS approved_name, dr.bur AS draft_bur, dr.name AS draft_name,
    dr.ext AS draft_ext, dr.phone AS draft_phone, coalesce(cl, []::VARCHAR[]) AS clear_blob
  FROM footer
)"""

MEMO = with_(DOCUMENT, MEMO_BLOCKS, MEMO_DEDUP)
MEMO_ALL = with_(DOCUMENT, MEMO_BLOCKS, MEMO_DEDUP, MEMO_HEADER, MEMO_BODY_FOOTER)
MEMO_PARSED = """
SELECT h.doc_id, h.classification, h.doc_date, h.addressee, h.category, h.from_bur, h.from_auth,
       h.title, b.full_text, b.html, f.has_attachments, f.attach_urls, f.approved_bur,
       f.approved_name, f.draft_bur, f.draft_name, f.draft_ext, f.draft_phone, f.clear_blob
FROM header h JOIN body_out b ON h.doc_id = b.doc_id JOIN footer_out f ON h.doc_id = f.doc_id"""

_REPAIR = [("SUBJECT\\s?:", "SUBJECT:"), ("FROM\\s?:", "FROM:")] + [
    (c.upper(), c.upper()) for c in config.CLASSIFICATIONS]


def _repair_sql() -> str:
    steps = ["r0 AS (SELECT doc_id, pos, text AS rem FROM memo_blocks WHERE pos < 3)"]
    carried = []
    for j, (pat, tag) in enumerate(_REPAIR):
        prev = f"r{j}"
        cols = ", ".join(["doc_id", "pos"] + carried)
        after = _strip(f"regexp_extract(rem, '(?s)^.*?(?:{pat})(.*)$', 1)")
        steps.append(
            f"r{j + 1} AS (SELECT {cols}, CASE WHEN regexp_matches(rem, '{pat}') "
            f"THEN '{tag} ' || {after} END AS p{j}, "
            f"CASE WHEN regexp_matches(rem, '{pat}') "
            f"THEN regexp_extract(rem, '(?s)^(.*?)(?:{pat})', 1) ELSE rem END AS rem FROM {prev})")
        carried.append(f"p{j}")
    last = f"r{len(_REPAIR)}"
    pieces = "[" + ", ".join(f"p{j}" for j in reversed(range(len(_REPAIR)))) + "]"
    return (MEMO.rstrip("\n") + ",\n" + ",\n".join(steps) + f"""
, rl AS (SELECT doc_id, pos, list_filter({pieces}, lambda x: x IS NOT NULL) AS ps FROM {last})
SELECT doc_id, pos, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS sub, unnest(ps) AS text FROM rl""")


ORACLE.update({
    "memo_dedup": MEMO + "SELECT doc_id, pos, tag, text, html FROM mdedup",
    "memo_line_numbers": MEMO + """SELECT doc_id, list(pos ORDER BY pos) AS positions
        FROM mdedup WHERE regexp_matches(text, '^\\(U\\)') GROUP BY doc_id""",
    "memo_header": MEMO_ALL + "SELECT * FROM header",
    "memo_parse": MEMO_ALL + MEMO_PARSED,
    "memo_records": MEMO_ALL + """, parsed AS (""" + MEMO_PARSED + """)
        SELECT classification, doc_date, addressee, category, from_bur, from_auth, title,
               full_text, html, CAST(doc_id AS VARCHAR) || '.htm' AS file_name, has_attachments,
               attach_urls, approved_bur, approved_name, draft_bur, draft_name, draft_ext,
               draft_phone, to_json(clear_blob)::VARCHAR AS clear_blob
        FROM parsed""",
    "paragraph_marks": MEMO + """SELECT doc_id, pos,
        regexp_extract(text, '^\\((SBU|C|S|noforn|U)\\)', 1) AS mark
        FROM mdedup WHERE regexp_extract(text, '^\\((SBU|C|S|noforn|U)\\)', 1) <> ''""",
    "header_repair": _repair_sql(),
})


# ---------------------------------------------------------------- pages

_ESC = "{0}"
for _a, _b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
    _ESC = f"replace({_ESC}, {_q(_a)}, {_q(_b)})"
_UNESC = "{0}"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
    _UNESC = f"replace({_UNESC}, {_q(_a)}, {_q(_b)})"

ORACLE.update({
    "page_file_names": """SELECT page_id, url,
        CASE WHEN string_split(url, '/')[-1] = '' THEN coalesce(string_split(url, '/')[-2], '')
             ELSE string_split(url, '/')[-1] END AS file_name FROM pages""",
    "fetched_pages": """SELECT page_id, url, 200 AS status FROM pages WHERE page_id % 17 <> 0""",
    "removed_chars": "SELECT page_id, replace(html, chr(160), '') AS html FROM pages",
    "descriptions": "SELECT page_id, regexp_replace(" + _UNESC.format(_ESC.format(
        "regexp_extract(html, '<title>(.*?)</title>', 1) || ' ' || html || '<div class=\"more\">' || url || '</div>'"))
    + ", '(?s)<div.*', '') AS description FROM pages",
})


#: Files hold UTF-8, which the scan reads byte by byte as Latin-1.
ORACLE["html_files"] = """WITH bytes AS (
      SELECT array_to_string(list_transform(regexp_extract_all(hex(encode(html)), '..'),
                                            lambda x: chr(CAST('0x' || x AS INTEGER))), '') AS html
      FROM pages WHERE html IS NOT NULL)
    SELECT line, count(*) AS n FROM (SELECT unnest(string_split(html, chr(10))) AS line FROM bytes) GROUP BY line"""


# ---------------------------------------------------------------- entities

ENTITY_DIM = """
bureaus AS (
  SELECT DISTINCT 'bureau' AS kind, w AS key, 'Bureau of ' || w AS name,
         'https://example.org/bureaus/' || w AS url
  FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS w FROM benchmark) WHERE length(w) >= 2
),
partners AS (
  SELECT DISTINCT 'partner' AS kind, k AS key, 'Partner ' || k AS name,
         'https://example.org/partners/' || k AS url
  FROM (SELECT regexp_extract(text, '^[\\p{L}\\p{N}_]+', 0) AS k FROM benchmark
        UNION ALL SELECT substr(text, 1, 14) FROM benchmark) WHERE k <> ''
),
countries AS (
  SELECT DISTINCT 'country' AS kind, w AS key, w AS name, 'https://example.org/countries/' || w AS url
  FROM (SELECT unnest(regexp_extract_all(text, '\\p{Lu}\\p{Ll}{4,}')) AS w FROM conversations)
),
entity_dim AS (
  SELECT * FROM bureaus UNION ALL SELECT * FROM partners UNION ALL SELECT * FROM countries
)"""

ORACLE.update({
    "loaded_dictionary": with_(ENTITY_DIM) + "SELECT kind, key, name, url FROM bureaus",
    "entity_dim": with_(ENTITY_DIM) + "SELECT kind, key, name, url FROM entity_dim",
    "entity_matches": with_(DOCUMENT, ENTITY_DIM) + """,
        runs AS (
          SELECT uid, regexp_extract_all(full_text, '[\\p{L}\\p{N}_]+') AS r,
                 regexp_matches(full_text, '^[\\p{L}\\p{N}_]') AS ws,
                 regexp_matches(full_text, '[\\p{L}\\p{N}_]$') AS we
          FROM document
        ),
        inner_words AS (
          SELECT DISTINCT uid, unnest(r[CASE WHEN ws THEN 2 ELSE 1 END :
                                       CASE WHEN we THEN len(r) - 1 ELSE len(r) END]) AS w
          FROM runs
        )
        SELECT i.uid, e.kind, e.key AS entity_key, e.name, e.url
        FROM inner_words i JOIN entity_dim e ON e.kind = 'bureau' AND i.w = e.key
        UNION ALL
        SELECT d.uid, e.kind, e.key AS entity_key, e.name, e.url
        FROM document d JOIN entity_dim e ON e.kind <> 'bureau' AND contains(d.full_text, e.key)""",
})


# ---------------------------------------------------------------- tables

ORACLE.update({
    "actions": """SELECT CAST(user_id AS VARCHAR) AS pid, event_type AS action,
        CAST(event_id AS VARCHAR) AS rid, ts AS datetime FROM events""",
    "similar_upsert": with_(DOCUMENT, TOKENS, UNIGRAMS, WEIGHTS, PAIRS, CLASSES_OF_TEXTS, REP_PAIRS) + """
        SELECT p.uid_1, p.uid_2, round(CASE WHEN d.category = 'en' THEN score ELSE round(score, 2) END, 6) AS score
        FROM pairs p JOIN document d ON d.uid = p.uid_1""",
    "table_append": with_(DOCUMENT) + "SELECT uid, coalesce(title, '') AS title, 2 AS n FROM document",
    "document_upsert": with_(DOCUMENT) + """SELECT uid,
        CASE WHEN CAST(uid AS BIGINT) % 3 = 0 THEN coalesce(title, '') ELSE 'old' END AS title, category,
        coalesce(from_bur, '') AS from_bur,
        CASE WHEN CAST(uid AS BIGINT) % 5 = 0 THEN coalesce(from_bur, '') END AS top_terms
        FROM document WHERE CAST(uid AS BIGINT) % 4 <> 3 OR CAST(uid AS BIGINT) % 3 = 0""",
    "merged_batches": with_(DOCUMENT) + "SELECT uid, coalesce(title, '') AS title, category FROM document",
    "document_with_top_terms": DOC_TT + """SELECT uid, u_date, doc_date, addressee, classification,
        category, from_bur, from_auth, title, file_name, has_attachments,
        CAST(NULL AS VARCHAR) AS attach_urls, CAST(NULL AS VARCHAR) AS approved_bur,
        CAST(NULL AS VARCHAR) AS approved_name, CAST(NULL AS VARCHAR) AS draft_bur,
        CAST(NULL AS VARCHAR) AS draft_name, CAST(NULL AS VARCHAR) AS draft_ext,
        CAST(NULL AS VARCHAR) AS draft_phone, CAST(NULL AS VARCHAR) AS clear_blob, top_terms
        FROM doc_tt""",
})
