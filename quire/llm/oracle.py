"""DuckDB SQL of the operators that SQL can state."""

from __future__ import annotations

import re

from quire.llm.license_scan import BASE, MARK, TEMPLATES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _pattern(markup: str) -> str:
    """A template as a regular expression over words, each after a space."""
    out, at = "", 0
    for m in MARK.finditer(markup):
        out += "".join(" " + w for w in markup[at:m.start()].split())
        out += {"beginOptional": "(?:", "endOptional": ")?", "var": f"(?: [^ ]+){{0,{m[2]}}}"}[m[1]]
        at = m.end()
    return out + "".join(" " + w for w in markup[at:].split()) + " "


def _license_sql() -> str:
    """Base phrases by comparing list slices, templates by regular expressions."""
    lists = [f"list_filter(range(len(w)), lambda i: w[i + 1:i + {len(p.split())}] = {p.split()})" for p in BASE]
    flags = [(label, len(p.split()), f"len(p{i}) > 0", True) for i, (p, label) in enumerate(BASE.items())]
    for label, markup in TEMPLATES:
        plain = len(re.sub(r"<<[^<>]+>>", " ", re.sub(r"<<beginOptional>>.*?<<endOptional>>", " ", _flat(markup))).split())
        flags.append((label, plain, f"regexp_matches(s, '{_pattern(markup)}')", False))
    base = ", ".join(f"case when {test} then '{label}' end" for label, _, test, b in flags if b)
    every = ", ".join(f"case when {test} then '{label}' end" for label, _, test, _ in flags)
    most = ", ".join(f"case when {test} then {k} else 0 end" for _, k, test, _ in flags)
    joined = "coalesce(array_to_string(list_sort(list_distinct(list_filter([{}], lambda x: x is not null))), ','), '')"
    return f"""
with t as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
u as (select doc_id, w, ' ' || array_to_string(w, ' ') || ' ' as s,
             {', '.join(f'{x} as p{i}' for i, x in enumerate(lists))} from t),
v as (select *, greatest({most}) as k, {' + '.join(f'len(p{i})' for i in range(len(lists)))} as n,
             list_concat({'list_concat(' * (len(lists) - 2)}p0, {'), '.join(f'p{i}' for i in range(1, len(lists)))}) as places
      from u)
select doc_id, len(w) as n_words, n as n_base, list_min(places) as first_word, list_max(places) as last_word,
       {joined.format(base)} as base_labels, {joined.format(every)} as labels,
       case when k > 0 then k / (k + 2.0)::double else 0.0 end as score
from v"""


def _flat(markup: str) -> str:
    """Without the optional regions that stand inside another."""
    while True:
        less = re.sub(r"(<<beginOptional>>(?:(?!<<(?:begin|end)Optional>>).)*)<<beginOptional>>"
                      r"(?:(?!<<(?:begin|end)Optional>>).)*<<endOptional>>", r"\1", markup)
        if less == markup:
            return markup
        markup = less


ORACLE: dict[str, str] = {
    "op1_license_scan": _license_sql(),
    "op9_warc": """
with t as (select page_id, sha1(coalesce(html, '')) as d, strlen(coalesce(html, '')) as n from pages),
m as (select d, max(page_id) as last from t where n >= 1000 group by d)
select t.page_id, t.n as payload_bytes, t.d as payload_digest,
       case when m.last is not null and t.page_id is distinct from m.last then 'revisit' else 'response' end as record_type,
       case when t.page_id is distinct from m.last then m.last end as refers_to
from t left join m on t.d = m.d and t.n >= 1000""",
}


# Vectors are lists of the least cost after nothing (0), s (1), u (2), a (3).
_NEXT = "CASE WHEN s = 2 THEN 3 ELSE 2 END"


def _plain(s: int) -> str:
    """The least cost before a row in state s, without inserts before it."""
    keep = {0: "WHEN 's' THEN v[2] WHEN 'u' THEN v[3]", 1: "WHEN 'u' THEN v[3]", 2: "WHEN 'a' THEN v[4]",
            3: "WHEN 'u' THEN v[3]"}[s]
    return (f"least(4 + v[{s + 1}], CASE WHEN free THEN 3 + more + v[{4 if s == 2 else 3}] END, "
            f"CASE WHEN free THEN more + CASE initial {keep} END END)")


ORACLE["op13_conversation_repair"] = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(
           list_concat([CAST(n AS BIGINT)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
           lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
),
turns AS (
  SELECT CASE WHEN conv_id IS NULL THEN '' ELSE 'x' || conv_id END AS c, turn, coalesce(role, ' ') AS role,
         coalesce(text, ' ') AS text,
         xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(
             coalesce(conv_id, ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'),
             lambda x: CAST('0x' || x AS BIGINT))),
           lambda a, b: xor(t[CAST((xor(a, b) & 255) + 1 AS INTEGER)], a >> 8)), 4294967295) % 20 AS kind
  FROM conversations CROSS JOIN crc
),
damaged AS (
  SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM turns WHERE kind <> 0
),
ordered AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid,
         row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i
  FROM damaged
),
faults AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before,
         CASE WHEN solid = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM ordered
),
marked AS (
  SELECT *, fault NOT IN ('blank', 'duplicate') AS free, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more
  FROM faults
),
counts AS (
  SELECT c, count(*) AS n,
         CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY c
),
back AS (
  SELECT c, n + 1 AS i, CAST([0, 6, 3, 0] AS BIGINT[]) AS v FROM counts
  UNION ALL
  SELECT c, i, [least(p[1], 3 + p[3], 6 + p[4]), least(p[2], 3 + p[3], 6 + p[4]),
                least(p[3], 3 + p[4]), least(p[4], 3 + p[3])]
  FROM (SELECT m.c, m.i, [{", ".join(map(_plain, range(4)))}] AS p
        FROM back b JOIN marked m ON m.c = b.c AND m.i = b.i - 1)
),
trace AS (
  SELECT c, CAST(1 AS BIGINT) AS i, 0 AS s, '' AS audit, CAST(0 AS BIGINT) AS cost, CAST([] AS VARCHAR[]) AS lines
  FROM counts
  UNION ALL
  SELECT c, CASE WHEN op = 'I' THEN i ELSE i + 1 END,
         CASE op WHEN 'D' THEN s WHEN 'K' THEN kept ELSE {_NEXT} END, audit || op,
         cost + CASE op WHEN 'D' THEN 4 WHEN 'I' THEN 3 WHEN 'K' THEN more ELSE more + 3 END,
         CASE op WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
                 ELSE list_append(lines, CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END
                                         || CASE WHEN op = 'I' THEN '' ELSE text END) END
  FROM (SELECT t.*, kept, m.role, m.text, m.more,
               CASE WHEN m.i IS NOT NULL AND 4 + a.v[s + 1] = w.v[s + 1] THEN 'D'
                    WHEN 3 + w.v[{_NEXT} + 1] = w.v[s + 1] THEN 'I'
                    WHEN m.free AND kept IS NOT NULL AND m.more + a.v[kept + 1] = w.v[s + 1] THEN 'K'
                    WHEN m.i IS NOT NULL THEN 'R' END AS op
        FROM (SELECT t.*, m2.kept FROM trace t LEFT JOIN (
                SELECT c AS mc, i AS mi, s2, CASE initial || s2 WHEN 's0' THEN 1 WHEN 'u0' THEN 2 WHEN 'u1' THEN 2
                       WHEN 'a2' THEN 3 WHEN 'u3' THEN 2 END AS kept
                FROM marked CROSS JOIN range(4) AS states(s2)) m2 ON mc = t.c AND mi = t.i AND s2 = t.s) t
        JOIN back w ON w.c = t.c AND w.i = t.i
        LEFT JOIN back a ON a.c = t.c AND a.i = t.i + 1
        LEFT JOIN marked m ON m.c = t.c AND m.i = t.i)
  WHERE op IS NOT NULL
),
ended AS (
  SELECT c, arg_max(audit, length(audit)) AS audit, arg_max(cost, length(audit)) AS cost,
         arg_max(array_to_string(lines, chr(10)), length(audit)) AS lines
  FROM trace GROUP BY c
)
SELECT o.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate,
       coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal, coalesce(e.cost, 0) AS cost,
       coalesce(e.audit, '') AS audit, sha256(coalesce(e.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts n ON n.c = CASE WHEN o.conv_id IS NULL THEN '' ELSE 'x' || o.conv_id END
LEFT JOIN ended e ON e.c = n.c
"""
