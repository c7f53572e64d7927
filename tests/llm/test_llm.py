"""Operators on small tables with nulls, empty and long texts, repeats, empty
tables and clashing columns, held against brute force."""

import hashlib
import html as html_
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import (decontaminate, html_text, language_id, license_scan, near_dup, nn_descent, packing,
                       substring_dedup, toxicity, warc)
from quire.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, score double, tkey string, node int, row int, m_id long"
WORDS = "the of and a long list of plain words to fill some lines with text that goes on for a while".split()


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(r.choice([w + str(r.integers(30)) for w in WORDS], n))


LONG = prose(3000, 1)
TEXTS = {1: LONG, 2: LONG, 3: LONG[:9000] + " changed a little here " + LONG[9000:], 4: None, 5: "", 6: " \n\t ",
         7: "Only three words", 8: "only THREE words", 9: prose(200, 2), 10: prose(200, 2) + " more", 11: "%%% *** 12 34",
         12: "aaaa " * 300, 13: "é" * 250 + prose(40, 3), 14: prose(40, 4) + "é" * 250, 15: LONG[3000:9000][::-1],
         20: "Released under the MIT License.", 21: "x " * 6000}


def table(spark, extra=()):
    rows = [(k, v, 0.9, "x", 1, 2, 3) for k, v in [*TEXTS.items(), *extra]]
    return spark.createDataFrame(rows, DOCS).repartition(3)


REPEATED = [(9, TEXTS[9]), (None, "a null id " * 30), (None, TEXTS[9])]


def sets(t, k=5):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_duplicates(spark):
    rows = [*TEXTS.items(), *REPEATED]
    out = near_dup.near_duplicates(table(spark, REPEATED)).collect()
    assert len(out) == len(rows)
    all_ = [(k, sets(t)) for k, t in rows]
    group = {i: {i} for i in range(len(all_))}
    for i, (_, a) in enumerate(all_):
        for j, (_, b) in enumerate(all_):
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and group[i] is not group[j]:
                group[i] |= group[j]
                for m in group[j]:
                    group[m] = group[i]
    want = sorted((str(k), len(s), str(min([all_[m][0] for m in group[i] if all_[m][0] is not None], default=None)))
                  for i, (k, s) in enumerate(all_))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == want
    assert near_dup.near_duplicates(table(spark).limit(0)).count() == 0


def test_near_links_between_members_only(spark):
    """Members near each other but not near the ends of their buckets."""
    base, rng = [f"w{i}" for i in range(300)], np.random.default_rng(5)
    rows = []
    for i in range(40):
        w = list(base)
        for j in rng.choice(300, rng.integers(4, 22), replace=False):
            w[j] = f"x{i}_{j}"
        rows.append((i, " ".join(w)))
    s = [sets(t) for _, t in rows]
    root = list(range(40))
    for _ in range(40):
        for i in range(40):
            for j in range(40):
                if 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                    root[i] = root[j] = min(root[i], root[j])
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in out.collect()} == dict(enumerate(root))


def test_bayesian_bounds_keep_the_threshold():
    need = near_dup.least_matches(128, 16, 0.75, 1e-7)
    assert need == sorted(need) and need[-1] < 96 and need[-1] > 60


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 102), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100}


def brute_substrings(rows, n=100):
    seen, out = {}, []
    for key in sorted({(k is None, k or 0, t or "") for k, t in rows}):
        b = key[2].encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if seen.setdefault(b[p:p + n], (key, p)) != (key, p):
                gone[p:p + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((str(None if key[0] else key[1]), len(b), len(b) - len(kept),
                    sum(1 for s in bytes(gone).split(b"\0") if s), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 1])
def test_substring_dedup(spark, hot):
    rows = [*TEXTS.items(), (None, "a null id " * 30), (30, TEXTS[9])]
    out = substring_dedup.deduplicate(table(spark, rows[len(TEXTS):]), hot=hot).collect()
    assert sorted((str(r.doc_id), *r[2:6]) for r in out) == sorted(brute_substrings(rows))
    # A repeated row is the same document.
    again = substring_dedup.deduplicate(table(spark, [(9, TEXTS[9])]).filter("doc_id = 9")).collect()
    assert len(again) == 2 and {r.n_removed for r in again} == {0}
    assert substring_dedup.deduplicate(table(spark).limit(0)).count() == 0


def test_anchors_do_not_depend_on_segments(monkeypatch):
    texts = [LONG.encode(), b"ab" * 400, LONG[500:].encode()]
    def cover():
        doc, off, h, _, lo, hi = substring_dedup.anchors(texts)
        return {(d, w): (o, x) for d, o, x, a, b in zip(doc, off, h, lo, hi) for w in range(a, b)}
    whole = cover()
    monkeypatch.setattr(substring_dedup, "SEGMENT", 333)
    monkeypatch.setattr(substring_dedup, "BUFFER", 1000)
    assert cover() == whole and len(whole) == sum(len(t) - 99 for t in texts)


def test_decontaminate(spark):
    items = [(1, prose(30, 50)), (2, prose(24, 51)), (3, "three little words"), (4, None), (5, ""), (1, prose(30, 50))]
    a, b = items[0][1].split(), items[1][1].split()
    rows = [(100, "Before. " + items[0][1].upper() + ", after"), (101, " ".join(a[15:] + ["gap"] + a[:15])),
            (102, " ".join(b[:6])), (103, "so: three, little words!"), (104, None), (105, ""),
            (106, " ".join(b) + " " + " ".join(a))]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, matches string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(100, 1), (101, 1), (103, 3), (106, 1), (106, 2)}
    for most in (decontaminate.MOST_SEEDS, 0):
        out = decontaminate.tiled(docs, bench, most_seeds=most)
        got = {(r.doc_id, m.item_id): m for r in out.collect() for m in r.matches}
        assert set(got) == want and out.count() == len(rows)
        assert got[101, 1].covered == 30 and got[101, 1].tiles == 2
    assert {len(r.matches) for r in decontaminate.tiled(docs, bench.limit(0)).collect()} == {0}


def test_packing(spark):
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(packing.tokenizer_path())
    rows = [*TEXTS.items(), *REPEATED, *[(200 + i, prose(int(n), i)) for i, n in enumerate(
        np.random.default_rng(0).integers(5, 900, 150))]]
    out = packing.pack(table(spark, rows[len(TEXTS):])).collect()
    want = defaultdict(int)
    for k, t in rows:
        ids = np.array(model.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for n, at in enumerate(range(0, len(ids), 4096)):
            cut = ids[at:at + 4096]
            want[k, n, at, len(cut), zlib.crc32(cut.tobytes())] += 1
    got = defaultdict(int)
    for r in out:
        got[tuple(r)[:5]] += 1
    assert got == want
    seq = defaultdict(list)
    for r in out:
        seq[r.sequence_id].append((r.offset, r.length))
    for s in seq.values():
        end = 0
        for at, n in sorted(s):
            assert at == end
            end += n
        assert end <= 4096
    room = []       # best-fit decreasing
    for n in sorted((r.length for r in out), reverse=True):
        fits = [i for i, x in enumerate(room) if x >= n]
        if fits:
            room[min(fits, key=room.__getitem__)] -= n
        else:
            room.append(4096 - n)
    assert len(seq) <= len(room) + 1
    assert packing.pack(table(spark).limit(0)).count() == 0


def test_licenses(spark):
    base = license_scan.BASE
    texts = [*TEXTS.values(), "Licensed under the Apache License, Version 2.0 (the...)", "UNDER THE MIT LICENSE under the mit license",
             "licensed under cc by-nc 4.0", "Licensed under the terms of the GNU General Public License", "under the mitlicense",
             "Copyright (c) 2020 by someone. All rights reserved", "under the mit é license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.scan(docs.withColumn("labels", F.lit(1))).collect():
        t = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id] or "")
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        hits = [(i, v) for p, v in base.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        own = sorted({v for _, v in hits})
        assert (r.n_words, r.n_base) == (len(w), len(hits)) and r.base_labels == ",".join(own)
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert set(own) <= set(r.labels.split(",")) | {""} or not own
        assert 0 <= r.score < 1 and (r.score > 0) == bool(r.labels)
    a = license_scan.compile_template("x", "a <<beginOptional>>b c<<endOptional>> d <<var;most=2>> e")
    ok = ["a d e", "a b c d e", "a d x e", "a d x y e"]
    no = ["a b d e", "a d x y z e", "a c d e", "d e"]
    assert all(a.match(t.encode().split(), 0) > 0 for t in ok) and all(a.match(t.encode().split(), 0) < 0 for t in no)


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        w = list(rng.choice(WORDS, 60))
        if i % 5 == 0:
            for j in rng.choice(60, 3, replace=False):
                w[j] = rng.choice(["vile", "rottenish", "xzqvbad"])
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    docs = spark.createDataFrame([(i, t, 7.0) for i, t, _ in rows] + [(1000, None, 7.0), (1001, "", 7.0), (1002, "%%", 7.0)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, sample=400)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (y == 1) for i, y in held]) > 0.97
    assert all(got[i] < 0.5 for i in (1000, 1001, 1002))
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in toxicity.start_net(rng).items()}
    y = np.array([1, 0, 1, 0])
    parts = [toxicity.segment(rng.standard_normal((n, toxicity.INPUTS)), at) for n, at in ((90, 30), (20, 0), (1, 0), (40, 8))]
    x, has, pool = (np.stack(p) for p in zip(*parts))

    def loss(m):
        p = toxicity.sigmoid(toxicity.forward(m, x, has, pool))
        return -np.sum(y * np.log(p) + (1 - y) * np.log(1 - p))
    k = {}
    g = toxicity.backward(net, k, (toxicity.sigmoid(toxicity.forward(net, x, has, pool, k)) - y))
    for name in net:
        at = tuple(rng.integers(s) for s in net[name].shape)
        up, down = ({**net, name: net[name].copy()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert np.isclose((loss(up) - loss(down)) / 2e-2, g[name][at], rtol=0.05, atol=5e-3), name


def test_every_window_is_scored():
    rng = np.random.default_rng(6)
    net = toxicity.start_net(rng)
    docs = [(rng.random((n, 3)) * (rng.random((n, 1)) < .1)).astype(np.float32) for n in (1, 20, 32, 33, 57, 100, 900, 0, 40)]
    docs.append(np.zeros((700, 3), np.float32))  # blocks without any evidence
    top, where = toxicity.document_logits(net, docs, most=3)
    B, C = toxicity.BLOCK, toxicity.CONTEXT
    for x, s, at in zip(docs, top, where):
        h = np.zeros((len(x), 2 * toxicity.HIDDEN))
        for b in range(0, len(x), B):  # each block by itself, with the words around it
            part = x[max(0, b - C):b + B + C]
            own = toxicity.states(net, part[:, None], np.ones((len(part), 1), bool))[:, 0]
            h[b:b + B] = own[b - max(0, b - C):][:B]
        each = [-np.inf]
        if len(x):
            each = []
            for i in range(max(1, len(x) - 31)):
                e = (np.tanh(h[i:i + 32] @ net["a"]) @ net["v"])[:, 0]
                w = np.exp(e - e.max())
                each.append(((w / w.sum() @ h[i:i + 32]) @ net["o"] + net["ob"][0]).item())
        assert np.isclose(s, max(each), atol=1e-5) and (not len(x) or np.isclose(each[at], max(each), atol=1e-5))


def test_language(spark):
    abc = {"aa": "bcdab", "bb": "xyzwx", "cc": "mnopq"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join("".join(rng.choice(list(abc[lang]), 6)) for _ in range(1 + i % 400)), lang)
            for i in range(90) for lang in [list(abc)[i % 3]]]
    docs = spark.createDataFrame([(*r, 1) for r in rows] + [(500, None, "aa", 1), (501, "12 %", "aa", 1), (502, "", None, 1)],
                                 "doc_id long, text string, lang string, score int")
    out = {r.doc_id: r for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows) and all(0 <= r.score <= 1 for r in out.values())
    assert all(out[i].lang_pred == "und" for i in (500, 501, 502))
    empty = language_id.identify(docs, language_id.fit(docs.limit(0))).collect()
    assert {r.lang_pred for r in empty} == {"und"}


def test_cross_parse_counts_longest_phrases():
    model = language_id.fit_texts({"x": "banana bandana", "y": "nothing like it"})
    p = language_id.Parser(model)
    text = "bananas and bandanas"
    s = p.symbols_of(text)
    for j, t in enumerate(("banana bandana", "nothing like it")):
        at = count = 0
        while at < len(text):
            n = max((k for k in range(1, len(text) - at + 1) if text[at:at + k] in t), default=1)
            at, count = at + n, count + 1
        assert p.phrases(s[None].astype(np.int32), np.array([len(s)]))[0, j] == count


PAGES = [(1, "http://a.com/1", "x" * 1500), (2, None, "x" * 1500), (3, "http://a.com/3", "x" * 1500), (4, "u r\nl é", "short"),
         (5, None, "short"), (6, "http://b", None), (7, "http://b", ""), (None, None, "y" * 1200), (8, "", "y" * 1200),
         (9, None, "\x1f\x8b\x08 WARC/1.1 é" * 200), (10, None, "".join(np.random.default_rng(0).choice(list("abcdé\n"), 300_000)))]


def test_warc(spark):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int").repartition(3)
    files = warc.write_archives(pages)
    for step in (97, 5000, warc.RANGE):
        out = warc.read_archives(spark, files, step=step, payload=True).collect()
        got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out)
        refers = {1: 3, 2: 3, None: 8}
        assert got == sorted((str(k), len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest(),
                              "revisit" if k in refers else "response", refers.get(k)) for k, _, t in PAGES)
        assert {r.page_id: bytes(r.payload) for r in out if r.record_type == "response"} == {
            k: (t or "").encode() for k, _, t in PAGES if k not in refers}
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0))).count() == 0


def test_main_text(spark):
    page = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li>Menu</ul></nav>"
            "<div class='ad'>Buy</div><main><article><h1>One &amp;\n two</h1><p>Some <b>bold<br>text<p>Next&nbsp;&eacute;"
            "<div class='comments'><p>First!</p></div><form><input><p>Sign</p></form><ul><li>a<li>b</ul><script>var t='</p>';</script>"
            "<!-- no --></article></main><aside>Side</aside><footer>&copy;</footer></body></html>")
    same = "".join(f"<div><p>{x}</p></div>" for x in ())
    rows = [(1, "http://a.com/", page), (2, None, None), (3, "::", ""), (4, "http://a.com", "plain &lt;text&gt; <p>unclosed"),
            (5, "x", "<div hidden>no</div><p>yes</p><p title='>'>quoted"), (6, "x", "a < b <p>c" + same), (1, "http://a.com/", page)]
    # Pages of one host without names: a part that repeats on all of them goes.
    rows += [(100 + i, "http://h.org/p", f"<body><div><p>Welcome to our pages</p></div><section><p>Story {i} {prose(30, i)}</p>"
              f"</section></body>") for i in range(20)]
    out = html_text.extract(spark.createDataFrame([(*r, "x") for r in rows],
                                                  "page_id long, url string, html string, text string")).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert got[1] == "One & two Some bold text Next é a b"
    assert (got[2], got[3], got[4], got[5], got[6]) == ("", "", "plain <text> unclosed", "yes quoted", "a < b c")
    for i in range(20):
        assert got[100 + i] == f"Story {i} {prose(30, i)}"


def main_texts(spark, pages):
    df = spark.createDataFrame([(i, "http://one.org/p", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_text.extract(df).orderBy("page_id").collect()]


def test_main_text_by_importance(spark):
    own = [prose(40, 100 + i) for i in range(20)]
    # Unnamed parts that repeat go, inside and outside the main part, whatever their tags.
    got = main_texts(spark, [
        f"<body><p>Hello from us</p><article><h2>Our terms apply</h2><p>{t}</p><p>Write to us at any time</p><ul><li>First reader"
        f"<li>Second reader</ul><table><tr><td>Price list</table><blockquote>{t[::-1]}</blockquote></article></body>" for t in own])
    assert got == [f"{t} {t[::-1]}" for t in own]
    # Cards in several articles beside the story; what repeats of them goes.
    got = main_texts(spark, [f"<body><div><p>{t}</p><p>{t[::-1]}</p></div><article><p>Card of the day</p></article>"
                             f"<article><p>Next {i}</p></article></body>" for i, t in enumerate(own)])
    assert got == [f"{t} {t[::-1]} Next {i}" for i, t in enumerate(own)]
    # The tree overrules a name that most of the varied text has; other names still count.
    got = main_texts(spark, [f"<body><nav>Go {i}</nav><div class='with-sidebar'><p>{t}</p><div class='sidebar'>Seen {i}</div></div>"
                             f"<span class='share'>Tell {i}</span></body>" for i, t in enumerate(own)])
    assert got == own
    # Few pages, or copies of one: names decide.
    page = f"<body><nav>Go</nav><article><p>{own[0]}</p><p>To all</p></article></body>"
    assert main_texts(spark, [page] * 20) == main_texts(spark, [page] * 2)[:1] * 20 == [own[0] + " To all"] * 20


def test_main_text_weighs_every_look(spark):
    """A look of 0.625 counts as that, so the mean of the div is 0.298 where its text is on 6 of 16 pages."""
    own = [prose(40, 200 + i) for i in range(16)]
    looks = [0, 0, 1, 1, 2, 2, 3, 3, *[4] * 4, *[5] * 4]
    got = main_texts(spark, [
        f"<body><section>{t}</section><div><p>{'On six pages' if i % 3 == 0 else f'Own {i}'}</p>"
        + "".join(f"<h{5 + (looks[i] >> j & 1)}></h{5 + (looks[i] >> j & 1)}>" for j in range(4)) + "</div></body>"
        for i, t in enumerate(own)])
    assert got == [t if i % 3 == 0 else f"{t} Own {i}" for i, t in enumerate(own)]


def brute_nearest(rows, queries, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, v in ok:
        if i in queries:
            near = sorted((-float(v @ w), j) for j, w in {(j, tuple(w)): (j, w) for j, w in ok}.values() if j != i)[:k]
            out[i] = [(j, round(-s, 9)) for s, j in near]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-8, 9, 8).astype(float).tolist()) for i in range(200)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [1.0] * 7 + [None]), (304, [float("inf")] * 8), (None, rows[1][1]),
             (305, [1.0, 2.0]), rows[5]]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    want = brute_nearest([r for r in rows if r[0] != 305], {i for i, _ in rows if i is not None and i % 20 == 0}, 20)
    got = defaultdict(list)
    for r in sorted(nn_descent.nearest(df, F.col("vec_id") % 20 == 0, rounds=2).collect()):
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    assert set(got) == set(want)
    hit = sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))
    assert hit >= 0.95 and got[0][0][1] == want[0][0][1]
    few = nn_descent.nearest(df.filter("vec_id in (1, 2, 20)"), F.col("vec_id") % 20 == 0)
    assert sorted(r.vec_id for r in few.collect()) == [1, 2]
    assert nn_descent.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_walk_goes_on_until_the_beam_is_expanded(spark):
    """The nearest is 12 edges away, and the beam holds more than one step expands."""
    x = [[float(np.cos(i / 10)), float(np.sin(i / 10))] for i in range(13)]
    found = spark.createDataFrame([(i, v) for i, v in enumerate(x[::-1])], "node long, emb array<double>")
    graph = spark.createDataFrame([(12 - i, 11 - i) for i in range(12)], "a long, b long")
    starts = spark.createDataFrame([(12,)], "q long")
    got = nn_descent.search(starts, graph, found, nn_descent.small(found), beam=40, width=1)
    assert {r.x for r in got.collect()} == set(range(13))


def test_graph_converges_on_many_leaves(spark):
    x = np.random.default_rng(4).standard_normal((1500, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[0] *= 9       # named a neighbour by half of all
    found = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, emb array<double>")
    compact = nn_descent.stored(nn_descent.small(found), "compact")
    edges = {(r.a, r.b) for r in nn_descent.build(compact, k=8, tries=3, leaf=8, back=8).collect()}
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    want = [(i, int(j)) for i, near in enumerate(np.argsort(-s, axis=1)[:, :8]) for j in near]
    assert np.mean([e in edges for e in want]) > 0.95


def test_pipeline(spark):
    import corpus_pipeline as c
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in c.STAGES[:-1]:
        before, kept = kept, c.stored(stage(spark, kept, SF), "test")
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    packed = c.STAGES[-1][1](spark, kept, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {
        r.doc_id for r in kept.select("doc_id").collect()}


def test_pipeline_odd_rows(spark):
    import corpus_pipeline as c
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("tkey", F.lit("x")).limit(40)
    odd = docs.limit(4).withColumn("text", F.lit(None).cast("string")).unionByName(
        docs.limit(4).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs).unionByName(docs.limit(3))
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == docs.columns
        n = out.count()
        assert 0 < n <= odd.count()
        assert stage(spark, odd.limit(0), SF).count() == 0
    one = c.keep_one_of_near_duplicates(spark, docs.limit(3).unionByName(docs.limit(3)), SF)
    assert one.count() == one.select("doc_id").distinct().count()


def test_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from quire.llm.oracle import ORACLE
    from quire.llm.queries import QUERIES
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in ORACLE.items():
        got = QUERIES[name](spark, SF)
        rows = con.execute(f"select {', '.join(got.columns)} from ({sql})").fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows)), name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_main_text_of_the_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in pages.join(html_text.extract(pages).select("page_id", "text"), "page_id").collect():
        part = r.html.split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(html_.unescape(re.sub("<[^>]*>", " " if "br" in b else "", b)).split())
                  for b in re.split(r"</?(?:p|h\d)>", part.replace("<br>", " ")))
        assert r.text == " ".join(b for b in blocks if b)
