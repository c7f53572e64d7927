"""BPE chunk reuse, periodic runs and conversation repair against brute force."""

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from quire.llm import bpe_codec, conversation_repair, packing, periodic_runs, queries

SF = "/root/testdata/sf0.001"
WORDS = "the of and a long list of plain words to fill some lines with text that goes on for a while".split()


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(r.choice([w + str(r.integers(30)) for w in WORDS], n))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# ------------------------------------------------------------------ BPE

COMMON = prose(900, 1)
TEXTS = {1: COMMON, 2: COMMON, 3: "An own start, don't we'll" + COMMON[100:4000] + "'re cut in a word" + COMMON[1500:],
         4: None, 5: "", 6: " \n\t  ", 7: "x", 8: COMMON[:3000] + "  " + COMMON[:3000] + "   \n", 9: "é" * 3000,
         10: "a" * 5000, 11: COMMON[37:2500] + "<|endoftext|>" + COMMON[37:2500] + "<|endoftext|>",
         12: COMMON[41:2400].replace(" ", " "), 13: COMMON[11:3000].replace(" ", "  "), 14: "naïve 日本語の文章 " * 300,
         15: "日本語の文章" * 900, 16: "日本語の文章" * 800 + COMMON, 17: "<|endoftext|>" * 200, 18: COMMON[:1] * 4000,
         19: "".join(COMMON.split()), 20: "".join(COMMON.split())[500:], 21: prose(40, 2) + "\x85　   end"}
ROWS = [*TEXTS.items(), (2, COMMON), (2, "another text of the same id"), (None, COMMON), (None, "null id")]
DOCS = "doc_id long, text string, ident string, raw string, ids int, start int, low int, packed string, period int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2, 3, "z", 4) for r in rows], DOCS).repartition(4)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_ids_equal_whole_texts(spark, tokenizer):
    ids = bpe_codec.encode(docs_of(spark, ROWS))
    got = sorted(((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.text)
                  for r in bpe_codec.decode(ids).collect()), key=repr)
    want = []
    for k, t in ROWS:
        e = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((k, tuple(e), tokenizer.decode(e, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)
    assert bpe_codec.encode(docs_of(spark, ROWS).filter("doc_id < 0")).collect() == []


def test_bpe_joins_are_repaired_wherever_texts_are_cut(tokenizer):
    c = bpe_codec.codec(bpe_codec.TOKENIZER)
    r = np.random.default_rng(5)
    pieces = [" ", "  ", "\n", "'", "'re", "'ll", "word", "Ünder", "12", "<|endoftext|>", "日本", " ", "…", "aaaa", "don't"]
    for _ in range(300):
        text = "".join(r.choice(pieces, r.integers(1, 60)))
        raw = text.encode()
        places = sorted({0, len(raw), *(len(text[:i].encode()) for i in r.integers(0, len(text) + 1, r.integers(0, 8)))})
        spans = list(zip(places, places[1:]))
        known = [(a, b - a, c.encode(raw[a:b]).astype("<u2").tobytes()) for a, b in spans if r.random() < 0.6]
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert bpe_codec.assemble(raw, known, c).tolist() == want
        # Wrong ids for a chunk, as equal hashes of unlike chunks would give.
        if known:
            wrong = [(a, n, c.encode(b"x" * n).astype("<u2").tobytes()) for a, n, _ in known]
            assert bpe_codec.assemble(raw, wrong, c).tolist() == want


def test_bpe_chunks_are_content_defined():
    a = prose(3000, 3).encode()
    b = b"some other words before " + a[777:]
    sets = []
    for t in (a, b):
        places = bpe_codec.cuts(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
        assert places[0] == 0 and places[-1] == len(t) and places == sorted(set(places))
        sets.append({t[x:y] for x, y in zip(places, places[1:])})
    assert len(sets[0] & sets[1]) >= 0.8 * len(sets[1])


def test_bpe_query(spark, tokenizer):
    rows = {r.doc_id: r for r in queries.op11_bpe_codec(spark, SF).collect()}
    for r in spark.read.parquet(SF + "/documents.parquet").collect():
        e = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        got = rows.pop(r.doc_id)
        assert (got.n_tokens, got.ids_sha256) == (len(e), sha(np.array(e, "<u4").tobytes()))
        assert got.decoded_sha256 == sha(tokenizer.decode(e, skip_special_tokens=False))
    assert not rows


# ------------------------------------------------------------------ periodic runs

def brute_runs(w):
    """Every period by itself, left to right; the smallest of equal stretches."""
    n, best = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(12, 2 * p):
                best.setdefault((i, j + p), p)
            i = j + 1
    return sorted((a, b - a, p) for (a, b), p in best.items())


def collapsed(w, runs):
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def cases():
    r = np.random.default_rng(7)
    out = [None, "", " \n ", "one", "a " * 11, "a " * 12, "a " * 300, "a b " * 6, "a b c d e f " * 2, "a b c d e f g " * 2,
           "x y " * 30, "a a a a a a a a a a a a b a a a a a a a a a a a a", ("a " * 20 + "b ") * 9,
           " ".join(f"w{i}" for i in range(500)) + " " + " ".join(f"w{i}" for i in range(500)) + " w0",
           " ".join(f"w{i % 37}" for i in range(1500)) + " " + " ".join(f"w{i % 63}" for i in range(900))]
    fib = ["a", "a b"]
    while len(fib[-1]) < 800:
        fib.append(fib[-1] + " " + fib[-2])
    out.append(fib[-1])
    for k in range(60):
        n = int(r.integers(1, 400))
        out.append(" ".join(map(str, r.integers(0, 1 + k % 4, n))))
        block = r.integers(0, 5, int(r.integers(1, 90))).tolist()
        at = int(r.integers(0, 50))
        line = r.integers(0, 9, at).tolist() + (block * 9)[:int(r.integers(len(block), 8 * len(block) + 1))]
        out.append(" ".join(map(str, line + r.integers(0, 9, 30).tolist())))
    return out


def test_periodic_runs(spark):
    rows = [*enumerate(cases()), (7, "a " * 300), (7, "a b " * 6), (None, "b " * 40), (None, "c d " * 40)]
    got = sorted(((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed, r.collapsed_sha256)
                  for r in periodic_runs.runs_and_collapsed(docs_of(spark, rows)).collect()), key=repr)
    want = []
    for k, t in rows:
        w = words_of(t)
        runs = brute_runs(w)
        kept = collapsed(w, runs)
        want.append((k, len(w), tuple(runs), kept if runs else None, sha(kept)))
    assert got == sorted(want, key=repr)
    none = docs_of(spark, rows).filter("doc_id < 0")
    assert periodic_runs.digest(periodic_runs.runs_and_collapsed(periodic_runs.planted(none))).collect() == []


def test_long_texts_take_n_log_n_steps():
    codes = np.zeros(40_000, np.int32)
    for doc, low, at, periods in periodic_runs.tiles_of(codes, np.array([0, len(codes)])):
        assert len(periods) <= 2 * low + 8
    assert len(set(periodic_runs.stitched([(3, 0, 20), (3, 17, 40), (3, 38, 60), (4, 1, 20)]))) == 3


def test_periodic_query(spark):
    rows = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    for r in spark.read.parquet(SF + "/documents.parquet").collect():
        w = words_of(r.text)
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        got = rows.pop(r.doc_id)
        if n > 2500:  # too long for brute force
            continue
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (got.n_runs, got.start, got.length, got.period) == (len(runs), *best)
        assert got.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert got.runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs))
        assert got.collapsed_sha256 == sha(collapsed(w, runs))
    assert not rows


# ------------------------------------------------------------------ conversations

def brute_repair(rows):
    """rows after damage, in order: all counts, the audit as the least (cost,
    string) of what follows."""
    seen, flags = set(), []
    for turn, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        flags.append("blank" if not solid else "duplicate" if (role, text) in seen
                     else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {}
    for i in range(len(rows), -1, -1):
        for state in ("", "s", "u", "a"):
            best[i, state] = (0, "", ()) if i == len(rows) and state in ("", "a") else None
        options = {s: [best[i, s]] if best[i, s] else [] for s in ("", "s", "u", "a")}
        if i < len(rows):
            _, role, text = rows[i]
            for s in options:
                c, a, out = best[i + 1, s]
                options[s].append((c + 4, "D" + a, out))
                if flags[i] not in ("blank", "duplicate"):
                    more = 3 if flags[i] == "truncated" else 0
                    if (s, role[:1]) in steps:
                        c, a, out = best[i + 1, steps[s, role[:1]]]
                        options[s].append((c + more, "K" + a, ((role, text), *out)))
                    new = "assistant" if s == "u" else "user"
                    c, a, out = best[i + 1, steps[s, new[0]]]
                    options[s].append((c + more + 3, "R" + a, ((new, text), *out)))
        for _ in range(3):
            for s in options:
                new = "assistant" if s == "u" else "user"
                options[s] += [(c + 3, "I" + a, ((new, ""), *out)) for c, a, out in options[steps[s, new[0]]][:1]]
                options[s] = sorted(options[s])[:1]
        for s in options:
            best[i, s] = options[s][0]
    cost, audit, out = best[0, ""]
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [(a[1][:1], b[1][:1]) for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(flags.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in [("s", "u"), ("u", "a"), ("a", "u")] for p in pairs), cost, audit,
            sha("\n".join(f"{r}:{t}" for r, t in out)))


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_, turn_, role, text = (" " if v is None else v for v in (conv, turn, role, text))
        k = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1].encode(), hashlib.md5(r[2].encode()).digest()))


def brute_all(rows):
    convs = {}
    for conv, *_ in rows:
        convs[conv] = []
    for conv, *rest in damage(rows):
        convs[conv].append(tuple(rest))
    return {k: brute_repair(ordered(v)) if v else (0, 0, 0, 0, 0, 0, "", sha("")) for k, v in convs.items()}


TURNS = "conv_id string, turn long, role string, text string, part int, seq int, h string, codes string, want int"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y", 3) for r in rows], TURNS).repartition(5)


def random_turns(n, convs, seed):
    r = np.random.default_rng(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "Assistant"]
    texts = ["yes.", "no!", "what?", "cut off", " ", "", None, "ends. \n", " ", "é"]
    out = []
    for i in range(n):
        text = texts[r.integers(len(texts))] if r.random() < 0.4 else f"text {r.integers(200)}" + (" done." if r.random() < 0.8 else "")
        out.append((f"c{r.integers(convs)}" if r.random() < 0.97 else None,
                    int(r.integers(12)) if r.random() < 0.95 else None, roles[r.integers(len(roles))], text))
    return out


def fields(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)


def run(spark, rows):
    turns = turns_of(spark, rows)
    return {r.conv_id: fields(r) for r in conversation_repair.repair(
        conversation_repair.damaged(turns), turns.select("conv_id")).collect()}


def test_conversations(spark):
    rows = random_turns(700, 90, 1) + [("lone", 3, "system", "only this."), ("s", None, "system", "a."), ("s", None, "user", "b.")]
    rows += [("gone", t, "user", "x.") for t in range(400) if zlib.crc32(f"gone:{t}".encode()) % 20 == 0][:2]
    want = brute_all(rows)
    assert want["gone"] == (0, 0, 0, 0, 0, 0, "", sha("")) and None in want
    assert run(spark, rows) == want
    assert run(spark, rows[:0]) == {}


@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_chunks_converge(spark, chunk):
    """One long conversation in many chunks and partitions."""
    r = np.random.default_rng(3)
    rows = [("hot", int(t), str(r.choice(["user", "assistant"], p=[0.5, 0.5])),
             f"t{r.integers(400)}" + str(r.choice([".", ""], p=[0.7, 0.3]))) for t in r.permutation(600)]
    rows += [("tail", t, "aaaauser"[t % 8:] or "user", f"t{t}.") for t in range(60)]
    keyed = conversation_repair.keyed(conversation_repair.damaged(turns_of(spark, rows)))
    found = conversation_repair.audits(keyed, chunk)
    pieces = {}
    for p in sorted(found.collect(), key=lambda p: (p.part, p.seq)):
        pieces.setdefault(p.conv_id, []).append(p)
    assert len(pieces["hot"]) > 600 / max(chunk, 150) / 2
    for conv, want in brute_all(rows).items():
        assert "".join(p.audit for p in pieces[conv]) == want[6]
        assert sum(p.cost for p in pieces[conv]) == want[5]
    lines = {}
    for p in sorted(conversation_repair.repaired(keyed, found, 50).collect(), key=lambda p: p.place):
        lines.setdefault(p.conv_id, []).append(f"{p.role}:{p.text}")
    hashes = {p.conv_id: p.repaired_sha256 for p in conversation_repair.hashes(keyed, found).collect()}
    for conv, want in brute_all(rows).items():
        assert sha("\n".join(lines.get(conv, []))) == want[7] == hashes[conv]


def test_conversation_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(SF + "/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: fields(r) for r in queries.op13_conversation_repair(spark, SF).collect()}
    assert got == brute_all(rows)


# ------------------------------------------------------------------ packing: words to ids

def test_word_ids_equal_whole_texts():
    """Every letter of the plain range with marks, odd spaces, forgetting."""
    ids = packing.Ids(packing.tokenizer_path(), most=3000)
    letters = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x250)]]
    texts = [" ".join(f"{c}{m} x{c}y{m}{m}" for c in letters) for m in ("", ".", "!?", "(", "%$#")]
    texts += ["Xİ. İ", "", None, "  ", "a\x0bb\x0cc\x1cd\x85e\u3000f\u2028g\xa0h", "don't we'll o'clock 's", "12ab ab12. é1",
              "word" * 900, "日本語 text.", "...!!! ?", "<|startoftext|> x<|endoftext|>y", *(prose(300, i) for i in range(6))]
    for _ in range(2):
        for part in (texts[:7], texts[7:9], [], texts[9:], texts):
            got, bounds = ids.of(part)
            for t, a, b in zip(part, bounds, bounds[1:]):
                assert got[a:b].tolist() == [*ids.model.encode(t or "", add_special_tokens=False).ids, packing.END]


def test_pages_move_packed(spark):
    """Pages are packed for the join, with or without others at hand, and come out whole."""
    import zstandard
    from quire.llm import html_text
    body = "<html><body><nav>menu</nav><article><p>%s</p></article></body></html>"
    rows = [(i, "http://h/x", body % (f"ä😀\x00 {i} " * (i % 40)), i) for i in range(400)] + [(400, None, None, 0), (401, "", "", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key long").repartition(3)
    for known in (html_text.heads(pages), html_text.heads(pages.limit(0)), b"short"):
        z = zstandard.ZstdDecompressor(dict_data=html_text._dictionary(known))
        got = html_text.packed(pages, known).collect()
        assert {(r["page_id"], r["url"], z.decompress(r["page"]).decode(), r["key"]) for r in got} == {
            (i, u, h or "", k) for i, u, h, k in rows}
        if len(known) > 5:
            assert 2 * sum(len(r["page"]) for r in got) < sum(len((h or "").encode()) for _, _, h, _ in rows)
