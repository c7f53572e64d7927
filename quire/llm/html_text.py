"""Main text of pages by site style trees.

The pages of a host are merged into one tree of styles: a node is a path of
element names with their classes.  Grouping by host and path gives, for each
node, how varied its presentation is (the entropy of the sequences of its
children over the pages), and for each text in it on how many of the node's
pages it stands: a text's importance is one less the entropy of its pages.  A
page's branches are weighed bottom up, as its style tree says.  Branches and
texts of low importance go, whatever their tag and wherever they stand.

Names are a prior.  Text in elements whose names say that they are menus, ads
or the like, and text outside article and main on pages that have them, is
left out; but where a group of such text (that of one path, or all outside)
holds most of what varies on a host, the tree overrules the names and it is
weighed as all else.  Paths that few pages share are left to the names.

No host is gathered in one task: all sums are aggregates by path, and a page
gets the nodes and repeated texts of its own paths only.
"""

from __future__ import annotations

import html as _html
import math
import re

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, stored

# --- fixed values: how HTML reads ---
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags that end an open p, and tags that end an open one of the same kind.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th")}
SCOPE = frozenset("ul ol dl table select div article section main body td th".split())
# --- end of fixed values ---
#: Elements that hold no text of the page, and elements and words in a class, id or role that speak against main text.
DROPPED = frozenset("head script style noscript template svg math object iframe button select option textarea input "
                    "canvas audio video map datalist title".split())
AGAINST = frozenset("nav footer aside form label menu dialog".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion "
                  "banner banners nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar "
                  "sidebars aside widget widgets related recommended recommendations share sharing social comment "
                  "comments commentlist disqus replies reply respond newsletter subscribe subscription signup login cookie "
                  "cookies consent gdpr notice notices alert alerts popup modal overlay pagination pager toolbar "
                  "copyright complementary contentinfo search form".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
                   r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
#: Least importance of a branch, pages that must share a path, decay of the paper's composite importance.
LOW, LEAST_PAGES, DECAY = 0.3, 5, 0.9
#: Text the names speak against is kept where it has so many times the varied characters of the text they favour.
OVERRULE = 2
#: Least share of a page's characters that vary; below, all of it repeats, as on copies of one page.
VARIED = 0.05
#: Pages that move are packed with the beginnings of so many others at hand, of so many characters each.
HEADS, HEAD_CHARS, PACK_LEVEL = 16, 4096, 6
#: The main parts, and the group of the text outside them.
MAIN, OUTSIDE = frozenset(("article", "main")), 1


class Element:
    __slots__ = ("tag", "path", "parent", "children", "blocks", "state", "group", "inline")

    def __init__(self, tag, path, parent, state, group=0):
        self.tag, self.path, self.parent, self.state, self.group = tag, path, parent, state, group
        self.inline = False
        self.children: list[Element] = []
        self.blocks: list[int] = []


def _traits(tag: str, attrs: str, inside: bool) -> tuple[str, bool, bool]:
    """(style of the element, whether it shows no text, whether its names
    speak against it)."""
    dropped, against = tag in DROPPED, tag in AGAINST or (tag == "header" and not inside)
    if not attrs.strip(" /"):
        return tag, dropped, against
    style = tag
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            names = [w.lower() for w in NAME.findall(value)]
            if tag not in ("html", "body", "article", "main"):
                against = against or any(w in WORDS for w in names)
            style += "." + "-".join(names)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (
                name == "style" and "display:none" in value.replace(" ", "").lower()):
            dropped = True
    return style, dropped, against


def parse(markup: str) -> tuple[Element, list[str]]:
    """(root, texts of the blocks in page order).  Blocks are the runs of
    text between block elements, with references decoded and white space
    turned into single spaces; dropped elements have none.  An element's
    state is dropped (-1), inside the main part (1) or neither (0); its group
    is the path of the nearest element that names speak against, or 0."""
    root = Element("", 0, None, 0)
    blocks: list[str] = []
    now, text, at = root, [], 0

    def flush():
        if text:
            t = " ".join(_html.unescape("".join(text)).split())
            text.clear()
            if t:
                e = now
                while e.inline:
                    e = e.parent
                e.blocks.append(len(blocks))
                blocks.append(t)

    def close(to):
        nonlocal now
        flush()
        now = to

    size = len(markup)
    while at < size:
        m = TOKEN.search(markup, at)
        if now.state >= 0:
            text.append(markup[at:m.start() if m else size])
        if m is None:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            e = now
            while e is not root and e.tag != tag:
                e = e.parent
            if e is not root:
                if e.inline:
                    # A formatting element does not close a block opened in it.
                    f = now
                    while f is not e and f.inline:
                        f = f.parent
                    if f is e:
                        now = e.parent
                else:
                    close(e.parent)
            elif tag in ("p", "br") and now.state >= 0:
                flush() if tag == "p" else text.append(" ")
            continue
        if tag in ENDS_P or tag in SAME:
            kinds = SAME.get(tag, ()) + (("p",) if tag in ENDS_P else ())
            e, last = now, None
            while e is not root and (e.tag in kinds or e.tag not in SCOPE):
                if e.tag in kinds:
                    last = e
                e = e.parent
            if last is not None:
                close(last.parent)
        if tag == "br":
            text.append(" ") if now.state >= 0 else None
            continue
        style, dropped, against = _traits(tag, m[3] or m[6] or "", now.state == 1)
        inline = tag in INLINE and not against      # a name makes it a branch of its own
        if not inline:
            flush()
        state = -1 if dropped or now.state < 0 else 1 if now.state == 1 or tag in MAIN else 0
        path = xxhash.xxh3_64_intdigest(f"{now.path} {style}") >> 1
        child = Element(tag, path, now, state, path if against else now.group)
        child.inline = inline
        if not inline:
            e = now
            while e.inline:
                e = e.parent
            e.children.append(child)
        if tag in RAW:      # its text is no markup, and never main text
            end = re.compile(f"</{tag}", re.I).search(markup, at)
            at = end.start() if end else size
        if tag not in VOID and not (m[3] or m[6] or "").endswith("/"):
            now = child
        elif not inline:
            flush()
    flush()
    return root, blocks


def walk(root: Element):
    todo = [root]
    while todo:
        e = todo.pop()
        yield e
        todo += e.children


def host_of(url):
    """The host of a url in lower case; '' without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1),
                              F.lit("")))


def groups_of(root: Element) -> dict[int, int]:
    """Group of each shown element by identity: 0 if names favour its text,
    OUTSIDE if it is outside the main parts of a page that has some, else the
    path of the element whose names speak against it."""
    shown = [e for e in walk(root) if e.state >= 0]
    main = any(e.state == 1 and not e.group for e in shown)
    return {id(e): e.group or (OUTSIDE if main and e.state == 0 else 0) for e in shown}


def text_key(text: str) -> int:
    """Not 0, which stands for no text."""
    return xxhash.xxh3_64_intdigest(text) >> 1 or 1


def features(pages: DataFrame) -> DataFrame:
    """(host, path, content, feature, group, chars): once per page, the look
    of each path (the children of all its elements) and each text in it."""

    def fn(batch, _):
        out = [[], [], [], [], [], []]
        for host, markup in zip(*(batch.column(c).to_pylist() for c in ("host", "html"))):
            root, blocks = parse(markup or "")
            groups = groups_of(root)
            looks: dict[int, list[str]] = {}
            texts = {}
            for e in walk(root):
                if e.state >= 0:
                    group = groups[id(e)]
                    looks.setdefault(e.path, []).append(",".join(c.tag for c in e.children if c.state >= 0))
                    if group == OUTSIDE:
                        looks[OUTSIDE] = [""]
                    for b in e.blocks:
                        texts[e.path, text_key(blocks[b])] = group, len(blocks[b])
            for path, look in looks.items():
                for c, v in zip(out, (host, path, False, xxhash.xxh3_64_intdigest(";".join(look)) >> 1, 0, 0)):
                    c.append(v)
            for (path, t), (group, chars) in texts.items():
                for c, v in zip(out, (host, path, True, t, group, chars)):
                    c.append(v)
        return out

    return arrow_map(pages.select("host", "html"), fn, "host string, path long, content boolean, feature long, "
                     "group long, chars long", slice_rows=512)


def style_tree(pages: DataFrame, least: int = LEAST_PAGES) -> DataFrame:
    """(host, path, text, pages, look, open): for every path that at least
    ``least`` pages of a host share, their number, the importance of its
    presentation, and whether its group is kept against its names (text 0);
    and the number of pages of every text that more than one of them has."""
    counts = stored(features(pages).groupBy("host", "path", "content", "feature", "group", "chars")
                    .agg(F.count("*").cast("double").alias("c")), "features")
    look, size = ~F.col("content"), F.log("pages")
    paths = stored(
        counts.groupBy("host", "path").agg(
            F.sum(F.when(look, F.col("c"))).alias("pages"),
            F.sum(F.when(look, F.col("c") * F.log("c"))).alias("look_logs"))
        .filter(F.col("pages") >= least)
        .select("host", "path", "pages", (1 - F.col("look_logs") / F.col("pages") / size).alias("look")), "paths")
    # Varied characters: each text's, times its importance.
    varied = (counts.filter("content").groupBy("host", "path", "group").agg(
                  F.sum(F.col("c") * F.col("chars")).alias("chars"),
                  F.sum(F.col("c") * F.col("chars") * F.log("c")).alias("logs"))
              .join(paths, ["host", "path"])
              .groupBy("host", "group").agg(F.sum(F.col("chars") - F.col("logs") / size).alias("varied")))
    opened = (varied.groupBy("host").agg(
                  F.coalesce(F.sum(F.when(F.col("group") == 0, F.col("varied"))), F.lit(0.0)).alias("favoured"),
                  F.max(F.when(F.col("group") != 0, F.struct("varied", "group"))).alias("most"))
              .filter(F.col("most.varied") >= OVERRULE * F.col("favoured")).filter("most.varied > 0")
              .select("host", F.col("most.group").alias("path"), F.lit(True).alias("open")))
    texts = (counts.filter("content").groupBy("host", "path", F.col("feature").alias("text"))
             .agg(F.sum("c").alias("pages")).filter("pages > 1"))
    return (paths.join(opened, ["host", "path"], "left")
            .select("host", "path", F.lit(0).cast("long").alias("text"), "pages", "look",
                    F.coalesce("open", F.lit(False)).alias("open"))
            .unionByName(texts.select("host", "path", "text", "pages", F.lit(None).cast("double").alias("look"),
                                      F.lit(False).alias("open"))))


#: (path, text) -> (pages, look, open), with text 0 for the path itself.
Tree = dict[tuple[int, int], tuple[float, float | None, bool]]


def importance(path: int, text: str, tree: Tree) -> float:
    """Of a text: 1 if it is on one page of its path, 0 if on all of them."""
    node = tree.get((path, 0))
    same = tree.get((path, text_key(text))) if node else None
    return 1 - min(1.0, math.log(same[0]) / math.log(node[0])) if same else 1.0


def weigh(e: Element, tree: Tree, texts: dict[int, float], out: dict[int, float]) -> float:
    """Composite importance of e's branch from that of its texts (by block);
    fills ``out`` by identity.  Paths that few pages share count as important."""
    order = [x for x in walk(e) if x.state >= 0]
    for x in reversed(order):
        node = tree.get((x.path, 0))
        parts = [out[id(c)] for c in x.children if c.state >= 0]
        if x.blocks:
            parts.append(sum(texts[b] for b in x.blocks) / len(x.blocks))
        n = len(parts)
        mean = sum(parts) / n if n else 0.0
        out[id(x)] = mean if n < 2 else (1 - DECAY ** n) * max(node[1] if node else 1.0, mean) + DECAY ** n * mean
    return out[id(e)]


def main_text(markup: str | None, tree: Tree) -> str:
    """The blocks that names favour or the tree opens, without low texts and
    branches, joined by spaces.  A branch with most of the page's varied text
    is not low, however many others it has.  Where all of a page repeats, as
    on copies of one page, nothing tells menus from text, and names decide alone."""
    root, blocks = parse(markup or "")
    groups = groups_of(root)
    order = [e for e in walk(root) if e.state >= 0]
    opened = {p for p in {0, *groups.values()} if not p or tree.get((p, 0), (0, 0, False))[2]}
    texts = {b: importance(e.path, blocks[b], tree) for e in order for b in e.blocks}
    kept = {b for e in order if groups[id(e)] in opened for b in e.blocks}
    varied = {id(e): sum(texts[b] * len(blocks[b]) for b in e.blocks if b in kept) for e in order}
    for e in reversed(order):
        if e is not root:
            p = e.parent
            while p.inline:
                p = p.parent
            varied[id(p)] += varied[id(e)]
    if varied[id(root)] < VARIED * sum(len(blocks[b]) for b in kept):
        return " ".join(blocks[b] for b in sorted(kept))
    imp: dict[int, float] = {}
    weigh(root, tree, texts, imp)
    keep: list[int] = []
    todo = [root]
    while todo:
        e = todo.pop()
        keep += [b for b in e.blocks if b in kept and texts[b] >= LOW]
        todo += [c for c in e.children if c.state >= 0 and not (
            imp[id(c)] < LOW and (c.path, 0) in tree and 2 * varied[id(c)] < varied[id(root)])]
    return " ".join(blocks[b] for b in sorted(keep))


def heads(pages: DataFrame) -> bytes:
    """What pages are packed with: markup that others may repeat.  It only
    makes the packed pages smaller; any bytes, or none, give the same pages."""
    found = pages.select(F.substring("html", 1, HEAD_CHARS).alias("h")).filter("h <> ''").limit(HEADS).collect()
    return "".join(r["h"] for r in found).encode()


def _dictionary(known: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(known) >= 8 else None


def packed(pages: DataFrame, known: bytes) -> DataFrame:
    """pages with the html (null: empty) as a zstd frame, for a smaller
    shuffle: page_id, url, key, page."""

    def start():
        d = _dictionary(known)
        if d is not None:
            d.precompute_compress(level=PACK_LEVEL)
        return zstandard.ZstdCompressor(level=PACK_LEVEL, dict_data=d)

    def fn(batch, z):
        return [batch.column("page_id"), batch.column("url"), batch.column("key"),
                [z.compress(h or b"") for h in batch.column("html").cast(pa.binary()).to_pylist()]]

    return arrow_map(pages.select("page_id", "url", "key", "html"), fn, "page_id long, url string, key long, page binary",
                     slice_rows=512, start=start)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of pages.

    Null and empty html have an empty text; a null or odd url belongs to the
    host ''.  Repeated rows get equal texts; extra columns are ignored.
    White space is what Unicode counts as such, so no-break spaces too."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html",
                       host_of(F.col("url")).alias("host"))
    # A node of the tree has one number, so that pages ask for theirs by it.
    node = F.xxhash64("host", "path", "text").alias("node")
    tree = stored(style_tree(src).select(node, "path", "text", "pages", "look", "open"), "tree")

    def own_paths(batch, _):
        out = [[], [], [], []]
        for host, key, markup in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "html"))):
            root, blocks = parse(markup or "")
            groups = groups_of(root)
            own = {(e.path, t) for e in walk(root) if e.state >= 0
                   for t in (0, *(text_key(blocks[b]) for b in e.blocks))}
            if OUTSIDE in groups.values():
                own.add((OUTSIDE, 0))
            out[0] += [host] * len(own)
            out[1] += [key] * len(own)
            out[2] += [p for p, _ in own]
            out[3] += [t for _, t in own]
        return out

    keyed = src.withColumn("key", F.xxhash64("host", "html"))
    paths = arrow_map(keyed.select("host", "key", "html"), own_paths, "host string, key long, path long, text long",
                      slice_rows=512).select("key", node).distinct()
    found = (paths.join(tree, "node").groupBy("key")
             .agg(F.collect_list(F.struct("path", "text", "pages", "look", "open")).alias("tree")))

    known = heads(src)

    def fn(batch, z):
        texts = [main_text(z.decompress(m).decode(), {(t["path"], t["text"]): (t["pages"], t["look"], t["open"]) for t in ts or ()})
                 for m, ts in zip(batch.column("page").to_pylist(), batch.column("tree").to_pylist())]
        return [batch.column("page_id"), batch.column("url"), texts, [len(t) for t in texts]]

    return arrow_map(packed(keyed, known).join(found, "key", "left").select("page_id", "url", "page", "tree"), fn,
                     "page_id long, url string, text string, n_chars long", slice_rows=512,
                     start=lambda: zstandard.ZstdDecompressor(dict_data=_dictionary(known)))
