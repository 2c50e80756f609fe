"""Main text of web pages by a site style tree.

The element trees of one host's pages are merged: elements with the same path of (tag, class, id) are one node. For each
node the distinct pages that hold it are counted by presentation (the tags of its children) and by content (its text).
With m pages, presentation and content importance are the entropies of these counts to base m, and the node's composite
importance is their mean weighted by 1 - 0.9**l and 0.9**l for l presentations. A branch of importance below `LOW` on
at least `LEAST_PAGES` different pages is template and is removed from each page of the host.

Hosts with few pages show no template, so a node starts with what its names say: navigation, headers and footers of the
page, asides, forms, scripts, styles, and elements whose class or id names adverts, menus, notices, comments and the like
have importance 0; an article or main element has importance 1 together with what stands above it, whatever its names. Where a page has such
an element, only its text is taken. Branches within it are in the tree as others are, but go only if the entropy of their content is
low too. A line within it is template by its own entropy: with k of the m pages that hold its element, its importance is
1 - log k / log m; it goes where that is below `LOW`, on `LEAST_PAGES` pages and half of the m at least. Where nothing would be left of
the element, as on a host of near copies, all of it stays.

Defined results: null and empty html, and pages without text, give an empty text; a page without url is on a host of its
own name, the empty one; rows that repeat a page_id are extracted each; broken markup never fails: an unclosed element ends with the
page, and a tag or script that never ends takes the rest of it; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

LOW, LEAST_PAGES, GAMMA = 0.2, 5, 0.9
#: Removed branches (64-bit hashes) that may be broadcast; beyond it the join is shuffled.
BROADCAST_NODES = 200_000
SALTS = 16
#: Share of the pages with its element that hold a line of an article or main element, if it is template.
LEAST_SHARE = 0.5
#: A node is outside article and main elements, within one, or is one or stands above one.
OUTSIDE, WITHIN, MAIN = 0, 1, 2

RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
PHRASING = INLINE | VOID
CHROME = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "head", "title", "button", "select", "option", "textarea", "dialog", "svg", "canvas", "object", "audio", "video", "menu", "textarea", "noembed", "noframes"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"}
CHROME_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|notices|alert"
    r"|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side|aside|widget|footer|header|masthead|topbar|toolbar|comment|comments|respond|replies|reply|disqus"
    r"|share|sharing|social|related|recommended|recirc|newsletter|subscribe|subscription|signup|login|search|pagination|pager|skip|copyright)(?:$|[-_\s\d])"
)
#: Names within an article or main element mark only where every word of a class or id is one of these or, beside one, of PLAIN_WORDS.
SURE_WORDS = set(
    """ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices
    popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer topbar toolbar comment comments respond
    replies reply disqus share sharing social related recommended recirc newsletter subscribe subscription signup login pagination pager
    copyright""".split()
)
PLAIN_WORDS = set("list box block section area wrapper wrap container item items link links bar button buttons form content inner posts articles stories main left right top bottom slot unit text title the and icons".split())
#: Inline elements go only for names of adverts: a word of a sentence may well be a link to share or to something related.
ADVERT = re.compile(r"(?:^|[-_\s])(?:ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo)(?:$|[-_\s\d])")
LANDMARKS = {"article", "main"}
#: Elements that their names never mark; those that are headings within an article; words that name headings there.
UNNAMED = {"html", "body", "article", "main"}
HEADS = {"h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup"}
HEAD_NAMES = re.compile(r"(?<![^-_\s])(?:header|masthead)(?![^-_\s\d])")
#: Elements that end an open paragraph; others of their kind that end with the next sibling.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TAG = re.compile(r"""/?[a-zA-Z][^\s/>]*+(?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+>""")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|$)""", re.I)
_SPACE = re.compile(r"[\s ]+")


class Node:
    __slots__ = ("tag", "path", "shut", "named", "land", "chrome", "own", "landmark", "parent", "parts", "children")

    def __init__(self, tag: str, path: int, parent: Node | None = None, shut: bool = False, named: str = "", land: bool = False):
        self.tag, self.path, self.parent, self.shut, self.named, self.land = tag, path, parent, shut, named, land
        self.chrome = self.own = self.landmark = False
        self.parts: list[str | Node | None] = []
        self.children: list[Node] = []


def _sure(names: str) -> bool:
    """A class or id of the names marks what holds it, within an article or main element too."""
    for name in names.split():
        words = [w.rstrip("0123456789") for w in re.split(r"[-_]+", name)]
        if any(w in SURE_WORDS for w in words) and all(not w or w in SURE_WORDS or w in PLAIN_WORDS for w in words):
            return True
    return False


def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _node(name: str, attrs: str, parent: Node) -> Node:
    known = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)} if attrs else {}
    names = f"{known.get('class', '')} {known.get('id', '')}".strip().lower()
    shut = parent.shut or name in CHROME or known.get("role", "").lower() in CHROME_ROLES or "hidden" in known
    land = name in LANDMARKS or known.get("role", "").lower() == "main"
    node = Node(name, _hash(parent.path, name, names), parent, shut, names if names and CHROME_NAMES.search(names) else "", land)
    parent.parts.append(node)
    parent.children.append(node)
    return node


def _mark(root: Node) -> None:
    """Sets chrome, own (is an article or main element) and landmark (is within one or is one) of each node.

    Names mark nothing that stands above an article or main element, and within one neither its headings nor what holds
    the page's first h1. Articles within an article, as of comments, and articles with a name of their own don't count there, unless the
    page would be left without any.
    """
    order = list(_walk(root))
    lands = [n for n in order if n.land and not n.shut]
    nested = set()
    for n in order:
        if n.parent.tag == "article" or id(n.parent) in nested:
            nested.add(id(n))
    sure = [n for n in lands if n.tag != "article" or not (n.named or id(n) in nested)]
    holds = set()
    for n in sure or lands:
        while n is not None and id(n) not in holds:
            holds.add(id(n))
            n = n.parent
    title = next((n for n in order if n.tag == "h1"), root)
    titled = set()
    while title.parent is not None:
        title = title.parent
        titled.add(id(title))
    for node in order:
        up = node.parent
        chrome = node.shut or up.chrome
        if not chrome and not up.landmark:
            # the head of an article is its title; the page's own header isn't
            chrome = (node.tag == "header" or bool(node.named)) and node.tag not in UNNAMED and id(node) not in holds
        elif not chrome and node.named and node.tag not in UNNAMED and node.tag not in HEADS:
            chrome = id(node) not in holds and id(node) not in titled and _sure(HEAD_NAMES.sub(" ", node.named))
        node.chrome = chrome
        node.own = node.land and not chrome
        node.landmark = node.own or up.landmark


def parse(text: str) -> Node:
    """The element tree, in one pass; parts of a node: texts, block elements, and None for a line break."""
    root = Node("", 0)
    stack = [root]
    at, end = 0, len(text)
    # an open inline advert: its name, and how many elements of that name are open in it; it ends with the block at the latest
    advert, open_ = "", 0
    while at < end:
        lt = text.find("<", at)
        if lt < 0:
            lt = end
        if lt > at and not advert:
            stack[-1].parts.append(entities.unescape(text[at:lt]))
        if lt == end:
            break
        after = text[lt + 1 : lt + 2]
        if text.startswith("<!--", lt):
            close = text.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if after in ("!", "?"):
            close = text.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        if not (after.isascii() and after.isalpha()) and not (after == "/" and text[lt + 2 : lt + 3].isalpha()):
            if not advert:
                stack[-1].parts.append("<")
            at = lt + 1
            continue
        m = _TAG.match(text, lt + 1)
        if not m:
            break
        at = m.end()
        named = _NAME.match(m[0])
        name = named[1].lower()
        if advert and name in PHRASING:
            open_ += (name == advert) * (-1 if m[0][0] == "/" else 1)
            advert = advert if open_ else ""
            continue
        advert = ""
        if m[0][0] == "/":
            if name in INLINE or name in VOID:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    del stack[i:]
                    break
            else:
                stack[-1].parts.append(None)
            continue
        if name in INLINE and name not in RAW:
            attrs = m[0][named.end() : -1]
            if attrs and name not in VOID and ADVERT.search(" ".join((x[2] or x[3] or x[4] or "") for x in _ATTR.finditer(attrs)).lower()):
                advert, open_ = name, 1
            continue
        if name in VOID:
            stack[-1].parts.append(" " if name == "br" else None)
            continue
        if name in SIBLINGS:
            if stack[-1].tag in SIBLINGS[name] or (stack[-1].tag == "p" and len(stack) > 2 and stack[-2].tag in SIBLINGS[name]):
                while stack[-1].tag == "p" or stack[-1].tag in SIBLINGS[name]:
                    stack.pop()
        elif stack[-1].tag == "p":
            stack.pop()
        node = _node(name, m[0][named.end() : -1], stack[-1])
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(text, at)
            at = close.end() if close else end
        elif not m[0].endswith("/>") or name not in ("svg", "path"):
            stack.append(node)
    _mark(root)
    return root


def _walk(root: Node) -> Iterator[Node]:
    todo = list(reversed(root.children))
    while todo:
        node = todo.pop()
        yield node
        todo.extend(reversed(node.children))


def _lines(root: Node, removed: frozenset[int] | set[int] = frozenset()) -> list[tuple[Node, str]]:
    """Elements and texts of the blocks, in page order, that no removed branch holds."""
    only = any(n.landmark for n in _walk(root))
    found, held = [], []

    def flush() -> None:
        if held:
            line = _SPACE.sub(" ", "".join(held)).strip()
            held.clear()
            if line and not (removed and node.landmark and _hash(node.path, line) in removed):
                found.append((node, line))

    # iterative, as broken pages nest deeply
    todo: list[tuple[Node, int]] = [(root, 0)]
    while todo:
        node, i = todo.pop()
        if i == len(node.parts):
            flush()
            continue
        todo.append((node, i + 1))
        part = node.parts[i]
        if part is None:
            flush()
        elif isinstance(part, str):
            if node.landmark or not only:
                held.append(part)
        else:
            flush()
            if not part.chrome and part.path not in removed:
                todo.append((part, 0))
    return found


def blocks(root: Node, removed: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """Texts of the blocks, in page order, that are no template; all of them, where an article or main element would be left empty."""
    found = _lines(root, removed)
    if not found and removed and any(n.landmark for n in _walk(root)):
        found = _lines(root)
    return [line for _, line in found]


def _nodes(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            rows = []
            for host, html in zip(batch.column(0).slice(i, 64).to_pylist(), batch.column(1).slice(i, 64).to_pylist(), strict=True):
                digest = _hash(html or "")
                root = parse(html or "")
                # children come after their parents in the walk, so that from its end texts and landmarks add up; chrome is never taken
                order = [n for n in _walk(root) if not n.chrome]
                text_of: dict[int, int] = {}
                main_of: set[int] = set()
                for node in reversed(order):
                    text_of[id(node)] = _hash(*(p if isinstance(p, str) else text_of.get(id(p), 0) for p in node.parts if p is not None))
                    if node.own or any(id(c) in main_of for c in node.children):
                        main_of.add(id(node))
                alike: dict[int, list[Node]] = {}
                for node in order:
                    alike.setdefault(node.path, []).append(node)
                for path, same in alike.items():
                    place = MAIN if any(id(n) in main_of for n in same) else WITHIN if same[0].landmark else OUTSIDE
                    # elements of one path are one node: all their texts count
                    content = text_of[id(same[0])] if len(same) == 1 else _hash(*(text_of[id(n)] for n in same))
                    rows.append((host, path, digest, _hash(*(c.tag for c in same[0].children)), content, place))
                rows.extend((host, path, digest, None, line, WITHIN) for path, line in {(n.path, _hash(n.path, x)) for n, x in _lines(root) if n.landmark})
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:5]], pa.array(cols[5], pa.int32())], names=["host", "path", "page", "style", "content", "place"])


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, style, content, c, place: the pages c that hold a node so; without style, the lines in article or main elements."""
    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    nodes = rows.mapInArrow(_nodes, "host string, path long, page long, style long, content long, place int")
    # copies of a page count once
    once = nodes.groupBy("host", "path", "style", "content", "page").agg(F.max("place").alias("place"))
    return materialise(once.groupBy("host", "path", "style", "content").agg(F.count("*").alias("c"), F.max("place").alias("place")), "style-tree")


def importance(tree: DataFrame) -> DataFrame:
    """host, path, pages, place, hc (entropy of its content), importance for every node of the sites' style trees."""
    held = tree.where("style is not null")

    def entropy(by: str) -> DataFrame:
        c = held.groupBy("host", "path", by).agg(F.sum("c").alias("c"), F.max("place").alias("place"))
        return c.groupBy("host", "path").agg(F.sum("c").alias("pages"), F.sum(F.col("c") * F.log("c")).alias("s"), F.count("*").alias("kinds"), F.max("place").alias("place")).select(
            "host", "path", "pages", "place", "kinds", F.when(F.col("pages") > 1, (F.log("pages") - F.col("s") / F.col("pages")) / F.log("pages")).otherwise(1.0).alias("h")
        )

    both = entropy("style").alias("p").join(entropy("content").select("host", "path", F.col("h").alias("hc")), ["host", "path"])
    weight = F.pow(F.lit(GAMMA), F.col("kinds"))
    return both.select("host", "path", "pages", "place", "hc", ((1 - weight) * F.col("h") + weight * F.col("hc")).alias("importance"))


def template(tree: DataFrame, low: float, least_pages: int) -> DataFrame:
    """host, path of the branches, and hashes of the lines in article or main elements, that are template."""
    nodes = importance(tree)
    enough = F.col("pages") >= least_pages
    branches = nodes.where((F.col("importance") < low) & enough & ((F.col("place") == OUTSIDE) | ((F.col("place") == WITHIN) & (F.col("hc") < low)))).select("host", "path")
    often = tree.where(F.col("style").isNull() & (F.col("c") >= least_pages)).select("host", "path", "content", "c")
    lines = often.join(nodes.select("host", "path", "pages"), ["host", "path"])
    # the entropy of a line over the pages that hold its element
    lines = lines.where((1 - F.log("c") / F.log("pages") < low) & (F.col("c") >= LEAST_SHARE * F.col("pages"))).select("host", F.col("content").alias("path"))
    return branches.unionByName(lines)


def _extractor(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            text = ["\n".join(blocks(parse(h or ""), set(r or ()))) for h, r in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, low: float = LOW, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    gone = template(style_tree(pages), low, least_pages)
    gone = materialise(gone.groupBy("host").agg(F.collect_list("path").alias("removed")), "style-removed")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    size = gone.agg(F.sum(F.size("removed")).alias("n")).first()["n"] or 0
    if size <= BROADCAST_NODES:
        rows = rows.join(F.broadcast(gone), "host", "left")
    else:
        salted = gone.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "_salt"], "left")
    return rows.select("page_id", "url", "html", "removed").mapInArrow(_extractor, "page_id long, url string, text string, n_chars long")


def op6_site_style_tree(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
