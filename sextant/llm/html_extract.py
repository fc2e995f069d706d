"""Main text of web pages by site style trees.

The pages of one host are merged into a style tree: elements of different
pages with the same chain of styles (tag, classes, id, role) are one style
node.  What its instances say are its content values, how their children are
laid out its presentation values.  A value's entropy over the m pages that
have the node, to the base m, is 1 if all have the value and 0 if one has it;
the node's importance is 1 less the average entropy of its values: 0 where all
pages repeat the same, 1 where all differ (and where too few pages were seen
to tell).  Both are counted for all pages of all hosts by hashed keys, so a host with a third
of the pages is an ordinary group.

Each page composes the importance of its branches bottom-up.  A branch is worth
the greatest importance in it, times a prior by its marks: tags, class words
and roles name what surrounds articles, and what is one.  Block branches worth
less than the threshold's share of the page's most important one are dropped,
so what a site repeats goes without any mark, inside an article as elsewhere,
and what differs from page to page goes if its marks say so.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import map_rows
from .staging import load, stage

# Element names of the HTML standard, by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
NO_TEXT = frozenset("script style textarea title noscript iframe xmp noembed noframes head template svg math canvas object audio video select option datalist button input label".split())
SURROUNDING = frozenset("form fieldset nav menu aside footer dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark meta q rp rt ruby s samp small span strike strong sub sup time tt u var wbr link".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "p": ("article", "aside", "body", "button", "caption", "div", "footer", "header", "main", "nav", "section", "table", "td", "th", "li", "ul", "ol", "blockquote", "form")}
# Class, id and role words that mark what surrounds an article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner banners sponsor sponsored promo promotion promotions promoted "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toolbar topbar tabs "
    "header masthead footer foot bottombar copyright legal colophon sidebar sidebars side rail aside widget widgets complementary contentinfo "
    "notice notices cookie cookies consent gdpr alert alerts warning popup modal overlay paywall subscribe subscription newsletter signup login register "
    "share sharing social related recommended recommendations trending popular "
    "comment comments respond reply replies disqus discussion form search searchbox hidden".split()
)
#: Of these, words that inside an article only make a branch less likely to be noise.
INNER = frozenset("header side legal warning".split())
MAIN = frozenset("article main".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

GAMMA = 0.9
#: Priors of branches by their marks, and the share of a page's text that makes a marked branch a mere wrapper.
PRIOR, INNER_PRIOR, WRAPPER = 0.2, 0.5, 0.8


class Node:
    __slots__ = ("tag", "style", "words", "hidden", "main", "children", "path", "importance", "peak", "mass", "holds")

    def __init__(self, tag: str, attributes: str = ""):
        found = {k.lower(): html.unescape((v or "").strip("\"'")) for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        marks = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()
        self.tag, self.children = tag, []
        self.style = f"{tag}.{marks}" if marks.strip() else tag
        self.words = {w for w in re.split(r"[^a-z]+", marks) if w} if marks.strip() else ()
        self.hidden = "hidden" in found or found.get("aria-hidden") == "true" or bool(HIDDEN.search(found.get("style", "")))
        self.main = tag in MAIN or "articlebody" in found.get("itemprop", "").lower() or found.get("role", "").lower() in MAIN
        self.path, self.importance, self.peak, self.mass, self.holds = b"", 0.0, 0.0, 0.0, False

    def text(self) -> str:
        """What the element itself says, without its child elements."""
        return " ".join(" ".join(c for c in self.children if isinstance(c, str)).split())


def parse(page: str) -> Node:
    """The element tree of a page, however badly its tags are closed."""
    root = Node("#root")
    stack, at, end = [root], 0, len(page)
    open_tags: dict[str, int] = {}
    last = page.rfind(">") + 1  # what follows holds no whole tag

    def cut(depth: int) -> None:
        for node in stack[depth:]:
            open_tags[node.tag] -= 1
        del stack[depth:]

    def close(names: tuple[str, ...], limits: tuple[str, ...]) -> None:
        if not any(map(open_tags.get, names)):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in names:
                cut(depth)
                return
            if stack[depth].tag in limits:
                return

    while at < end:
        m = TOKEN.search(page, at, last)
        if m is None:
            rest = page.find("<!--", at)
            if text := page[at:] if rest < 0 else page[at:rest]:
                stack[-1].children.append(html.unescape(text))
            break
        if m.start() > at:
            stack[-1].children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if page.startswith("<!--", m.start()) and not page.endswith("-->", m.start() + 4, at):
                break  # a comment without an end
            continue
        if m[1] or m[4]:
            if open_tags.get(name):
                cut(next(d for d in range(len(stack) - 1, 0, -1) if stack[d].tag == name))
            continue
        attributes = m[3] or m[6] or ""
        if name in CLOSES_P:
            close(("p",), LIMITS["p"])
        if name in CLOSED_BY:
            close(CLOSED_BY[name], LIMITS[name])
        node = Node(name, attributes)
        stack[-1].children.append(node)
        if name in RAW:
            stop = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(page, at, last)
            at = stop.end() if stop else end
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(node)
            open_tags[name] = open_tags.get(name, 0) + 1
    return root


def walk(root: Node) -> Iterator[Node]:
    """All elements, parents first; gives each its style path."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        for child in node.children:
            if isinstance(child, Node):
                child.path = blake2b(node.path + child.style.encode("utf-8", "replace"), digest_size=8).digest()
                todo.append(child)


def number(data: bytes) -> int:
    return int.from_bytes(data[:8], "big", signed=True)


def digest(text: str) -> int:
    return number(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest())


def style_features(page: str) -> Iterator[tuple[int, str, int, int, int]]:
    """(style path, "says" or "looks", value, times, first) of each style node of a page; ``first``: 1 for one of its values."""
    seen: dict[tuple[bytes, str], dict[str, int]] = {}
    for node in walk(parse(page)):
        if text := node.text():
            values = seen.setdefault((node.path, "says"), {})
            values[text] = values.get(text, 0) + 1
        if styles := [c.style for c in node.children if isinstance(c, Node)]:
            values, look = seen.setdefault((node.path, "looks"), {}), " ".join(dict.fromkeys(styles))
            values[look] = values.get(look, 0) + 1
    for (path, kind), values in seen.items():
        for k, (value, times) in enumerate(values.items()):
            yield number(path), kind, digest(value), times, int(k == 0)


def weigh(root: Node, known: Callable[[int], tuple[float, float]]) -> None:
    """Importance of every element, composed of its children's styles, and what its branch holds; children first."""
    order = list(walk(root))[::-1]
    for node in order:
        says, looks = known(number(node.path)) if node.path else (1.0, 1.0)
        size = len(node.text())
        inner = [c for c in node.children if isinstance(c, Node)]
        styles: dict[str, list[float]] = {}
        for c in inner:
            styles.setdefault(c.style, []).append(c.importance)
        parts = [sum(x) / len(x) for x in styles.values()] + ([says] if size else [])
        if inner:
            own = GAMMA ** len(styles)
            node.importance = (1 - own) * looks + own * sum(parts) / len(parts) if size or any(c.mass for c in inner) else 0.0
        else:
            node.importance = says if size else 0.0
        node.peak = max(says, node.importance) if size else 0.0
        node.mass = size * says + sum(c.mass for c in inner)
        node.holds = node.main or node.tag == "h1" or any(c.holds for c in inner)
    for node in order:
        inner = [c for c in node.children if isinstance(c, Node) and max(prior(c, x, root.mass) for x in (False, True)) > PRIOR]
        node.peak = max([node.peak, *[c.peak for c in inner]])


def surrounding(node: Node, inside: bool) -> bool:
    """Whether tag, class words or state mark a branch as not of the article."""
    if node.hidden or node.tag in NO_TEXT or node.tag in SURROUNDING or (node.tag == "header" and not inside):
        return True
    if node.tag in ("html", "body", "#root"):
        return False
    words = NOISE.intersection(node.words) if node.words else ()
    # A headline may sit in a block named header.
    return bool(words) and bool(not (inside or node.tag in MAIN) or words - INNER)


def prior(node: Node, inside: bool, mass: float) -> float:
    if surrounding(node, inside):
        wrapper = not inside and node.tag not in SURROUNDING and node.holds and node.mass >= WRAPPER * mass
        return 1.0 if wrapper and not (node.hidden or node.tag in NO_TEXT) else PRIOR
    return INNER_PRIOR if inside and node.words and INNER.intersection(node.words) else 1.0


def main_text(page: str, known: Callable[[int], tuple[float, float]], threshold: float) -> str:
    root = parse(page)
    weigh(root, known)

    def kept(node: Node, inside: bool) -> bool:
        if node.hidden or node.tag in NO_TEXT:
            return False
        by_marks = prior(node, inside, root.mass)
        if by_marks == 1 and (node.tag in INLINE or node.tag in ("html", "body", "#root")):
            return True
        return by_marks > PRIOR and node.peak * by_marks >= threshold * root.peak

    def has_main() -> bool:
        todo = [root]
        while todo:
            n = todo.pop()
            if kept(n, False):
                if n.main:
                    return True
                todo += [c for c in n.children if isinstance(c, Node)]
        return False

    marked = has_main()
    blocks: list[str] = []
    line: list[str] = []

    def end_block() -> None:
        if text := " ".join("".join(line).split()):
            blocks.append(text)
        line.clear()

    # An explicit stack: pages may nest thousands of elements.  A pair's second part: inside an article.
    todo: list[tuple[object, bool]] = [(root, False)]
    while todo:
        item, inside = todo.pop()
        if item is None:
            end_block()
        elif isinstance(item, str):
            if inside or not marked:
                line.append(item)
        elif item.tag == "br":
            line.append(" ")
        elif kept(item, inside):
            if item.tag not in INLINE:
                end_block()
                todo.append((None, inside))
            todo += [(c, inside or item.main) for c in reversed(item.children)]
    end_block()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def style_importance(pages: DataFrame, url_col: str, html_col: str, least: int) -> DataFrame:
    """``host, path, says, looks``: importance of each style node that at least ``least`` pages have."""

    def each(host, page):
        for feature in style_features(page or ""):
            yield host, *feature

    seen = map_rows(pages.select(host_of(F.col(url_col)).alias("host"), html_col), each, "host string, path long, kind string, value long, times long, first long")
    counts = seen.groupBy("host", "path", "kind", "value").agg(F.sum("times").alias("n"), F.count("*").alias("on"), F.sum("first").alias("first"))
    pages, total = F.sum("first"), F.sum("n")
    # The entropy of a value over the pages, at its highest 1 (on every page), averaged by occurrences.
    spread = F.sum(F.col("n") * F.log("on")) / (total * F.log(pages))
    importance = F.when(pages > 1, 1 - spread).otherwise(1.0)
    kinds = counts.groupBy("host", "path", "kind").agg(pages.alias("pages"), importance.alias("importance")).where(F.col("pages") >= least)
    pick = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("importance"))), F.lit(1.0)).alias(kind)
    return kinds.groupBy("host", "path").agg(pick("says"), pick("looks"))


def extract_main_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    threshold: float = 0.3,
    least: int = 8,
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """``page_id, url, text`` of every page; blocks in page order, one a line.

    A null or empty page gives an empty text; a null url counts as a host of
    its own name, "".  Repeated rows give repeated results, an empty table an
    empty one; other columns are ignored.  Where a page has an ``article`` or
    ``main`` element that is worth keeping, the text is what is kept in it.
    Style nodes that fewer than ``least`` pages of a host have count as
    important.  Up to ``broadcast_rows`` style nodes are sent to the tasks;
    beyond that each page fetches the nodes of its own paths by a join.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    tree = stage(style_importance(pages, "url", "html", least), "style_tree")
    kinds = dict(pages.dtypes)
    schema = f"page_id {kinds['page_id']}, url string, text string"
    if tree.limit(broadcast_rows + 1).count() <= broadcast_rows:
        nodes = {(r.host, r.path): (r.says, r.looks) for r in tree.collect()}  # bounded by broadcast_rows
        shared = pages.sparkSession.sparkContext.broadcast(nodes)

        def each(page_id, url, page, host):
            known = shared.value
            yield page_id, url, main_text(page or "", lambda path: known.get((host, path), (1.0, 1.0)), threshold)

        return map_rows(pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")), each, schema)

    def paths(key, host, page):
        for path in {number(n.path) for n in walk(parse(page or ""))}:
            yield key, host, path

    def judged(page_id, url, page, found):
        known = {r["path"]: (r["says"], r["looks"]) for r in found or []}
        yield page_id, url, main_text(page or "", lambda path: known.get(path, (1.0, 1.0)), threshold)

    # Rows with the same page share their style nodes, so a page is known by its digest.
    keyed = pages.withColumns({"key": F.sha2(F.concat_ws("\n", host_of(F.col("url")), F.coalesce("html", F.lit(""))), 256), "host": host_of(F.col("url"))})
    wanted = map_rows(keyed.select("key", "host", "html"), paths, "key string, host string, path long").distinct()
    known = wanted.join(tree, ["host", "path"]).groupBy("key").agg(F.collect_list(F.struct("path", "says", "looks")).alias("found"))
    return map_rows(keyed.join(known, "key", "left").select("page_id", "url", "html", "found"), judged, schema)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = extract_main_text(load(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op1_html_extraction": op1_html_extraction}
ORACLE: dict[str, str] = {}
