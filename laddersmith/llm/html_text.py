"""Main text of web pages by composite text density (operator 2).

Every DOM node gets its characters per tag, adjusted for links (Sun, Song and Liao, 2011):
C / T * log_b(C / LC * T / LT) with b = ln(C / (C - LC) * LC + LC_body / C_body * C + e). The node whose children's densities sum
highest is the seed; the least density on its path to the body is the threshold, and the content is, of each node
of the page that reaches the threshold, the subtree with the greatest sum. Where the seed is the body, or one block right under it, all
that the body holds is content but lists of links: what has more link text than other text and is less dense than the body. Elements
that hold no article text by their tag, role or class (menus, adverts, notices, comments and so on) are no part of the tree.
A name that only may mean readers' comments or teasers (reviews, thread, stories) counts where the element is built like them:
two or more records of one kind, or mostly link text.

Defined results: null and empty pages, and pages without text, give an empty string and 0; repeated rows are
treated alike; extra columns are ignored; an empty table gives an empty result. Unclosed and stray tags are
repaired as the tree is built; pages of any length are read whole.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laddersmith.llm.common import read

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW = {"script", "style", "textarea", "title", "xmp", "noframes"}
#: Their end tags; A-Z alone are alike in either case, so that places are those of the page itself.
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)[^>]*(?:>|$)", re.I | re.A) for tag in sorted(_RAW)}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_DROP = set("head script style noscript template nav footer aside form button select option input textarea iframe object embed svg canvas dialog menu audio video map title xmp noframes".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Parts of a class or id name that tell what is no article, and parts that say nothing. A name counts as the former if all its parts are of the two
#: kinds and one is of the first: "site-footer" does, "social-history" doesn't.
_BAD = set("nav navbar navigation menu menubar sidebar footer header masthead breadcrumb breadcrumbs ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay comment comments commentlist respond disqus replies share sharing social related recommended newsletter subscribe signup widget toolbar pagination pager skip disclaimer disclaimers".split())
_PLAIN = set("site page main global top bottom left right side primary secondary bar box list block wrap wrapper container area section inner outer panel slot unit text link links item items post posts article articles form button buttons icon icons content group row col column js id".split())
#: What readers write, whoever is named before it ("reader-comments"); what may be that or an article's own word; teasers, where they are links.
_SAID = set("comment comments commentlist replies disqus".split())
_MAY_BE_SAID = set("review reviews thread threads discussion discussions response responses feedback conversation".split())
_TEASERS = set("stories headlines teaser teasers trending popular news more".split())
#: Blocks that are parts of a text, not containers of one.
_BLOCK = set("p li ul ol blockquote table tbody tr td pre dl".split())
#: Elements of which two or more with one class make up a list of records.
_RECORD = set("li div article section dd blockquote details tr".split())
_PARTS = re.compile(r"[\s_-]+")
_BAD_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert"}
#: Open elements that a start tag closes, and those that it doesn't look beyond.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}
_BLOCK_CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_P_SCOPE = set("button table td th caption object body html article section div main li blockquote dd".split())
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "kids", "parent", "drop", "chars", "tags", "link_chars", "link_tags", "density", "total", "most", "name", "doubt")

    def __init__(self, tag: str, parent: Node | None, drop: bool, name: str = ""):
        self.tag, self.parent, self.drop, self.name, self.doubt = tag, parent, drop, name, ""
        self.kids: list[Node | str] = []


def _dropped(tag: str, attrs: str, parent: Node) -> bool:
    if tag in _DROP:
        return True
    if tag == "header":  # an article's own header holds its title
        up = parent
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        if up is None:
            return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id") and any(_says_no(x) for x in value.lower().split()):
            return True
        if name == "role" and value.lower() in _BAD_ROLE or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def _says_no(name: str) -> bool:
    parts = [x.strip("0123456789") for x in _PARTS.split(name)]
    return any(x in _BAD for x in parts) and all(x in _BAD or x in _PLAIN or not x for x in parts) or _head(parts) in _SAID and len(parts) < 4


def _head(parts: list[str]) -> str:
    """The last part that says something: the head of a compound name."""
    return next((x for x in reversed(parts) if x and x not in _PLAIN), "")


def _doubt(attrs: str) -> tuple[str, str]:
    """The class, and what its name or the id's may mean: "said", "teasers" or nothing."""
    kind, found = "", ""
    for name, a, b, c in _ATTR.findall(attrs):
        if name.lower() in ("class", "id"):
            value = (a or b or c).lower()
            if name.lower() == "class":
                kind = value
            for x in value.split():
                parts = [y.strip("0123456789") for y in _PARTS.split(x)]
                head = _head(parts)
                if head in _MAY_BE_SAID:
                    found = "said"
                elif not found and (head in _TEASERS or not head and parts[-1] in _TEASERS):
                    found = "teasers"
    return kind, found


def _settle(doubtful: list[Node]) -> None:
    """Drop those of the doubtful elements that are built as their names may mean, inner ones first."""
    for x in reversed(doubtful):
        if not x.drop and (x.doubt == "said" and _records(x) or x.doubt == "teasers" and _mostly_links(x)):
            x.drop = True


def _records(x: Node) -> bool:
    """Whether two or more elements of one kind, with one class, make up the element or an only list in it."""
    while True:
        kids = [k for k in x.kids if not isinstance(k, str) and not k.drop]
        seen = Counter((k.tag, k.name) for k in kids if k.tag in _RECORD)
        if seen:
            if seen.most_common(1)[0][1] > 1:
                return True
        lists = [k for k in kids if k.tag in ("ul", "ol", "dl", "table", "tbody", "div", "section")]
        if len(lists) != 1:
            return False
        x = lists[0]


def _mostly_links(x: Node) -> bool:
    text, links, todo = 0, 0, [(x, x.tag == "a")]
    while todo:
        y, in_link = todo.pop()
        for k in y.kids:
            if isinstance(k, str):
                n = len(_SPACE.sub(" ", k).strip())
                text += n
                links += n if in_link else 0
            elif not k.drop:
                todo.append((k, in_link or k.tag == "a"))
    return 2 * links > text


def parse(page: str) -> Node:
    """The tree of a page; dropped elements stay as empty marks between blocks."""
    root = now = Node("html", None, False)
    at, n = 0, len(page)
    doubtful: list[Node] = []
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            _text(now, page[at:])
            break
        if m.start() > at:
            _text(now, page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:  # an end tag closes up to its start, if there is one
            up = now
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                now = up.parent
            elif tag == "p":
                now.kids.append(Node("p", now, False))
            continue
        if tag == "html":
            continue
        if tag in _BLOCK_CLOSES_P:
            up = now
            while up.parent is not None and up.tag != "p" and up.tag not in _P_SCOPE:
                up = up.parent
            if up.tag == "p":
                now = up.parent
        if tag in _CLOSES:
            which, scope = _CLOSES[tag]
            up, last = now, None
            while up.parent is not None and up.tag not in scope:
                if up.tag in which:
                    last = up
                up = up.parent
            if last is not None:
                now = last.parent
        kind, doubt = _doubt(m[3]) if "=" in m[3] else ("", "")
        node = Node(tag, now, now.drop or _dropped(tag, m[3], now), kind)
        now.kids.append(node)
        if doubt and not node.drop and tag in _RECORD | {"ul", "ol", "dl"}:
            node.doubt = doubt
            doubtful.append(node)
        if tag in _VOID or m[3].endswith("/") and tag not in _INLINE and tag not in _BLOCK_CLOSES_P:
            continue
        if tag in _RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        now = node
    _settle(doubtful)
    return root


def _text(node: Node, s: str) -> None:
    if not node.drop:
        node.kids.append(html.unescape(s) if "&" in s else s)


def _measure(root: Node) -> None:
    """Characters, tags, link characters and link tags of every node, without recursion."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [k for k in x.kids if not isinstance(k, str) and not k.drop]
    for x in reversed(order):
        c = t = lc = lt = 0
        for k in x.kids:
            if isinstance(k, str):
                c += len(_SPACE.sub(" ", k).strip())
            elif not k.drop:
                c += k.chars
                t += k.tags + 1
                lc += k.link_chars
                lt += k.link_tags
                if k.tag == "a":
                    lc += k.chars - k.link_chars
                    lt += 1
        x.chars, x.tags, x.link_chars, x.link_tags = c, t, lc, lt
    share = root.link_chars / max(root.chars, 1)
    for x in reversed(order):
        c, t, lc, lt = x.chars, max(x.tags, 1), x.link_chars, x.link_tags
        if c == 0:
            x.density = 0.0
        else:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            x.density = c / t * max(0.0, math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / math.log(base) if base > 1 else 1.0)
        kids = [k for k in x.kids if not isinstance(k, str) and not k.drop]
        x.total = sum(k.density for k in kids) if kids else x.density
        x.most = max(kids, key=lambda k: k.most.total).most if kids else x
        if x.total >= x.most.total:
            x.most = x


def content(root: Node) -> list[Node]:
    """The subtrees with the article, in page order."""
    _measure(root)
    best = root.most
    if best.chars == 0:
        return [root]
    path = list(_up(best))
    threshold = min((x.density for x in path if x.tag != "html"), default=0.0)
    most = [_whole(x.most) for x in _walk(root) if x.chars and x.tag not in _INLINE and x.density >= threshold]
    # a seed that is one block or a part of one grows to the container with its neighbours
    grown = best
    for x in path[1:]:
        if x.tag != "html" and (grown.tag in _INLINE or grown.tag in _BLOCK):
            grown = x
        else:
            break
    if grown.tag in ("body", "html"):
        for k in grown.kids:
            if not isinstance(k, str) and k.tag not in _INLINE and not k.drop and 2 * k.link_chars > k.chars and k.density < grown.density:
                k.drop = True
    return _outer(root, [grown, *most])


def _whole(node: Node) -> Node:
    """A link or another inline part is never content without its block, a block not without the container that it shares with its neighbours, unless that is the body."""
    block = next(y for y in _up(node) if y.tag not in _INLINE)
    box = next(y for y in _up(block) if y.tag not in _INLINE and y.tag not in _BLOCK)
    return block if box.tag in ("body", "html") else box


def _up(node: Node | None):
    while node is not None:
        yield node
        node = node.parent


def _outer(root: Node, nodes: list[Node]) -> list[Node]:
    """Those that lie in no other one, in page order."""
    ids = {id(x) for x in nodes}
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if id(x) in ids:
            out.append(x)
        else:
            todo += [k for k in reversed(x.kids) if not isinstance(k, str) and not k.drop]
    return out


def _walk(node: Node):
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo += [k for k in reversed(x.kids) if not isinstance(k, str) and not k.drop]


def text_of(nodes: list[Node]) -> str:
    """Blocks in page order, joined by one space."""
    blocks: list[str] = []
    line: list[str] = []

    def cut() -> None:
        if line:
            s = _SPACE.sub(" ", "".join(line)).strip()
            if s:
                blocks.append(s)
            line.clear()

    todo: list = [y for x in reversed(nodes) for y in (None, x)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            line.append(x)
        elif x is None:
            cut()
        elif x.drop:
            cut() if x.tag not in _INLINE else None
        elif x.tag in _INLINE:
            todo += reversed(x.kids)
        else:
            cut()
            todo.append(None)
            todo += reversed(x.kids)
    cut()
    return " ".join(blocks)


def extract(page: str | None) -> str:
    if not page:
        return ""
    return text_of(content(parse(page)))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) to (page_id, url, text, n_chars)."""

    def run(batches):
        for b in batches:
            out = [extract(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``."""
    return extract_pages(read(spark, sf_dir, "pages", "page_id", "url", "html"))
