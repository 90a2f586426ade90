"""Main text of web pages by composite text density.

Every DOM node gets the characters per tag of its text, adjusted by its links against those of the
whole body; the node with the largest sum of its children's densities is the heart of the page.
The smallest density on its path to the body is the threshold: along that path, neighbours that are
at least as dense belong to the text as well. Article and main elements widen that choice: a heart inside
one takes the outermost such element whole, with all others on the page that reach the threshold; a heart
that holds some gives those of them, and of the elements with several blocks beside them, that reach it
(the densest marked one if none does). Beside the articles of a main element, what is mostly links is left out.
What can't be text of an article by its element, role or class (menus, page headers, footers, sidebars,
notices, adverts, controls of forms, reader comments) is taken out beforehand; names that also wrap whole pages
(WRAPPERS, and forms) only count where most of the text stands outside of them.

Defined results: null and empty pages give an empty text. Pages of any length are read in one pass. Unclosed and stray tags are repaired as
browsers do for paragraphs, list items, table parts and options; a page cut off anywhere ends all that is open. Repeated rows
are extracted one by one. Blocks keep page order; white space inside a block becomes one blank.
An empty table gives an empty table. Results replace columns of the same names; others are carried through.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm.common import table, trimmed

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z|(?=<))", re.DOTALL)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What an open element is closed by, and where looking for it ends.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = frozenset("ul ol dl table select article section div main body html td th".split())
NOT_TEXT = frozenset("script style noscript template head title textarea iframe object embed svg canvas audio video map nav aside footer form button select option input label dialog menu menuitem xmp noembed noframes datalist".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
NOT_NAMES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification newsletter "
    "subscribe subscription signup popup modal overlay nav navbar navigation menu submenu breadcrumb breadcrumbs footer sidebar sidebars widget widgets related recommended "
    "recommendations share sharing social comment comments commentlist disqus reply replies respond discussion pagination pager toolbar login search skip".split()
)
#: Of these, names that themes and page builders also give to what holds the whole page, and the elements.
WRAPPERS = frozenset("widget widgets share sharing social related recommended promo promotion modal overlay popup search login subscribe subscription signup banner notice skip toolbar sidebar sidebars".split())
WRAPPING = frozenset(("form", "dialog", "aside"))
#: A wrapper is opened if what stands outside of everything taken out is less than this part of its own text, and less than half of that is links.
OUTSIDE = 0.2
MARKED = frozenset(("article", "main"))
HEADERS = frozenset("header masthead topbar".split())
NEGATED = re.compile(r"\b(?:no|without|has|with)[-_]\w+")
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    __slots__ = ("tag", "children", "drop", "wraps", "parent", "c", "t", "lc", "lt", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, wraps: bool = False) -> None:
        self.tag, self.parent, self.drop, self.wraps = tag, parent, drop, wraps
        self.children: list[Node | str] = []


def drops(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is taken out, and whether it may be a wrapper of the page all the same."""
    if tag in WRAPPING:
        return True, True
    if tag in NOT_TEXT or (tag == "header" and not in_article):
        return True, False
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, False
    wraps = False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            return True, False
        if name == "role" and value.lower() in NOT_ROLES:
            return True, False
        if name in ("class", "id"):
            names = {p.lower() for p in PARTS.findall(NEGATED.sub(" ", value))}
            if names & (NOT_NAMES - WRAPPERS) or (names & HEADERS and not in_article):
                return True, False
            wraps |= bool(names & WRAPPERS)
    return wraps, wraps


def parse(page: str) -> Node:
    """The tree of a page; texts are strings among the children."""
    root = node = Node("html", None)
    articles = at = 0
    while at < len(page):
        m = TAG.search(page, at)
        if not m:
            break
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            up = node
            while up is not None and up.tag != tag:
                up = None if tag not in BLOCKS and up.tag in SCOPE else up.parent
            if up is None or up is root:
                continue
            while node is not up:
                articles -= node.tag in ("article", "main")
                node = node.parent
            articles -= node.tag in ("article", "main")
            node = node.parent
            continue
        if tag == "html":
            continue
        ends = CLOSED_BY.get(tag, ())
        if tag in BLOCKS and not ends:
            ends = ("p",)
        up = node
        while ends and up is not root and up.tag not in ends:
            up = root if up.tag in SCOPE or (up.tag in BLOCKS and ends == ("p",)) else up.parent
        if ends and up is not root:
            node = up.parent
        new = Node(tag, node, *drops(tag, m[3], articles > 0))
        node.children.append(new)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS and tag not in RAW and tag != "a":
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]|\Z", re.IGNORECASE).search(page, at)
            at = page.find(">", end.start()) + 1 if end.group() else len(page)
            at = at or len(page)
            continue
        node = new
        articles += tag in ("article", "main")
    if at < len(page):
        node.children.append(page[at:])
    return root


def measure(root: Node) -> list[Node]:
    """Counts characters, tags and those in links below every node; gives the nodes, children first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.children if isinstance(x, Node) and not x.drop]
    order.reverse()
    for node in order:
        node.c = node.t = node.lc = node.lt = 0
        for x in node.children:
            if isinstance(x, str):
                node.c += len("".join(x.split()))
            elif not x.drop:
                node.c, node.t, node.lc, node.lt = node.c + x.c, node.t + x.t + 1, node.lc + x.lc, node.lt + x.lt
        if node.tag == "a":
            node.lc, node.lt = node.c, node.t + 1
    return order


def open_wrappers(root: Node) -> None:
    """Takes wrappers back that hold nearly all of the page's text, the largest first, and those within them likewise."""
    outside, stack, wrappers = 0, [(root, 0, False)], []
    while stack:
        node, at, link = stack.pop()  # at: the wrapper around it, counted from 1
        for x in node.children:
            if isinstance(x, str):
                n = len("".join(x.split()))
                if not at:
                    outside += n
                else:
                    wrappers[at - 1][0] += n
                    wrappers[at - 1][1] += n * link
            elif not x.drop or x.wraps:
                if x.drop and not at:
                    wrappers.append([0, 0, x])
                stack.append((x, at or (len(wrappers) if x.drop else 0), link or x.tag == "a"))
    for n, links, x in sorted(wrappers, key=lambda w: -w[0]):
        if outside < OUTSIDE * n and 2 * links <= n:
            x.drop, outside = False, outside + n
            open_wrappers(x)


def texts_in(node: Node) -> list[Node]:
    return [x for x in node.children if isinstance(x, Node) and not x.drop and x.c]


def parts_of(top: Node) -> list[Node]:
    """The outermost marked elements below top and, beside them, what holds several blocks of text; in page order."""
    holders, stack = set(), [top]
    while stack:
        n = stack.pop()
        if n.tag in MARKED:
            while n is not None and id(n) not in holders:
                holders.add(id(n))
                n = n.parent
        else:
            stack += texts_in(n)
    out, stack = [], [top]
    while stack:
        n = stack.pop()
        if n.tag in MARKED or (n is not top and id(n) not in holders):
            if n.tag in MARKED or sum(x.tag in BLOCKS for x in texts_in(n)) > 1:
                out.append(n)
        else:
            stack += reversed(texts_in(n))
    return out


def leave_links(top: Node) -> None:
    """Takes out what is mostly links beside the marked elements within top."""
    holders, stack = set(), list(texts_in(top))
    while stack:
        n = stack.pop()
        if n.tag in MARKED:
            while n is not None and id(n) not in holders:
                holders.add(id(n))
                n = n.parent
        else:
            stack += texts_in(n)
    stack = [top] if holders else []
    while stack:
        for x in texts_in(stack.pop()):
            if x.tag not in MARKED and id(x) in holders:
                stack.append(x)
            elif x.tag not in MARKED:
                x.drop = 2 * x.lc > x.c


def main_nodes(root: Node) -> list[Node]:
    """The subtrees whose text is the page's, in page order."""
    open_wrappers(root)
    order = measure(root)
    body = next((n for n in order if n.tag == "body"), root)
    ratio = body.lc / body.c if body.c else 0.0
    for n in order:
        if not n.c:
            n.density = 0.0
            continue
        tags, links = max(n.t, 1), max(n.lt, 1)
        base = math.log(n.c / max(n.c - n.lc, 1) * n.lc + ratio * n.c + math.e)
        n.density = n.c / tags * math.log(math.e * max(n.c / max(n.lc, 1) * tags / links, 1.0)) / math.log(base + math.e - 1)
    best = None
    for n in order:
        n.sum = sum(x.density for x in texts_in(n)) or n.density
        if n.c and (best is None or n.sum >= best.sum):
            best = n
    if best is None:
        return []
    top = node = best
    while node is not None:
        if node.tag in MARKED:
            top = node
        node = node.parent
    threshold, node = top.density, top
    while node is not None and node.tag != "html":
        threshold = min(threshold, node.density)
        node = node.parent
    # a marked heart brings all that are marked like it; a heart that holds marked elements is made of them and of what is built like them
    parts = parts_of(root if top.tag in MARKED else top)
    marked = [n for n in parts if n.tag in MARKED]
    for n in marked:
        leave_links(n)
    if marked:
        own = marked if top.tag in MARKED else parts
        return [n for n in own if n is top or n.density >= threshold] or [max(marked, key=lambda n: n.sum)]
    keep, node = {id(top)}, top
    while node.parent is not None and node.tag != "body":
        keep |= {id(x) for x in node.parent.children if isinstance(x, Node) and x is not node and not x.drop and x.c and x.density >= threshold}
        node = node.parent
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if id(n) in keep:
            out.append(n)
        else:
            stack += [x for x in reversed(n.children) if isinstance(x, Node) and not x.drop]
    return out


def blocks_of(node: Node) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def close() -> None:
        if text := " ".join(html.unescape("".join(line)).split()):
            out.append(text)
        line.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            line.append(x)
        elif x.drop:
            if x.tag in BLOCKS:
                close()
        elif x.tag == "br":
            line.append(" ")
        elif x.tag in BLOCKS:
            close()
            stack.append(None)
            stack += reversed(x.children)
        else:
            stack += reversed(x.children)
    close()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(b for n in main_nodes(parse(page)) for b in blocks_of(n)) if page else ""


def extract(df: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all of df if not given), text and n_chars."""
    named = [c for c in (df.columns if keep is None else keep) if c not in ("text", "n_chars")]
    df = df.select(*named, F.col(html_col).alias("__html"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name != "__html") + "text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(page) for page in part.column("__html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in named), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*named, "text", "n_chars"])

    return df.mapInArrow(trimmed(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
