"""Main text of web pages by consensus host paths.

Each page's containers are scored: what text they hold outside links and marked-up extras. The best one's path of
generalised tags and classes (digits as #) is the page's vote; Spark sums the votes per host, and the path with the
most votes wins. Pages are then read again with their host's path; a page without it keeps its own best container.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import map_batches, save

_OPEN = re.compile(r"<(?:(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)|(?P<other>!--|!\[CDATA\[|[!?]))")
_TAG_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_DIGITS = re.compile(r"\d+")
_NAME_PARTS = re.compile(r"[^a-z]+")
_SPECIAL_ENDS = {"!--": "-->", "![CDATA[": "]]>"}

# Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
# An opening tag ends an open element of these names, up to the nearest of the last.
_ENDS = {
    "p": ({"p"}, {"li", "td", "th", "blockquote", "body", "article", "section", "main", "div", "button"}),
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_PARAGRAPH_ENDERS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)

# Elements that matter to where an open paragraph, item or cell ends.
_LIMITING = frozenset().union(*(ended | limits for ended, limits in _ENDS.values()))

# What is no article, whatever host it is on: elements, roles, and words of class names and ids.
_DROPPED = frozenset("head nav footer aside script style noscript template svg math canvas button select datalist textarea label legend iframe object audio video dialog menu title".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
_COMMENT_WORDS = frozenset("comment comments disqus respond reply replies discussion".split())
_DROPPED_WORDS = _COMMENT_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent gdpr notice notices alert"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside widget widgets footer masthead topbar toolbar"
    " share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay".split()
)
# A name that begins so tells what a page has or lacks; it doesn't name the element.
_MODIFIERS = frozenset("has with without no not non is hide show js layout".split())
_UNMARKED = frozenset("html body main article".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_CONTAINERS = frozenset("body main article section div td".split())

# How sure it is that a marked element is an extra. A mark below CERTAIN is lifted from an element that turns out to hold
# the page's article; a mark's number is the share of the page's text from which on it does.
CERTAIN, BY_NAME, BY_COMMENT_PART, BY_PART = 2.0, 1.0, 0.9, 0.5
#: An element with the page's first h1 needs this share at most.
WITH_HEADING = 0.25


class Node(NamedTuple):
    tag: str
    #: Number of its path among the page's paths.
    path: int
    parent: int
    #: Itself or the nearest element around it that is not inline.
    outer: int
    #: In an element that is surely an extra: its text is not read.
    dropped: bool
    #: How surely the element itself is an extra; 0 for none.
    mark: float
    #: Number of the path of the container whose <header> this is in; -1 for none.
    header: int


class Block(NamedTuple):
    text: str
    node: int
    linked: int


class Page(NamedTuple):
    """Elements in page order, and the tree of their generalised container paths (number: parent and name)."""
    nodes: list[Node]
    parents: list[int]
    names: list[str]


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2].strip("\"'")) if m[2] else "" for m in _ATTRIBUTE.finditer(rest)}


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the tag that is open at ``at`` has its >, outside quotes; a quote that is never closed is a plain character."""
    while found := _TAG_STOP.search(page, at):
        mark, place = found[0], found.start()
        if mark == ">":
            return place
        at = page.index(mark, place + 1) + 1 if place < last[mark] else place + 1
    return -1


def parse(page: str) -> tuple[Page, list[Block]]:
    """A page's elements and its text blocks in page order; each block with its innermost element.

    One pass, every character read a bounded number of times. A tag that never ends is text, as all that follows.
    """
    made = Page([Node("", 0, -1, 0, False, 0, -1)], [-1], [""])
    nodes, known = made.nodes, {}
    blocks: list[Block] = []
    stack, limiting = [0], []
    open_tags: Counter[str] = Counter()
    text: list[str] = []
    linked = owner = 0
    last = {quote: page.rfind(quote) for quote in "\"'"}

    def flush() -> None:
        nonlocal linked
        words = " ".join("".join(text).split())
        if words:
            blocks.append(Block(words, owner, linked))
        text.clear()
        linked = 0

    def said(raw: str) -> None:
        nonlocal linked, owner
        if not raw or nodes[stack[-1]].dropped:
            return
        if not text:
            owner = nodes[stack[-1]].outer
        plain = html.unescape(raw)
        text.append(plain)
        if open_tags["a"]:
            linked += len(plain.strip())

    def pop_to(depth: int) -> None:
        open_tags.subtract(nodes[n].tag for n in stack[depth:])
        del stack[depth:]
        while limiting and limiting[-1] >= depth:
            limiting.pop()

    def path_of(tag: str, parent: int, named: str) -> int:
        name = f"{tag}{''.join('.' + _DIGITS.sub('#', c) for c in sorted(named.replace('>', ' ').split()))}"
        if (parent, name) not in known:
            known[parent, name] = len(made.names)
            made.parents.append(parent)
            made.names.append(name)
        return known[parent, name]

    at = 0
    while found := _OPEN.search(page, at):
        said(page[at:found.start()])
        if found["other"]:
            close = _SPECIAL_ENDS.get(found["other"], ">")
            end = page.find(close, found.end())
            at = len(page) if end < 0 else end + len(close)
            continue
        end = _tag_end(page, found.end(), last)
        if end < 0:
            at = found.start()
            break
        tag, rest, at = found["tag"].lower(), page[found.end():end], end + 1
        if tag not in _INLINE:
            flush()
        if found["close"]:
            if open_tags[tag]:
                pop_to(next(depth for depth in range(len(stack) - 1, 0, -1) if nodes[stack[depth]].tag == tag))
            continue
        if tag == "br":
            said(" ")
            continue
        if tag in _VOID:
            continue
        if tag in _ENDS or tag in _PARAGRAPH_ENDERS:
            ended, limits = _ENDS.get(tag) or _ENDS["p"]
            for depth in reversed(limiting) if any(open_tags[name] for name in ended) else ():
                name = nodes[stack[depth]].tag
                if name in ended:
                    pop_to(depth)
                    break
                if name in limits:
                    break
        up = stack[-1]
        parent = nodes[up]
        values = _attributes(rest) if rest.strip(" /\n\t") else {}
        path = path_of(tag, parent.path, values.get("class", "")) if tag in _CONTAINERS else parent.path
        mark = _mark(tag, values)
        # An inline extra stands inside a block of text, so it is left out at once.
        dropped = parent.dropped or mark == CERTAIN or tag in _INLINE and mark == BY_NAME
        if rest.endswith("/") and tag not in _INLINE | _CONTAINERS | {"p"}:
            continue
        header = parent.path if tag == "header" and parent.header < 0 else parent.header
        nodes.append(Node(tag, path, up, parent.outer if tag in _INLINE else len(nodes), dropped, mark, header))
        if tag in _RAW:
            closing = re.compile(rf"</{re.escape(tag)}\s*+>|\Z", re.I).search(page, at)
            at = closing.end()
            continue
        if tag in _LIMITING:
            limiting.append(len(stack))
        stack.append(len(nodes) - 1)
        open_tags[tag] += 1
    said(page[at:])
    flush()
    return made, _without_extras(nodes, blocks)


def _mark(tag: str, values: dict[str, str]) -> float:
    """How surely an element is an extra, by itself."""
    if tag in _HEADINGS:
        return 0
    if tag in _DROPPED or "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower():
        return CERTAIN
    if set(values.get("role", "").lower().split()) & _DROPPED_ROLES:
        return BY_NAME
    mark = BY_PART if tag == "form" else 0
    for name in f"{values.get('class', '')} {values.get('id', '')}".lower().split():
        parts = [part for part in _NAME_PARTS.split(name) if part]
        if not parts or parts[0] in _MODIFIERS:
            continue
        if _DROPPED_WORDS.issuperset(parts):
            return BY_NAME
        ends = {parts[0], parts[-1]}
        if ends & _DROPPED_WORDS:
            mark = max(mark, BY_COMMENT_PART if ends & _COMMENT_WORDS else BY_PART)
    return mark


def _without_extras(nodes: list[Node], blocks: list[Block]) -> list[Block]:
    """The blocks outside marked elements; those that turn out to hold the page's article lose their mark.

    These are: the elements around the page's main or, without one, its unmarked article with the most text (one that is
    in a marked element only if all are); those with nothing else beside them, or with so much of the page's unlinked text as their mark asks for.
    """
    held = [0] * len(nodes)
    for b in blocks:
        held[b.node] += max(0, len(b.text) - b.linked)
    for i in range(len(nodes) - 1, 0, -1):
        held[nodes[i].parent] += held[i]
    inside = [False]
    for n in nodes[1:]:
        inside.append(inside[n.parent] or n.mark > 0 and n.tag not in _UNMARKED)
    mains = [i for i, n in enumerate(nodes) if n.tag == "main" and held[i]]
    articles = mains[:1] or [i for i, n in enumerate(nodes) if n.tag == "article" and held[i] and not n.mark]
    articles = [i for i in articles if not inside[i]] or articles
    around = _around(nodes, max(articles, key=lambda i: (held[i], -i), default=0))
    titled = _around(nodes, next((i for i, n in enumerate(nodes) if n.tag == "h1" and n.header < 0), 0))
    extra = [False] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        marked = 0 < n.mark < CERTAIN and n.tag not in _UNMARKED and i not in around
        enough = min(n.mark, WITH_HEADING) if i in titled else n.mark
        extra[i] = extra[n.parent] or marked and held[i] < enough * held[0]
    return [b for b in blocks if not extra[b.node]]


def _around(nodes: list[Node], at: int) -> set[int]:
    found = set()
    while at > 0:
        found.add(at)
        at = nodes[at].parent
    return found


def _below(page: Page, top: int) -> list[bool]:
    """Per path: whether it is ``top`` or goes on from it. A path's number is greater than its parent's."""
    below = [top == 0]
    for path in range(1, len(page.names)):
        below.append(path == top or below[page.parents[path]])
    return below


def _written(page: Page, path: int) -> str:
    names = []
    while path:
        names.append(page.names[path])
        path = page.parents[path]
    return "".join(f">{name}" for name in reversed(names))


def best_path(page: Page, blocks: list[Block], part: float = 0.6) -> tuple[str, int]:
    """The page's vote: the container of its text, and its score.

    An article or main that holds ``part`` of the text is it, whole. Other containers are entered if nothing but
    extras is left outside; from the body, if a tenth of its text at most is.
    """
    nodes = page.nodes
    score = [0] * len(nodes)
    for b in blocks:
        if nodes[b.node].header < 0:
            score[b.node] += max(0, len(b.text) - 2 * b.linked)
    inside = [0] * len(page.names)
    for i in range(len(nodes) - 1, 0, -1):
        score[nodes[i].parent] += score[i]
        if nodes[i].tag in _CONTAINERS:
            inside[nodes[i].path] += score[i]
    depth, under = [0], [[] for _ in page.names]
    for path in range(1, len(page.names)):
        depth.append(depth[page.parents[path]] + 1)
        under[page.parents[path]].append(path)
    articles = {n.path for n in nodes if n.tag in ("article", "main")}

    def first(paths: list[int]) -> int:
        """The outermost; equal depth: more text, then the smaller name."""
        return min(paths, key=lambda p: (depth[p], -inside[p], page.names[p]))

    path, held = 0, score[0]
    while path not in articles:
        least = 0.9 * held if depth[path] < 2 else held
        fit = [p for p in under[path] if inside[p] > 0 and inside[p] >= (part * held if p in articles else least)]
        if not fit:
            below = _below(page, path)
            fit = [p for p in articles if below[p] and inside[p] > 0 and inside[p] >= part * held]
        if not fit:
            break
        path = first(fit)
        held = inside[path]
    return _written(page, path), held


def main_text(page: Page, blocks: list[Block], path: str) -> str:
    """The blocks inside the path's containers, joined by empty lines.

    A page's header goes; the header of the article, or of the chosen container itself, belongs to the text.
    """
    known = {(parent, name): number for number, (parent, name) in enumerate(zip(page.parents, page.names))}
    top = 0
    for name in path.split(">")[1:]:
        top = known.get((top, name), -1)
    below = _below(page, top)
    in_article = [False]
    for parent, name in zip(page.parents[1:], page.names[1:]):
        in_article.append(in_article[parent] or name.startswith("article"))

    def wanted(n: Node) -> bool:
        own = n.header < 0 or in_article[n.header] or n.header == top and not page.names[top].startswith("body")
        return below[n.path] and own

    return "\n\n".join(b.text for b in blocks if wanted(page.nodes[b.node]))


def host(url: str) -> Column:
    """A URL's host in lower case, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", salts: int = 16) -> DataFrame:
    """Per page: its id, url, ``text`` (blocks in page order joined by two \\n) and ``n_chars`` (code points).

    Left out everywhere: menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments of
    readers and of the markup. An element that is one of these only by its class, id or role, or a form, is left out
    unless it holds the page's article. White space inside a block becomes one space. A null or empty page has an empty
    text; a page without a host votes for itself only; repeated rows are rows each and vote each; ties go to more
    text, then to the greater path. An empty table gives an empty one.
    """
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(url_col).alias("host"))

    def vote(batch: pa.RecordBatch) -> dict:
        made = [best_path(*parse(page or "")) for page in batch.column(1).to_pylist()]
        return {"host": batch.column(0), "path": [m[0] for m in made], "held": [m[1] for m in made]}

    votes = map_batches(pages.where("host <> ''").select("host", "html"), vote, "host string, path string, held long").where("held > 0")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("held").alias("held"))
    winners = save(counted.groupBy("host").agg(F.max(F.struct("votes", "held", "path"))["path"].alias("path")), "winners")
    salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = pages.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")

    def read(batch: pa.RecordBatch) -> dict:
        texts = []
        for page, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            parsed, blocks = parse(page or "")
            text = main_text(parsed, blocks, path) if path is not None else ""
            texts.append(text or main_text(parsed, blocks, best_path(parsed, blocks)[0]))
        return {"id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    kind = pages.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return map_batches(met.select("id", "url", "html", "path"), read, schema).withColumnsRenamed({"id": id_col, "url": url_col})
