"""Main text of web pages by tree scoring.

A page is read into a tree, leniently. Blocks of text pass points for their length and
their commas to their ancestors: all to the parent, half to the next, less further up. A
container's points are discounted by its link density; the best one is kept, with those
siblings that score well, and gives the text in page order. Elements that are never
article text (menus, forms, scripts, adverts, comments and the like) are left out first.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPENING = re.compile(r"<!--|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)|<(?:[!?]|/[^a-zA-Z])")
_COMMENT_END = re.compile(r"(?<=--)!?>")
#: What stands in a tag before its >, quoted values whole.
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")

# Element names of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
JUNK = frozenset("nav footer aside form button select option menu dialog svg canvas object audio video map fieldset datalist head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
PARAGRAPH = frozenset("p pre td th li dd dt blockquote h1 h2 h3 h4 h5 h6 figcaption caption summary address".split())
ROOT = frozenset("html body".split())
WHOLE = frozenset("article main".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: An element of these in between, and a new block closes no paragraph.
P_BARRIER = frozenset("td th article section table li".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SENTENCE_ENDS = frozenset(".!?…:\"'”’»)。！？")
#: The part of a block's points that its container, that one's parent, and so on get.
SHARES = (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12)
BARRIER = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
JUNK_ROLES = frozenset("navigation banner complementary contentinfo search menu menubar alert alertdialog dialog toolbar form".split())
JUNK_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent dialog disqus"
    " disclaimer feedback footer footnav gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination"
    " paywall popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe"
    " subscription taboola teaser toolbar topbar widget widgets".split()
)
KEEP_WORDS = frozenset("article body column content entry main page post story text".split())


class _Node:
    __slots__ = ("tag", "parent", "junk", "points", "chars", "linked", "place", "last", "kept")

    def __init__(self, tag, parent, junk, place):
        self.tag, self.parent, self.junk, self.place = tag, parent, junk, place
        self.points, self.chars, self.linked = 0.0, 0, 0
        self.last, self.kept = "", False

    def density(self) -> float:
        return self.linked / self.chars if self.chars else 0.0


def _junk(tag: str, rest: str, in_whole: bool) -> bool:
    if tag in JUNK:
        return True
    if tag == "header" and not in_whole:
        return True
    if not rest or rest.isspace() or tag in ROOT:
        return False
    got = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)}
    if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", ""), re.I):
        return True
    if tag in WHOLE and not {"comment", "comments", "reply"} & set(_WORD.findall(f"{got.get('class', '')} {got.get('id', '')}".lower())):
        return False
    if JUNK_ROLES & set(got.get("role", "").lower().split()):
        return True
    words = set(_WORD.findall(f"{got.get('class', '')} {got.get('id', '')}".lower()))
    return bool(words & JUNK_WORDS) and not (words & KEEP_WORDS and not words & {"comment", "comments"})


class _Page:
    """Blocks (text, node, link characters) and nodes of a page, junk left out.

    Every step takes time by what it reads or closes: the stack is never walked through, as the places
    at which each element name is open in it are kept.
    """

    def __init__(self, page: str):
        self.nodes: list[_Node] = []
        self.blocks: list[tuple[str, _Node, int]] = []
        self.stack: list[_Node] = []
        self.open: dict[str, list[int]] = {}
        self.outer: list[int] = []  # places of elements that aren't inline
        self.parts: list[str] = []
        self.link_parts: list[str] = []
        self._push("html", "")
        self._read(page)
        self._flush()

    def _last(self, tags) -> int:
        """The place in the stack of the nearest open element of tags; -1 if none is."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _push(self, tag: str, rest: str) -> None:
        above = self.stack[-1] if self.stack else None
        junk = (above.junk if above else False) or _junk(tag, rest, self._last(WHOLE) >= 0)
        node = _Node(tag, above, junk, len(self.nodes))
        self.nodes.append(node)
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.outer.append(len(self.stack))
        self.stack.append(node)

    def _pop(self) -> None:
        tag = self.stack.pop().tag
        self.open[tag].pop()
        if tag not in INLINE:
            self.outer.pop()

    def _close(self, tags, barrier: int) -> None:
        """Close the nearest open element of tags, if it stands above the place barrier."""
        at = self._last(tags)
        if at > max(0, barrier):
            while len(self.stack) > at:
                self._pop()

    def _flush(self) -> None:
        """End the block at hand."""
        text = " ".join(html.unescape("".join(self.parts)).split()) if self.parts else ""
        if text:
            linked = len(" ".join(html.unescape("".join(self.link_parts)).split()))
            self.blocks.append((text, self.stack[self.outer[-1]], min(linked, len(text))))
        self.parts, self.link_parts = [], []

    def _text(self, text: str) -> None:
        if text and not self.stack[-1].junk:
            self.parts.append(text)
            if self.open.get("a"):
                self.link_parts.append(text)

    def _read(self, page: str) -> None:
        at = 0
        find_end = _tag_ends(page)
        while (lt := page.find("<", at)) >= 0:
            kind = _OPENING.match(page, lt)
            if kind is None:  # no markup
                self._text(page[at : lt + 1])
                at = lt + 1
                continue
            self._text(page[at:lt])
            name = kind["name"]
            if name is None:
                end = _COMMENT_END.search(page, lt + 4) if kind[0] == "<!--" else None
                close = (end.end() if end else -1) if kind[0] == "<!--" else page.find(">", lt) + 1
                at = close if close > 0 else len(page)
                continue
            end = find_end(kind.end())
            if end < 0:  # the page's end cuts the tag off
                return
            at = end + 1
            self._tag(name.lower(), bool(kind["end"]), page[kind.end() : end])
            if not kind["end"] and name.lower() in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
                end = page.find(">", close.end()) if close else -1
                at = end + 1 if end >= 0 else len(page)
        self._text(page[at:])

    def _tag(self, tag: str, ends: bool, rest: str) -> None:
        if ends:
            if tag in INLINE:
                self._close((tag,), self.outer[-1])
            elif tag not in ROOT:
                self._flush()
                self._close((tag,), -1 if tag in WHOLE or tag in JUNK else self._last(WHOLE - {tag}))
        elif tag in RAW:
            return
        elif tag in VOID:
            if tag == "br":
                self._text(" ")
            elif tag == "hr":
                self._flush()
        elif tag in INLINE:
            self._push(tag, rest)
            if self.stack[-1].junk and rest.endswith("/"):
                self._pop()
        else:
            self._flush()
            if tag in ROOT:
                return
            if tag in CLOSES:
                self._close(CLOSES[tag], self._last(BARRIER[tag]))
            elif self.open.get("p"):
                self._close(("p",), self._last(P_BARRIER))
            self._push(tag, rest)
            if rest.endswith("/"):
                self._pop()


def _tag_ends(page: str):
    """A function that finds the > that ends a tag, outside quotes; -1 if there is none.

    Where quotes are left open to the page's end, that is found once, and they count no more from there on.
    """
    quoted = True

    def find(at: int) -> int:
        nonlocal quoted
        if quoted:
            m = _REST.match(page, at)
            if m.end() < len(page) and page[m.end()] == ">":
                return m.end()
            quoted = False
        return page.find(">", at)

    return find


def main_text(page: str | None) -> str:
    """The page's main text; blocks in page order, joined by one space. Empty if there is none."""
    if not page:
        return ""
    tree = _Page(page)
    if not tree.blocks:
        return ""
    for text, owner, linked in tree.blocks:
        owner.chars += len(text)
        owner.linked += linked
        owner.last = text[-1]
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * min(1.0, len(text) / 25) * (1 - linked / len(text))
        n = owner.parent if owner.tag in PARAGRAPH and owner.parent is not None else owner
        for part in SHARES:
            if n is None:
                break
            n.points += points * part
            n = n.parent
    for n in reversed(tree.nodes):  # children come after their parents
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.linked += n.linked
    worth = lambda n: (n.points + (3 if n.tag in WHOLE and n.points else 0)) * (1 - n.density())
    best = max((n for n in tree.nodes if n.chars), key=lambda n: (worth(n), -n.place))
    n, article = best, None
    while n is not None and article is None:  # an article is taken whole
        article = n if n.tag in WHOLE else None
        n = n.parent
    best = article or best
    top = worth(best)
    best.kept = True
    for n in tree.nodes:
        if n.parent is best.parent and best.parent is not None and n.chars and n.density() < 0.5:
            heading = n.tag in HEADINGS
            short = n.tag in PARAGRAPH and n.density() < 0.25 and (n.chars > 80 or n.last in SENTENCE_ENDS)
            n.kept = n.kept or (article is None and (heading or short)) or worth(n) >= max(10, 0.2 * top)
    for n in tree.nodes:
        if not n.kept and n.parent is not None and n.parent.kept:
            links = article is None and n.tag in ("ul", "ol", "div", "section", "table", "dl") and n.linked > 25 and n.density() > 0.75
            n.kept = not links
    return " ".join(text for text, owner, _ in tree.blocks if owner.kept)


def _extract(batches, html_at: int):
    for batch in batches:
        texts = [main_text(x) for x in batch.column(html_at).to_pylist()]
        yield batch.drop_columns([batch.schema.names[html_at]]).append_column("text", pa.array(texts, pa.string()))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """Each page's main text: the columns in keep, text string, n_chars long (code points).

    Null or empty html gives an empty text. Rows are taken one by one and whole, so repeated
    rows and ties need no rule; time is linear in a page's length, however it is nested or
    malformed. Other columns, also those named text or n_chars, are left out. No shuffle.
    """
    rows = pages.select(*keep, F.col(html_col).alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(lambda it: _extract(it, len(keep)), f"{schema}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
