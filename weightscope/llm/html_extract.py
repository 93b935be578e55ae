"""Main text of web pages by scoring the element tree.

Paragraphs pass points for their length and commas to the elements that hold
them, less for each level up; an element's points are discounted by the share
of its text that is links. The element with most points tells where the article
is: it has the whole of the article or main element around that, and what stands
beside it on any level unless that is boilerplate or mostly links.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weightscope.llm.common import map_batches

_TAG = re.compile(r"[A-Za-z][^\s/>]*")
_SPECIAL = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to the end tag, and none of the article.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never are part of an article.
DROPPED = frozenset("nav footer aside form button select option input dialog menu head object embed canvas audio video svg annotation annotation-xml template".split())
#: Roles and words of class or id that mark what is no part of an article.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words that mark boilerplate wherever they stand in a class or id.
BOILERPLATE = frozenset(
    "adsense advert advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments consent contentinfo cookie cookies disqus footer gdpr masthead"
    " menu modal nav navbar navigation newsletter pagination popup promo promotion sidebar sponsor sponsored toolbar".split()
)
#: Words that do so where all words beside them say nothing else.
UNLIKELY = BOILERPLATE | frozenset(
    "ad ads adv alert discussion feedback foot header hidden login notice notices overlay pager rail recommended recommendations related replies reply respond share"
    " sharing side signup skip social subscribe subscription widget".split()
)
#: Words of classes that say where or how, but not what.
NEUTRAL = frozenset(
    "area articles bar block body bottom box button buttons card container content form global group icons inner items left link links list main medium outer page panel"
    " post posts primary right secondary section site slot small sticky text top unit wrap wrapper zone".split()
)
LIKELY = frozenset("article content body main entry post story text page column blog hentry".split())
#: What closes an open element of the first kind when it starts.
CLOSES = {
    "p": BLOCKS - {"caption", "html", "body", "legend", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "option": frozenset({"option", "optgroup"}),
    "tr": frozenset({"tr", "tbody", "thead", "tfoot"}),
    "td": frozenset({"td", "th", "tr"}),
    "th": frozenset({"td", "th", "tr"}),
}
#: End tags reach no further out than these.
SCOPES = frozenset("html body table td th article section main div aside nav footer header".split())


class Node:
    """An element: its children are elements and strings."""

    __slots__ = ("tag", "attributes", "children", "parent", "score", "size", "linked", "dropped")

    def __init__(self, tag: str, attributes: str = "", parent: Node | None = None):
        self.tag, self.parent, self.children = tag, parent, []
        self.attributes = attributes
        self.score, self.size, self.linked, self.dropped = 0.0, 0, 0, False


class _Tags:
    """Where the tags of a page end, in time linear in the page however it is broken."""

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.special = (0, -1)  # from where to where the next of > " ' is known
        self.open: set[int] = set()  # quotes from which no tag ends

    def _next(self, at: int) -> int:
        """The place of the next of > \" ' from ``at``; the page's length if there is none."""
        low, high = self.special
        if not low <= at <= high:
            m = _SPECIAL.search(self.source, at)
            self.special = (at, m.start() if m else len(self.source))
        return self.special[1]

    def end(self, at: int) -> int:
        """Where the tag whose attributes start at ``at`` has its >; -1 if nowhere.

        That is the first > outside quotes, or where quotes don't pair up before
        the page ends, simply the first.
        """
        if at > self.last:
            return -1
        begin, passed = at, []
        while True:
            stop = self._next(at)
            if stop == len(self.source):
                break
            if self.source[stop] == ">":
                return stop
            passed.append(stop)
            close = -1 if stop in self.open else self.source.find(self.source[stop], stop + 1)
            if close < 0:
                break
            at = close + 1
        self.open.update(passed)
        return self.source.find(">", begin)


def parse(source: str) -> Node:
    """The element tree of a page, whatever its faults, in time linear in its length."""
    root, tags, size, at = Node("html"), _Tags(source), len(source), 0
    open_ = [root]  # the open elements, outermost first
    places: dict[str, list[int]] = {}  # of each kind, where in ``open_`` it stands
    scopes, blocks, raw_ends = [0], [0], {}

    def close(index: int) -> None:
        """Close the element at ``index`` of ``open_`` and all in it."""
        while len(open_) > index:
            tag, i = open_.pop().tag, len(open_)
            places[tag].pop()
            for known in (scopes, blocks):
                if known[-1] == i:
                    known.pop()

    while at < size:
        i = source.find("<", at)
        if i < 0:
            open_[-1].children.append(source[at:])
            break
        if i > at:
            open_[-1].children.append(source[at:i])
        if source.startswith("<!--", i):
            end = source.find("-->", i + 4)
            at = end + 3 if end >= 0 else size
            continue
        if source.startswith(("<!", "<?"), i):
            end = source.find(">", i)
            at = end + 1 if end >= 0 else size
            continue
        ends = source.startswith("</", i)
        m = _TAG.match(source, i + 1 + ends)
        stop = tags.end(m.end()) if m else -1
        if stop < 0:  # no tag: text up to the next one
            at = source.find("<", i + 1)
            at = at if at >= 0 else size
            open_[-1].children.append(source[i:at])
            continue
        tag, attributes, at = m[0].lower(), source[m.end() : stop], stop + 1
        if ends:
            index = (places.get(tag) or [0])[-1]
            if index and (tag in SCOPES or tag in BLOCKS or index >= scopes[-1]):
                close(index)
            continue
        if tag in ("html", "body"):
            continue
        while len(open_) > 1 and tag in CLOSES.get(open_[-1].tag, ()):
            close(len(open_) - 1)
        if tag in BLOCKS and tag in CLOSES.get(open_[blocks[-1]].tag, ()):
            close(blocks[-1])  # an unclosed inline element in a paragraph doesn't keep the paragraph open
        node = Node(tag, attributes, open_[-1])
        open_[-1].children.append(node)
        if tag in RAW:
            if tag not in raw_ends:
                raw_ends[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)
            end = raw_ends[tag].search(source, at)
            at = end.end() if end else size
        elif tag not in VOID and not attributes.endswith("/"):
            places.setdefault(tag, []).append(len(open_))
            if tag in SCOPES:
                scopes.append(len(open_))
            if tag in BLOCKS:
                blocks.append(len(open_))
            open_.append(node)
    return root


def _names(node: Node) -> tuple[list[list[str]], dict[str, str]]:
    """Classes and ids, each as its words, and the attributes."""
    pairs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(node.attributes)} if node.attributes else {}
    text = f"{pairs.get('class', '')} {pairs.get('id', '')}"
    return [w for x in text.split() if (w := re.findall("[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower()))], pairs


def _is_boilerplate(words: list[str], inside: bool) -> bool:
    """Does a class mark what is no part of an article? ``inside`` one, it must say nothing else."""
    found = UNLIKELY.intersection(words)
    if not found or (LIKELY.intersection(words) and found <= {"header", "side", "hidden"}):
        return False
    return UNLIKELY.union(NEUTRAL, LIKELY).issuperset(words) or (not inside and not BOILERPLATE.isdisjoint(words))


def _is_dropped(node: Node, inside: bool) -> bool:
    """Is an element no part of any article? ``inside``: an article element holds it."""
    if node.tag in DROPPED or node.tag in RAW or (node.tag == "header" and not inside):
        return True
    if not node.attributes or node.tag in ("article", "main", "html", "body"):
        return False
    names, pairs = _names(node)
    if "hidden" in pairs or pairs.get("aria-hidden") == "true" or pairs.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", pairs.get("style", "")):
        return True
    likely = any(LIKELY.issuperset(w) for w in names)  # one class of several that names the content itself
    return any(_is_boilerplate(w, inside or likely) for w in names)


def _measure(root: Node) -> list[Node]:
    """Mark what is dropped; give every other element its size and linked size. Returns those in page order."""
    order, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        node.dropped = node is not root and _is_dropped(node, inside)
        if node.dropped:
            continue
        order.append(node)
        inside = inside or node.tag in ("article", "main")
        stack += [(c, inside) for c in reversed(node.children) if isinstance(c, Node)]
    for node in reversed(order):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        kept = [c for c in node.children if isinstance(c, Node) and not c.dropped]
        node.size = own + sum(c.size for c in kept)
        node.linked = node.size if node.tag == "a" else sum(c.linked for c in kept)
    return order


def _paragraph_text(node: Node) -> str:
    """Text of an element without the blocks in it."""
    out, stack = [], list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            out.append(c)
        elif not c.dropped and c.tag not in BLOCKS:
            stack += reversed(c.children)
    return _SPACE.sub(" ", "".join(out)).strip()


def _score(order: list[Node]) -> None:
    """Let paragraphs pass points to what holds them."""
    for node in order:
        if node.tag in BLOCKS and node.tag not in ("li", "html"):
            text = _paragraph_text(node)
            if len(text) < 25:
                continue
            points = 1 + text.count(",") + min(3, len(text) // 100)
            up, level = (node.parent if node.tag in ("p", "pre", "blockquote") else node), 0
            while up is not None and level < 4:
                up.score += points / (1, 2, 6, 9)[level]
                up, level = up.parent, level + 1
    for node in order:
        if node.tag in ("article", "main"):
            node.score += 25
        node.score += 10 * bool(node.attributes and any(LIKELY.intersection(w) for w in _names(node)[0]))
        if node.size:
            node.score *= 1 - node.linked / node.size


def _blocks(node: Node, out: list[list[str]]) -> None:
    """Runs of text between block boundaries, in page order."""
    stack: list = [node]
    while stack:
        c = stack.pop()
        if c is None:
            out.append([])
        elif isinstance(c, str):
            out[-1].append(c)
        elif c.dropped:
            continue
        elif c.tag == "br":
            out[-1].append(" ")
        elif c.tag in BLOCKS:
            out.append([])
            stack += [None, *reversed(c.children)]
        else:
            stack += reversed(c.children)


def _beside(parent: Node, child: Node) -> tuple[list[list], list[list]]:
    """What stands before and after a child, by block or run of inline content, without boilerplate."""
    sides: tuple[list[list], list[list]] = ([], [])
    side, run = sides[0], None
    for c in parent.children:
        if c is child:
            side, run = sides[1], None
        elif isinstance(c, Node) and c.dropped:
            continue
        elif isinstance(c, Node) and c.tag in BLOCKS:
            side.append([c])
            run = None
        elif run is None:
            side.append(run := [c])
        else:
            run.append(c)
    low = lambda part: _is_heading(part[0]) or 2 * _total(part, "linked") <= _total(part, "size")
    return list(filter(low, sides[0])), list(filter(low, sides[1]))


def _is_heading(node: Node | str) -> bool:
    """Titles stay though they often are links."""
    return isinstance(node, Node) and node.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup")


def _total(part: list, what: str) -> int:
    return sum(getattr(c, what) if isinstance(c, Node) else len(c.strip()) * (what == "size") for c in part)


def main_text(source: str | None) -> str:
    """The article of a page as blocks with an empty line between them."""
    if not source:
        return ""
    root = parse(source)
    order = _measure(root)
    _score(order)
    holders = [n for n in order if n.tag in BLOCKS and n.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "hr") and n.size]
    best = max(holders, key=lambda n: n.score, default=root)
    top = up = best
    while up is not None:
        if up.tag in ("article", "main"):
            top = up
        up = up.parent
    before, after, child = [], [], top
    while child.parent is not None:
        left, right = _beside(child.parent, child)
        before.append(left)
        after += right
        child = child.parent
    out: list[list[str]] = [[]]
    for part in (*(x for left in reversed(before) for x in left), [top], *after):
        for node in part:
            _blocks(node, out)
        out.append([])
    texts = (_SPACE.sub(" ", html.unescape("".join(x))).strip() for x in out if x)
    return "\n\n".join(x for x in texts if x)


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every whole page.

    ``pages`` needs page_id, url and html; other columns are ignored. Returns
    page_id, url, text ('' if there is none) and n_chars (its code points).
    Null and empty pages have no text; of containers with equal points the
    first in the page counts; equal rows give equal rows; an empty table gives
    an empty one. One pass, no shuffle; time and memory are linear in a page's
    length, whatever it holds, and a page is in memory as a whole.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"]
        )

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), work, "page_id long, url string, text string, n_chars long")
