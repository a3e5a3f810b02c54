"""HTML extraction by tag-path ratios."""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import map_arrow, prepare

#: A tag whose attributes are of the common forms; the others are read one by one. Possessive, hence linear.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:\s++[^\s/>\"'=<]++(?:=\"[^\"]*+\")?+)*+\s*+/?)>")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_GAP = re.compile(r"[\s/]*+")
_ATTR = re.compile(r"([^\s/>][^\s/>=]*+)(\s*+=\s*+)?+")
_BARE = re.compile(r"[^\s>]*+")
_COMMENT_END = re.compile(r"--!?>")
_PUNCT = re.compile(r"[.,;:!?…。、，؟।]")
_WORD = re.compile(r"[^a-z0-9]+")

#: Elements whose content is no markup; without an end tag they reach to the end of the page, as in browsers.
RAW = {"script", "style", "noscript", "textarea", "title", "iframe", "noembed", "noframes"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
FOREIGN = {"svg", "math"}
#: Within svg and math, HTML is held by these; elsewhere the start of one of BREAKS ends svg and math, as in browsers.
HTML_WITHIN = {"foreignobject", "desc", "title", "annotation-xml", "mi", "mo", "mn", "ms", "mtext"}
BREAKS = {
    "b", "big", "blockquote", "body", "br", "center", "code", "dd", "div", "dl", "dt", "em", "embed", "h1", "h2", "h3", "h4", "h5",
    "h6", "head", "hr", "i", "img", "li", "listing", "menu", "meta", "nobr", "ol", "p", "pre", "ruby", "s", "small", "span",
    "strong", "strike", "sub", "sup", "table", "tt", "u", "ul", "var", "article", "section", "main",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "label", "mark", "object", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
PAGE = {"", "html", "body"}
PARTS = PAGE | {"div", "section", "article", "main", "center"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = HEADINGS | {"p", "blockquote", "pre", "dd", "dt", "figcaption", "summary"}
CONTENT = {"article", "main"}
BOILERPLATE = {"nav", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "header", "template"}
HEAD = {"base", "link", "meta", "template", *RAW}
#: End tags do not reach beyond these, but for their own and those of tables.
SCOPES = {"", "table", "td", "th", "caption", "template", "object"}
TABLE = {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}
#: Words in class, id or role that mark page furniture.
HINTS = {
    "ad", "ads", "advert", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "commentlist", "consent", "cookie", "cookies", "disclaimer", "footer", "gdpr", "header", "masthead", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promoted", "related", "replies",
    "respond", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
    "alert", "complementary", "contentinfo", "signup", "login", "discussion",
}
#: Words that make a longer name one of a layout: has-sidebar, no-header.
LAYOUT = {"has", "no", "with", "without"}
#: Hints that outweigh the content's text at times.
REPLIES = {"comment", "comments", "commentlist", "replies", "respond", "discussion"}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
#: A hint tells against a text only beside paths without one whose ratio is at least this share of the text's.
RIVAL = 0.5
#: Blocks without a sentence mark and with fewer characters look like the entries of a menu.
ENTRY_CHARS = 30


class _Node:
    """An element. What holds for its ancestors is handed down when it is made, so that no step climbs the tree."""

    __slots__ = ("bare", "best", "block", "chosen", "content", "foreign", "free", "hinted", "hints", "holds", "key", "link", "out", "own",
                 "path", "pos", "scope", "skip", "tag", "trusted", "up", "within")

    def __init__(self, tag: str, up: _Node | None, pos: int, hints: set[str], bare: set[str]):
        self.tag, self.up, self.pos, self.hints, self.bare = tag, up, pos, hints, bare
        inline = up is not None and (tag in INLINE or up.skip or tag in FOREIGN)
        self.block: _Node = up.block if inline else self
        self.scope: _Node = self if up is None or tag in SCOPES else up.scope
        self.link = up is not None and (up.link or tag == "a")
        self.skip = up is not None and (up.skip or tag in FOREIGN)
        self.foreign = tag in FOREIGN or (up is not None and up.foreign and tag not in HTML_WITHIN)
        # an end tag of an inline element does not reach beyond the block, one of a block not beyond the scope
        self.key = (id(self.block if tag in INLINE else self.scope if up is None or tag not in SCOPES else up.scope), tag)
        self.path = up.path if inline else 0
        self.content: _Node | None = self if tag in CONTENT else up.content if up else None
        self.own: _Node = self if up is None or tag in PARTS else up.own
        self.out = self.hinted = self.holds = self.trusted = self.within = False
        self.free = self.chosen = 0
        self.best = 0.0


Block = tuple[_Node, int, str, int]


def _hints(found: list[str]) -> tuple[set[str], set[str]]:
    """The words of names in class, id and role that are hints, and those of them that are a whole name."""
    words: set[str] = set()
    names = {n for value in found for n in value.lower().split()}
    for name in names:
        some = set(_WORD.split(name))
        if not some & LAYOUT:
            words |= some & HINTS
    return words, words & names


def _attributes(page: str, at: int) -> tuple[int, list[str]]:
    """Where a tag ends whose attributes start at a position, or -1 for a tag without end, and its class, id and role."""
    found: list[str] = []
    while True:
        at = _GAP.match(page, at).end()
        if at >= len(page):
            return -1, found
        if page[at] == ">":
            return at + 1, found
        m = _ATTR.match(page, at)
        at = m.end()
        if not m[2] or at >= len(page):
            continue
        if page[at] in "\"'":
            end = page.find(page[at], at + 1)
            if end < 0:
                return -1, found
            value, at = page[at + 1 : end], end + 1
        else:
            value = _BARE.match(page, at)[0]
            at += len(value)
        if m[1].lower() in ("class", "id", "role"):
            found.append(value)


class _Parser:
    """One page as elements and blocks of text. Every character is looked at a bounded number of times."""

    def __init__(self, page: str):
        root = _Node("", None, 0, set(), set())
        self.page, self.root, self.owner = page, root, root
        self.stack, self.nodes = [root], [root]
        self.blocks: list[Block] = []
        self.held: list[str] = []
        self.linked = 0
        self.open: Counter = Counter()  # open elements by reach and tag
        self.names: Counter = Counter()  # open elements by tag
        self.paths: dict[tuple[int, str], int] = {}
        #: Open objects: blocks, held pieces and linked characters before them; those from `fresh` on began in what is held,
        #: the others have the pieces that were held before them.
        self.objects: list[list] = []
        self.fresh = 0
        self._read()
        self.objects.clear()  # none of them will be closed
        self.fresh = 0
        self.flush()

    def _emit(self, pieces: list[str], linked: int) -> None:
        text = " ".join("".join(pieces).split())
        if text:
            self.blocks.append((self.owner, self.owner.path, text, linked))

    def flush(self) -> None:
        start, before = 0, 0
        for record in self.objects[self.fresh :]:
            at, linked = len(self.blocks), record[2]
            pieces = self.held[start : record[1]]
            self._emit(pieces, linked - before)
            record[:] = at, None, linked - before, pieces
            start, before = start + len(pieces), linked
        self.fresh = len(self.objects)
        self._emit(self.held[start:], self.linked - before)
        self.held, self.linked = [], 0

    def say(self, text: str) -> None:
        top = self.stack[-1]
        if top.skip or not text:
            return
        if top.block.tag == "head":
            if text.isspace():
                return
            self.flush()
            self.pop(top.block.pos)
            top = self.stack[-1]
        if top.block is not self.owner:
            self.flush()
            self.owner = top.block
        if "&" in text:
            text = _html.unescape(text)
        self.held.append(text)
        if top.link:
            self.linked += len(text.strip())

    def pop(self, pos: int) -> None:
        for node in self.stack[pos:]:
            self.open[node.key] -= 1
            self.names[node.tag] -= 1
            if node.tag == "object" and not node.skip:
                self.objects.pop()
                self.fresh = min(self.fresh, len(self.objects))
        del self.stack[pos:]

    def push(self, tag: str, names: list[str]) -> None:
        up = self.stack[-1]
        hints, bare = _hints(names) if names and tag not in ("html", "body") else (set(), set())
        if up.content is not None:
            hints.discard("header")
        node = _Node(tag, up, len(self.stack), hints, bare & hints)
        if node.block is node:
            label = tag + "".join(f".{h}" for h in sorted(hints))
            node.path = self.paths.setdefault((up.block.path, label), len(self.paths) + 1)
            self.owner = node
        self.nodes.append(node)
        self.stack.append(node)
        self.open[node.key] += 1
        self.names[tag] += 1
        if tag == "object" and not node.skip:
            self.objects.append([len(self.blocks), len(self.held), self.linked, None])

    def start(self, tag: str, names: list[str], closed: bool) -> None:
        top = self.stack[-1]
        if top.foreign:
            if tag not in BREAKS:
                if not closed:
                    self.push(tag, names)
                return
            while self.stack[-1].foreign:
                self.pop(len(self.stack) - 1)
        top = self.stack[-1]
        if top.block.tag == "head" and tag not in HEAD and not top.skip:
            self.flush()
            self.pop(top.block.pos)
        if tag in VOID:
            if tag == "hr":
                if not self.stack[-1].skip:
                    self.flush()
            elif tag == "br":
                self.say(" ")
            return
        if tag in ("html", "body") and self.names[tag]:
            return
        if tag in FOREIGN and closed:
            return
        if tag not in INLINE and tag not in FOREIGN and not self.stack[-1].skip:
            self.flush()
            shut = CLOSES.get(tag, set()) | HEADINGS | {"p"}
            while (top := self.stack[-1]).block.tag in shut and top.scope is top.block.scope:
                self.pop(top.block.pos)
        self.push(tag, names)

    def end(self, tag: str) -> None:
        if tag in VOID or tag in ("html", "body"):
            if tag == "br":
                self.say(" ")
            return
        top = self.stack[-1]
        if tag in TABLE or tag in FOREIGN or tag in SCOPES or top.foreign:
            if not self.names[tag]:
                return
        elif not self.open[(id(top.block if tag in INLINE else top.scope), tag)]:
            return
        pos = len(self.stack) - 1
        while self.stack[pos].tag != tag:
            pos -= 1
        node = self.stack[pos]
        if tag == "object" and not node.skip:
            # what a closed object holds is shown only where the object is not
            blocks, held, linked, pieces = self.objects[-sum(n.tag == "object" and not n.skip for n in self.stack[pos:])]
            del self.blocks[blocks:]
            self.held = self.held[:held] if pieces is None else pieces
            self.linked = linked
        elif node.block is node and not node.skip:
            self.flush()
        self.pop(pos)
        if not self.held or tag == "object":
            self.owner = self.stack[-1].block

    def _read(self) -> None:
        page, at, size = self.page, 0, len(self.page)
        while at < size:
            i = page.find("<", at)
            if i < 0:
                self.say(page[at:])
                return
            after = page[i + 1 : i + 2]
            ending = after == "/"
            letter = page[i + 2 : i + 3] if ending else after
            if not (letter.isascii() and letter.isalpha()) and after not in ("!", "?") and not (ending and letter):
                self.say(page[at : i + 1])  # a mere sign
                at = i + 1
                continue
            if i > at:
                self.say(page[at:i])
            if not (letter.isascii() and letter.isalpha()):
                at = self._comment(i)
                continue
            m = _TAG.match(page, i)
            names: list[str] = []
            if m is not None:
                tag, at = m[2].lower(), m.end()
                closed = m[3].endswith("/")
                if not ending and '="' in m[3]:
                    names = _attributes(page, m.end(2))[1]
            else:
                m = _NAME.match(page, i)
                tag = m[1].lower()
                at, names = _attributes(page, m.end())
                if at < 0:  # a tag without end hides the rest, as in browsers
                    return
                closed = page[at - 2] == "/"
            if ending:
                self.end(tag)
            elif tag in RAW and not self.stack[-1].foreign:
                end = _RAW_END[tag].search(page, at)
                if end is None:
                    return
                at = _attributes(page, end.end())[0]
                if at < 0:
                    return
            else:
                self.start(tag, names, closed)

    def _comment(self, i: int) -> int:
        """Where a comment, declaration or odd end tag that starts at i ends."""
        page = self.page
        if page.startswith("<!--", i):
            for odd in ("<!-->", "<!--->"):
                if page.startswith(odd, i):
                    return i + len(odd)
            m = _COMMENT_END.search(page, i + 4)
            return m.end() if m else len(page)
        mark = "]]>" if page.startswith("<![CDATA[", i) and self.stack[-1].foreign else ">"
        end = page.find(mark, i + 2)
        return end + len(mark) if end >= 0 else len(page)


def parse_blocks(page: str | None) -> tuple[list[_Node], list[Block]]:
    """The elements in page order, and per text block its element, tag path, text and characters within links."""
    made = _Parser(page or "")
    return made.nodes, made.blocks


def raw_ratios(blocks: list[Block]) -> dict[int, float]:
    """Per tag path the fused ratio: unlinked characters per block, times sentence marks per block and one, as a mean of both."""
    length: dict[int, int] = defaultdict(int)
    marks: dict[int, int] = defaultdict(int)
    count: dict[int, int] = defaultdict(int)
    for _, path, text, linked in blocks:
        length[path] += max(0, len(text) - linked)
        marks[path] += len(_PUNCT.findall(text))
        count[path] += 1
    return {p: math.sqrt(length[p] / n * (1 + marks[p] / n)) for p, n in count.items()}


def path_scores(blocks: list[Block], ratios: dict[int, float], sigma: float = 1.0) -> dict[int, float]:
    """Per tag path the mean of its blocks' ratios after smoothing over neighbouring blocks in page order."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    raw = [ratios[b[1]] for b in blocks]
    total: dict[int, float] = defaultdict(float)
    count: dict[int, int] = defaultdict(int)
    for i, block in enumerate(blocks):
        low, high = max(0, i - reach), min(len(raw), i + reach + 1)
        part = kernel[low - i + reach : high - i + reach]
        total[block[1]] += sum(map(float.__mul__, part, raw[low:high])) / sum(part)
        count[block[1]] += 1
    return {p: total[p] / n for p, n in count.items()}


def path_ratios(blocks: list[Block]) -> list[float]:
    """Per block the smoothed ratio of its path."""
    scores = path_scores(blocks, raw_ratios(blocks))
    return [scores[b[1]] for b in blocks]


def _furniture(nodes: list[_Node], blocks: list[Block], ratios: dict[int, float]) -> None:
    """Marks elements whose paths have no weight: those that their tag, or a hint in class, id or role, calls furniture.

    A form that holds an article, or most of the page's unlinked text, is none. A hint is a prior: it is ignored on an
    element that holds an article or main where none has text outside elements with hints; on one that holds most of the
    page's unlinked text, but for replies beside rivals and, beside an article's text, for elements outside it or with a
    hint as a whole name that hold no article themselves; and on all elements where nothing else would be left.
    """
    for node, path, text, linked in blocks:
        node.free += max(0, len(text) - linked)
        node.best = max(node.best, ratios[path])
    for n in reversed(nodes):
        n.holds |= n.tag in CONTENT and not n.hints and n.free > 0
        if n.up is not None:
            n.up.free += n.free
            n.up.best = max(n.up.best, n.best)
            n.up.holds |= n.holds
    whole = nodes[0].free
    for n in nodes[1:]:
        inside = n.up.content is not None
        if n.tag == "form":
            bad = not n.holds and 2 * n.free <= whole
        else:
            bad = n.tag in BOILERPLATE and not (n.tag == "header" and inside)
        n.out = n.up.out or bad
        n.hinted = n.up.hinted or bool(n.hints and (n.tag not in CONTENT or n.bare & REPLIES))
    clean = [b for b in blocks if not b[0].out and not b[0].hinted and len(b[2]) > b[3]]
    apart = any(b[0].content is not None for b in clean)
    rival = max((ratios[b[1]] for b in clean), default=-1.0)
    out = {n for n in nodes if n.out}
    for n in nodes[1:]:
        if n.hints and (n.tag not in CONTENT or n.bare & REPLIES):
            inside = n.up.content is not None
            most = 2 * n.free > whole and not (n.bare & REPLIES and rival >= RIVAL * n.best)
            most = most and (n.holds or not apart or (inside and not n.bare))
            n.out |= not most and (apart or not n.holds)
        n.out |= n.up.out
    if all(b[0].out for b in blocks):
        for n in nodes:
            n.out = n in out


def main_text(page: str | None) -> str:
    """The main text of one page; empty for null, for empty pages and for pages of furniture alone.

    Paths are selected whose smoothed ratio is not below the mean by more than the spread, unless they pass through
    furniture or most of their text is within links. The blocks of the selected paths are the text, with what lies around
    them: all of the article or main that is nearest to a selected block; what lies in the least element that holds all
    selected blocks, where that is no mere body; what lies between selected blocks, or in their body; and the run of blocks
    before them from its first heading on. Outside an article or main, blocks that look like a menu's stay only after that
    heading, or beside selected blocks of their own part. Lists of links stay only in an element that also holds selected blocks.
    """
    nodes, blocks = parse_blocks(page)
    if not blocks:
        return ""
    ratios = raw_ratios(blocks)
    _furniture(nodes, blocks, ratios)
    blocks = [b for b in blocks if not b[0].out]
    if not blocks:
        return ""
    scores = path_scores(blocks, ratios)
    mean = sum(scores[b[1]] for b in blocks) / len(blocks)
    spread = math.sqrt(sum((scores[b[1]] - mean) ** 2 for b in blocks) / len(blocks))
    total: dict[int, int] = defaultdict(int)
    free: dict[int, int] = defaultdict(int)
    entries: dict[int, bool] = defaultdict(lambda: True)
    for node, path, text, linked in blocks:
        total[path] += len(text)
        free[path] += max(0, len(text) - linked)
        entries[path] &= node.tag not in PROSE and len(text) < ENTRY_CHARS and not _PUNCT.search(text)
    linked_paths = {path for node, path, _, _ in blocks if 2 * free[path] < total[path] and node.tag not in HEADINGS}
    if len(linked_paths) == len(total):
        linked_paths = set()
    selected = {p for p, s in scores.items() if s >= mean * (1 - 1e-9) - spread and p not in linked_paths and not entries[p]}
    selected = selected or set(total) - linked_paths
    chosen = [b[1] in selected for b in blocks]
    for (node, _, _, _), x in zip(blocks, chosen, strict=True):
        if x:
            node.chosen += 1
            if node.content is not None:
                node.content.trusted = True
    for n in reversed(nodes):
        if n.up is not None:
            n.up.chosen += n.chosen
    first, last = chosen.index(True), len(chosen) - 1 - chosen[::-1].index(True)
    top = blocks[first][0]
    while top.chosen < sum(chosen):
        top = top.up
    top.within = True
    for n in nodes[1:]:
        n.trusted |= n.up.trusted
        n.within |= n.up.within
    whole = top.tag not in PAGE
    links = [b[1] in linked_paths for b in blocks]
    start = head = first
    while start and not links[start - 1]:
        start -= 1
        if blocks[start][0].tag in HEADINGS:
            head = start

    def stays(i: int) -> bool:
        node, path = blocks[i][0], blocks[i][1]
        if chosen[i] or node.trusted:
            return True
        if links[i]:
            return node.within and node.own.chosen > 0 and node.own.tag not in PAGE
        if i < first:
            return i >= head or (node.within and (whole or i >= start) and not entries[path])
        if i < last:
            return node.within
        return node.within and (node.own.chosen > 0 or (whole and not entries[path]))

    return "\n".join(b[2] for i, b in enumerate(blocks) if stays(i))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars per row of pages, from the whole html. No shuffle.

    Null html counts as empty; its text is empty. Unclosed and stray tags are closed as browsers do, in time linear in the
    length of the page. Null ids and urls and repeated rows stay as they are, empty tables give no rows; further columns,
    whatever their names, are not read.
    """
    prepare(pages.sparkSession)
    some = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html")
    )

    def texts(batch: pa.RecordBatch) -> dict:
        got = [main_text(h) for h in batch.column("html").to_pylist()]
        return {
            "page_id": batch.column("page_id"),
            "url": batch.column("url"),
            "text": pa.array(got, pa.string()),
            "n_chars": pa.array(map(len, got), pa.int64()),
        }

    kind = some.schema["page_id"].dataType.simpleString()
    return map_arrow(some, f"page_id {kind}, url string, text string, n_chars long", texts)
