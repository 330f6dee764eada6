"""Main text of web pages by tree scoring.

A page is read into a tree with HTML's rules for tags that close themselves, in time linear
in its length, whatever its bytes are: comments begin where markup is expected, not in scripts or attributes, and
what a tag or comment that never ends would take is left out. Elements that are never main text (menus, scripts,
hidden parts) are left out, and forms too, but for a form around the page: one that holds an article, or most of the text
that stands in long blocks, or paragraphs if there is no text beside it. Each paragraph passes points for its length and commas to its ancestors, half as many to
each farther one, discounted by its share of linked text, and if an element around it is named
as noise (adverts, sidebars, notices, reader comments). The best container and those of its
siblings that read like it are kept, with all their blocks, short ones too, but for noise
inside them. A name alone never drops the best container: noise that holds most of its text
stays, unless it is named as reader comments or stands in an article element, and names of states
such as ``no-sidebar`` and ``ad-free`` are no noise. If an article element outside noise has text,
the best container isn't looked for in noise.

Blocks are joined by two line ends, white space inside a block is one space. Null and empty
pages, and pages without text, have empty text. Equal pages get equal texts; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.arrow import map_texts
from tidewell.session import ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is no main text wherever they stand.
DROPPED = frozenset("aside button canvas datalist dialog embed footer head iframe input label legend map menu nav noscript object script search select style svg template textarea title".split())
#: Words of a class or id that name no main text.
NOISE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer gdpr "
    "masthead menu modal nav navbar navigation newsletter notice outbrain overlay pager pagination popup promo promotion related share sharing "
    "sidebar skip social sponsor sponsored subscribe subscription taboola toolbar topbar widget widgets".split()
)
#: Words that name reader comments.
COMMENTS = frozenset("comment comments commentlist discussion disqus guestbook livefyre replies reply respond responses talkback".split())
#: Words of a name that tell how a part is laid out or what it may have, not what it is.
STATES = frozenset("no not non has have with without free enabled disabled open closed layout is less aware".split())
#: What is left of a paragraph's points inside noise, and of a container's text beside noise for the noise to go.
IN_NOISE, BESIDE_NOISE = 0.2, 0.25
PARAGRAPHS = frozenset("p pre blockquote li td th dd dt h1 h2 h3 h4 h5 h6 figcaption caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset({"article", "main"})
NEVER_DROPPED = frozenset("html body article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
#: What a start tag closes if it is open, and the elements beyond which it closes nothing.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"}), "a": ({"a"}, {"td", "table"}),
}
KEEPS_P = frozenset({"li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "html", "head", "body", "title", "optgroup", "caption", "legend", "summary"})
BOUND = frozenset({"table", "td", "th", "button", "html"})
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
LEAST, LEVELS, LONG = 25, 5, 80
#: Elements whose content is text up to their end tag.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
_NAME = re.compile(r"[a-zA-Z][^\t\n\f\r />]*")
_ATTRIBUTE = re.compile(r"[\t\n\f\r /]*(?:([^\t\n\f\r />][^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:([\"'])|([^\t\n\f\r >\"'][^\t\n\f\r >]*)?))?)?")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {t: re.compile(rf"</{t}(?=[\t\n\f\r />])", re.I) for t in RAW}
_LONG_NUMBER = re.compile(r"&#(?:0*[1-9]\d{7,}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{7,})")
_ZEROS = re.compile(r"&#(?:0{9,}(?=\d)|([xX])0{9,}(?=[0-9a-fA-F]))")


def decoded(text: str) -> str:
    """Text with its character references decoded; numbers beyond all characters are replacement characters."""
    return unescape(_ZEROS.sub(r"&#\1", _LONG_NUMBER.sub("&#65533", text))) if "&" in text else text


def tag_at(html: str, at: int) -> tuple[str, list[tuple[str, str]], int] | None:
    """(name, attributes, place after it) of a tag whose name begins at a place, or None if it never ends."""
    m = _NAME.match(html, at)
    name, attrs, at = m[0].lower(), [], m.end()
    while True:
        m = _ATTRIBUTE.match(html, at)
        at = m.end()
        if m[1]:
            value = m[3] or ""
            if m[2]:
                end = html.find(m[2], at)
                if end < 0:
                    return None
                value, at = html[at:end], end + 1
            attrs.append((m[1].lower(), decoded(value)))
        elif at < len(html) and html[at] == ">":
            return name, attrs, at + 1
        if at >= len(html):
            return None


def tokens(html: str) -> Iterator[tuple[str, str, list]]:
    """("text", text, []), ("start", name, attributes) and ("end", name, []) in page order.

    Each byte is looked at once or twice: a tag or comment that never ends ends the page.
    """
    at = 0
    while True:
        lt = html.find("<", at)
        if lt < 0:
            break
        c = html[lt + 1 : lt + 2]
        if c.isascii() and c.isalpha():
            if lt > at:
                yield "text", decoded(html[at:lt]), []
            found = tag_at(html, lt + 1)
            if found is None:
                return
            name, attrs, at = found
            yield "start", name, attrs
            if name in RAW:
                end = _RAW_END[name].search(html, at)
                text = html[at : end.start() if end else len(html)]
                yield "text", decoded(text) if name in ("textarea", "title") else text, []
                if end is None:
                    return
                at = end.start()
        elif c in ("/", "!", "?") and c:
            if lt > at:
                yield "text", decoded(html[at:lt]), []
            if c == "/" and _NAME.match(html, lt + 2):
                found = tag_at(html, lt + 2)
                if found is None:
                    return
                yield "end", found[0], []
                at = found[2]
            elif html.startswith("<!--", lt):
                short = 5 if html.startswith("<!-->", lt) else 6 if html.startswith("<!--->", lt) else 0
                m = None if short else _COMMENT_END.search(html, lt + 4)
                if not short and m is None:
                    return
                at = lt + short if short else m.end()
            else:
                end = html.find(">", lt)
                if end < 0:
                    return
                at = end + 1
        else:
            yield "text", decoded(html[at : lt + 1]), []
            at = lt + 1
    if at < len(html):
        yield "text", decoded(html[at:]), []


class Node:
    __slots__ = ("tag", "parent", "dropped", "noise", "block", "score", "chars", "linked", "kept")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, noise: int):
        self.tag, self.parent, self.dropped, self.noise, self.block = tag, parent, dropped, noise, tag in BLOCK
        self.score, self.chars, self.linked, self.kept = 0.0, 0, 0, False


def noise_of(names: str) -> int:
    """0: a class or id that names no noise, 1: noise, 2: reader comments."""
    most = 0
    for name in names.split():
        tokens = {t.lower() for t in _TOKENS.findall(name)}
        if not tokens & STATES:
            most = max(most, 2 if tokens & COMMENTS else 1 if tokens & NOISE else 0)
    return most


class Page:
    """The nodes of a page in page order, and its blocks as (node, text, linked characters)."""

    def __init__(self, html: str):
        root = Node("html", None, False, 0)
        self.nodes, self.open, self.blocks = [root], [root], []
        #: depths of the open elements of each tag, and of all open blocks, in order
        self.at: dict[str, list[int]] = {"html": [0]}
        self.block_at = [0]
        self.pieces: list[str] = []
        self.links, self.linked, self.article = 0, 0, 0
        for kind, name, attrs in tokens(html):
            if kind == "text":
                self.text(name)
            elif kind == "start":
                self.start(name, attrs)
            else:
                self.end(name)
        self.flush()
        self.drop_forms()

    def drop_forms(self) -> None:
        """Drops the blocks of all forms but those around the page."""
        outer: dict[Node | None, Node | None] = {None: None}
        for n in self.nodes:
            outer[n] = outer[n.parent] or (n if n.tag == "form" else None)
        articles = {outer[n] for n in self.nodes if n.tag in ARTICLE and not n.dropped}
        long, blocks, paragraphs = Counter(), Counter(), set()
        for node, text, _ in self.blocks:
            long[outer[node]] += len(text) if len(text) >= LONG else 0
            blocks[outer[node]] += 1
            if len(text) >= LEAST and node.tag in PARAGRAPHS:
                paragraphs.add(outer[node])
        half, n_blocks = long.total() / 2, len(self.blocks)

        def stays(f: Node | None) -> bool:
            return f is None or f in articles or long[f] > half or blocks[f] == n_blocks and f in paragraphs

        self.blocks = [b for b in self.blocks if stays(outer[b[0]])]

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.blocks.append((self.open[self.block_at[-1]], text, min(self.linked, len(text))))
        self.pieces, self.linked = [], 0

    def depth(self, tags) -> int:
        """The depth of the innermost open element of these tags, or -1."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def leave(self, depth: int) -> None:
        """Close all open elements from ``depth`` on."""
        if self.block_at[-1] >= depth:
            self.flush()
        for n in self.open[depth:]:
            self.links -= n.tag == "a"
            self.article -= n.tag in ARTICLE
            self.at[n.tag].pop()
        while self.block_at[-1] >= depth:
            self.block_at.pop()
        del self.open[depth:]

    def start(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body") and self.at.get(tag):
            return
        if tag in VOID:
            if tag == "hr":
                self.flush()
            self.pieces.append(" ")
            return
        if tag in BLOCK and tag not in KEEPS_P:
            self.close_up({"p"}, BOUND)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.leave(len(self.open) - 1)
        if tag in CLOSES:
            self.close_up(*CLOSES[tag])
        parent = self.open[-1]
        if tag in BLOCK:
            self.flush()
            self.block_at.append(len(self.open))
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(Node(tag, parent, parent.dropped or self.never(tag, attrs), self.named(tag, attrs)))
        self.nodes.append(self.open[-1])
        self.links += tag == "a"
        self.article += tag in ARTICLE

    def never(self, tag: str, attrs: list) -> bool:
        """Whether an element is no main text whatever stands in it."""
        if tag in NEVER_DROPPED:
            return False
        if tag in DROPPED or tag == "header" and not self.article:
            return True
        if not attrs:
            return False
        attrs = dict(attrs)
        return "hidden" in attrs or attrs.get("aria-hidden") == "true" or (attrs.get("role") or "").lower() in ROLES or bool(_HIDDEN.search(attrs.get("style") or ""))

    def named(self, tag: str, attrs: list) -> int:
        return noise_of(" ".join(v for k, v in attrs if v and k in ("class", "id"))) if attrs and tag not in NEVER_DROPPED else 0

    def close_up(self, tags, bound) -> None:
        i = self.depth(tags)
        if i > max(0, self.depth(bound)):
            self.leave(i)

    def end(self, tag: str) -> None:
        if tag in ("html", "body") or tag in VOID:
            if tag == "br":
                self.pieces.append(" ")
            return
        i = self.depth(HEADINGS if tag in HEADINGS else (tag,))
        if tag not in BLOCK:
            bound = self.block_at[-1]
        else:
            bound = -1 if tag in ("article", "main", "section", "div", "table") else self.depth(("table", "article", "main"))
        if i > 0 and i >= bound:
            self.leave(i)

    def text(self, data: str) -> None:
        if not self.open[-1].dropped:
            self.pieces.append(data)
            if self.links:
                self.linked += len(data)


def best(page: Page) -> Node:
    """The container with the most points, less its share of linked text and those that noise is named for."""
    inside = {None: False}
    for n in page.nodes:
        inside[n] = n.noise > 0 or inside[n.parent]
    for node, text, linked in page.blocks:
        node.chars += len(text)
        node.linked += linked
        if len(text) < LEAST:
            continue
        points = (1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)) * (1 - linked / len(text))
        points *= IN_NOISE if inside[node] else 1
        at = node.parent if node.tag in PARAGRAPHS and node.parent else node
        for _ in range(LEVELS):
            if at is None:
                break
            at.score += points
            points /= 2
            at = at.parent
    for n in reversed(page.nodes):
        if n.parent:
            n.parent.chars += n.chars
            n.parent.linked += n.linked
    named = [n for n in page.nodes if n.tag in ARTICLE and n.chars and not n.dropped]
    plain = [n for n in named if not inside[n]]
    top, most = None, 0.0
    for n in page.nodes:
        if n.score > 0 and n.block and not (plain and inside[n]):
            score = (n.score + (25 if n.tag in ARTICLE else 0)) * (1 - n.linked / max(1, n.chars))
            if score > most:
                top, most = n, score
    return top or next(iter(plain or named), page.nodes[0])


def extract(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = Page(html)
    top = best(page)
    least = max(10.0, top.score / 5)
    top.kept = True
    # text of the best container that no noise inside it has: noise goes only if enough is left
    noisy, beside = {None: False, top: False}, 0
    for n in page.nodes:
        noisy.setdefault(n, noisy[n.parent] or n.noise > 0 and n is not top)
    below = {top}
    for n in page.nodes:
        if n.parent in below:
            below.add(n)
    for node, text, _ in page.blocks:
        beside += len(text) if node in below and not noisy[node] else 0
    for n in page.nodes:
        if n is top or n.parent is None or n.dropped:
            pass
        elif n.noise == 2 or n.noise and (n.parent not in below or beside >= (1 if top.tag in ARTICLE else BESIDE_NOISE * n.chars)):
            pass
        elif n.parent.kept:
            n.kept = True
        elif n.parent is top.parent and n.chars and n.linked < n.chars / 4:
            n.kept = n.score >= least or n.tag in HEADINGS or n.tag in PARAGRAPHS and n.chars > 80
    return "\n\n".join(text for node, text, _ in page.blocks if node.kept)


def _extract(keys, texts):
    got = [extract(t.decode("utf-8", "replace") if t else None) for t in texts]
    return [*keys, got, [len(g) for g in got]]


def main_texts(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars of each page."""
    ship(pages.sparkSession)
    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]
    out = map_texts(pages, [key, url], html, _extract, f"k {kinds[0]}, u {kinds[1]}, text string, n_chars long")
    return out.select(F.col("k").alias(key), F.col("u").alias(url), "text", "n_chars")


def contract(pages: DataFrame) -> DataFrame:
    return main_texts(pages)
