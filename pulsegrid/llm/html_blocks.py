"""Blocks of text of a web page, with what its markup says of each.

The page is read once by a tolerant tokenizer: unclosed and stray tags, stray quotes and cut references do no harm. Text
of block elements makes blocks; white space within one becomes one space, and so does a line break. Character references
are decoded as HTML5 has it. Scripts, styles, comments and the head give no text.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

#: What the markup says: in the article, to be decided by what the host repeats, or no part of the article.
ARTICLE, OPEN, JUNK = 2, 1, 0

# Names of HTML elements, roles, and words of class names and ids.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
_JUNK_NAMES = frozenset("aside audio button canvas datalist dialog footer form head iframe math menu nav noscript object select svg template video".split())
_JUNK_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_JUNK_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion disqus "
    "footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion "
    "recommended related replies respond search share sharebar sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
_HEAD_WORDS = frozenset(["header"])
_NEGATED = frozenset("has no with without".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element that begins closes an open one of these, up to the nearest of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_P_STAYS = frozenset("html body td th caption button object".split())

_TAG = re.compile(
    r"<!--(?:-?>|.*?--!?>|.*)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?|</[^>]*+>?",
    re.S,
)
_RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in _RAW}
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CAMEL = re.compile("(?<=[a-z0-9])(?=[A-Z])")
_WORD = re.compile("[a-z0-9]+")


class Block(NamedTuple):
    text: str
    verdict: int


class _Element(NamedTuple):
    name: str
    junk: bool
    head: bool
    container: int


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(rest)}


def _class_words(attributes: dict[str, str]) -> set[str]:
    out: set[str] = set()
    for key in ("class", "id"):
        for name in attributes.get(key, "").split():
            words = _WORD.findall(_CAMEL.sub("-", name).lower())
            out.update(w for w, before in zip(words, ["", *words], strict=False) if before not in _NEGATED)
    return out


def _element(name: str, rest: str) -> _Element:
    """What an element's name and attributes say: no part of the article, a header, or what holds the article (2) or the
    main part of the page (1)."""
    junk, head, container = name in _JUNK_NAMES, name == "header", 2 if name == "article" else int(name == "main")
    if rest and not rest.isspace():
        a = _attributes(rest)
        role = a.get("role", "").lower()
        junk |= role in _JUNK_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(a.get("style", "")))
        if role == "article" or "articleBody" in a.get("itemprop", ""):
            container = 2
        elif role == "main":
            container = max(container, 1)
        if name not in ("html", "body", "main") and ("class" in a or "id" in a):
            words = _class_words(a)
            junk |= not words.isdisjoint(_JUNK_WORDS)
            head |= not words.isdisjoint(_HEAD_WORDS)
    return _Element(name, junk, head, container)


class _Page:
    def __init__(self) -> None:
        self.stack: list[_Element] = []
        self.open: dict[str, int] = {}
        self.junk = self.heads = self.headings = 0
        #: What holds the article: whether it stands in junk, its rank, and the counts of junk and headers at its begin.
        self.holders: list[tuple[bool, int, int, int]] = []
        self.parts: list[str] = []
        self.found: list[tuple[str, list[tuple[bool, int, bool]], bool]] = []
        self.title = ""

    def flush(self) -> None:
        text = " ".join("".join(self.parts).replace("\0", "�").split())
        self.parts.clear()
        if text:
            inside = [(in_junk, rank, self.junk == junk and (self.heads == heads or self.headings > 0)) for in_junk, rank, junk, heads in self.holders]
            self.found.append((text, inside, not self.junk and not self.heads))

    def begin(self, element: _Element) -> None:
        nested = bool(element.container) and any(h[1] >= element.container for h in self.holders)
        if nested and element.name == "article":  # an article within an article is a comment on it or a teaser of another
            element = element._replace(junk=True)
        self.stack.append(element)
        self.open[element.name] = self.open.get(element.name, 0) + 1
        if element.container and not nested:
            self.holders.append((self.junk > 0 or element.junk, element.container, self.junk + element.junk, self.heads + element.head))
        else:
            self.stack[-1] = element = element._replace(container=0)
        self.junk += element.junk
        self.heads += element.head
        self.headings += element.name in _HEADINGS

    def pop(self) -> None:
        element = self.stack.pop()
        self.open[element.name] -= 1
        if element.name in _BLOCK:
            self.flush()
        self.junk -= element.junk
        self.heads -= element.head
        self.headings -= element.name in _HEADINGS
        if element.container:
            self.holders.pop()

    def end(self, names: set[str] | frozenset[str], stops: set[str] | frozenset[str] = frozenset()) -> None:
        """Closes the innermost open element of these names, if none of `stops` is nearer."""
        if not any(self.open.get(n) for n in names):
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].name in names:
                while len(self.stack) > at:
                    self.pop()
                return
            if self.stack[at].name in stops:
                return

    def start(self, name: str, rest: str) -> None:
        if name in _BLOCK:
            self.flush()
            self.end({"p"}, _P_STAYS)
            if name in _CLOSES:
                self.end(*_CLOSES[name])
        elif name == "br":
            self.parts.append("\n")
        if name == "body":
            self.end({"head"})
        if name not in _VOID and not rest.endswith("/"):
            self.begin(_element(name, rest))


def blocks(html: str) -> tuple[str, list[Block]]:
    """The page's title (or first heading) and its blocks in order."""
    page, at = _Page(), 0
    first_heading = ""
    while True:
        m = _TAG.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            page.parts.append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m[0].startswith("<![CDATA["):
            page.parts.append(m[0][9:].removesuffix("]]>"))
            continue
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name == "br":
                page.parts.append("\n")
            elif name in _BLOCK:
                before = len(page.found)
                page.flush()
                if name == "h1" and not first_heading and len(page.found) > before:
                    first_heading = page.found[-1][0]
            page.end({name})
        elif name in _RAW:
            end = _RAW_END[name].search(html, at)
            stop = end.start() if end else len(html)
            if name == "title" and not page.title:
                page.title = " ".join(unescape(html[at:stop]).split())
            at = stop
        else:
            page.start(name, (m[3] if m[2] else m[6]) or "")
    page.flush()
    # a holder within junk, as comments have, counts only if there is no other
    holders = {(in_junk, rank) for _, inside, _ in page.found for in_junk, rank, _ in inside}
    best = min(holders, key=lambda h: (h[0], -h[1]), default=None)
    out = []
    for text, inside, plain in page.found:
        if best is None:
            verdict = OPEN if plain else JUNK
        else:
            good = any((in_junk, rank) == best and free for in_junk, rank, free in inside)
            verdict = (ARTICLE if best[1] == 2 else OPEN) if good else JUNK
        out.append(Block(text, verdict))
    return page.title or first_heading, out
