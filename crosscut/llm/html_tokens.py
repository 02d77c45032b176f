"""A tolerant walk over HTML: elements with their paths, and text with the elements around it."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import xxhash

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|([^<]+)|(<)", re.S)
ATTRS = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z0-9]+")
NAMED = re.compile(r"class|role|id", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Formulas run on within their block.
MATH = frozenset("math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mstyle mpadded mphantom mfenced menclose mover munder munderover mmultiscripts mtable mtr mtd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold no main text.
SIDE_TAGS = frozenset("nav header footer aside form script style noscript template iframe svg button select option textarea head title dialog object canvas annotation".split())
#: Containers and paragraphs may be named as what they hold: a class, role or id all of whose words are among these marks them. It is
#: the last evidence, for what is laid out like main text; a template can overrule it. Words of QUALIFIERS may stand beside
#: those of SIDE_NAMES, but for a header, which an article may have unless it is the site's.
CONTAINERS = frozenset("div section ul ol dl table details center fieldset figure".split())
SIDE_NAMES = frozenset("ad ads advert adverts advertisement banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header cookie cookies consent notice notices alert alerts promo sponsor sponsored related share social newsletter subscribe popup modal login search widget complementary contentinfo".split())
READERS = frozenset("comment comments disqus reply replies responses discussion".split())
QUALIFIERS = frozenset("site page post user reader readers list section wrap wrapper container box block area top bottom left right bar".split())
#: An open element of these ends where one of the same begins.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
#: What bounds that search.
SCOPES = frozenset("ul ol dl table tbody thead div section article main body html".split())


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRS.findall(source):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def walk(source: str) -> Iterator[tuple]:
    """("open", tag, attribute source), ("close", tag), ("raw", tag, content) or ("text", text) in page order. Comments are left out."""
    at, n = 0, len(source)
    while at < n:
        m = TOKEN.match(source, at)
        if m is None:  # a tag that never ends
            yield "text", source[at:]
            return
        at = m.end()
        closing, tag, attrs, text, lone = m.groups()
        if text is not None or lone is not None:
            yield "text", text or lone
        elif tag is not None:
            tag = tag.lower()
            if closing:
                yield "close", tag
                continue
            yield "open", tag, attrs
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                yield "raw", tag, source[at : end.start() if end else n]
                yield "close", tag
                at = end.end() if end else n


def side_name(name: str) -> bool:
    """Whether all words of a name say that its element holds no main text."""
    words = set(WORDS.findall(name))
    told = words & (SIDE_NAMES | READERS)
    return bool(told) and (words == told or (words <= told | QUALIFIERS and ("header" not in told or "site" in words)))


class Stack:
    """The open elements of a page. Each has its tag and a path: a hash of its parent's path, its tag and its classes.

    Whether an element is a side element counts for all within it, so that is carried along; so nothing is
    searched through the depth of a page but for a tag that is open.
    """

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.paths: list[int] = [0]
        #: By its tag, or that of an element around it.
        self.side: list[bool] = [False]
        #: By its name, and whether that is a name for readers' comments.
        self.marked: list[bool] = []
        self.readers: list[bool] = []
        self._open: Counter = Counter()

    def open(self, tag: str, attrs: str) -> list[int]:
        """Puts the element on the stack; gives the paths of what that ended, the innermost first."""
        ended: list[int] = []
        if tag in SELF_CLOSING and self._open[tag]:
            for k in range(len(self.tags) - 1, -1, -1):
                if self.tags[k] == tag:
                    ended = self._drop(k)
                    break
                if self.tags[k] in SCOPES:
                    break
        name, marked, readers = tag, False, False
        if attrs and NAMED.search(attrs):
            a = attributes(attrs)
            classes = sorted(set(a.get("class", "").lower().split()))
            if classes:
                name = f"{tag}.{'.'.join(classes)}"
            if tag in CONTAINERS or tag == "p":  # a paragraph's id may be made from its words
                told = [n for n in (*classes, a.get("role", "").lower(), a.get("id", "").lower() if tag != "p" else "") if n and side_name(n)]
                marked, readers = bool(told), any(READERS.intersection(WORDS.findall(n)) for n in told)
        self.tags.append(tag)
        self.paths.append(xxhash.xxh64_intdigest(name, seed=self.paths[-1]))
        self.side.append(self.side[-1] or tag in SIDE_TAGS)
        self.marked.append(marked)
        self.readers.append(readers)
        self._open[tag] += 1
        return ended

    def close(self, tag: str) -> list[int]:
        """Ends the innermost open element of that tag with all in it; nothing if none is open."""
        if self._open[tag]:
            for k in range(len(self.tags) - 1, -1, -1):
                if self.tags[k] == tag:
                    return self._drop(k)
        return []

    def _drop(self, k: int) -> list[int]:
        ended = self.paths[:k:-1]
        for tag in self.tags[k:]:
            self._open[tag] -= 1
        del self.tags[k:], self.paths[k + 1 :], self.side[k + 1 :], self.marked[k:], self.readers[k:]
        return ended


def clean(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def plain_text(source: str) -> str:
    """All text of a page but that of head, scripts and styles: blocks, each on a line."""
    blocks: list[str] = []
    parts: list[str] = []
    for kind, *x in walk(source):
        if kind == "text":
            parts.append(html.unescape(x[0]))
        elif kind == "raw":
            if x[0] == "textarea":
                parts.append(html.unescape(x[1]))
        elif x[0] == "br" or x[0] not in INLINE:
            blocks.append(clean(parts))
            parts = []
    blocks.append(clean(parts))
    return "\n".join(b for b in blocks if b)
