"""Reading elements out of one HTML page (a helper of the page columns).

``elements`` lists the elements of a page in the order of their opening tags.
Nested tags of the same name, any quoting and letter case, unclosed elements
and all character references are handled by ``html.parser``; ``&nbsp;`` is
U+00A0, and ``text`` strips it like other Unicode space.  Plain markup, which
``html.parser`` reads in one way only, is cut by one expression instead, with
the same elements; a page with anything else goes through the parser whole.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

# Elements that end when a like one opens, up to the element that holds them.
IMPLIED_END = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
               "tr": ({"tr"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
               "option": ({"option"}, {"select"})}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

# Plain markup.  No part can match in two ways, so nothing is tried twice.
_ATTR = r"""[ \t\n\r\f]++([a-z][a-z0-9_:.-]*+)(=(?:"[^"]*+"|'[^']*+'|[a-z0-9_:.#%?/-][a-z0-9_:.#%?/=&;,-]*+))?+"""
_ATTRS = "((?:" + _ATTR.replace("([", "(?:[").replace("(=", "(?:=") + ")*+)[ \\t\\n\\r\\f]*+"
PLAIN_ATTR = re.compile(_ATTR, re.I | re.A)
PLAIN = re.compile(
    r"([^<]++)"                                                       # 1 text
    r"|</([a-z][a-z0-9]*+)[ \t\n\r\f]*+>"                             # 2 end tag
    r"|<(?!(?:script|style)[^a-z0-9])([a-z][a-z0-9]*+)" + _ATTRS +    # 3, 4 start tag
    r"(/?+)>"                                                         # 5 closed at once
    r"|<!--(?!-?>)(?:[^-]|-(?!-))*+-->|<!doctype[^>]*+>"
    r"|<(script|style)" + _ATTRS +                                    # 6, 7, 8 text as it stands
    r">((?:[^<]|<(?!!--|/[ \t\n\r\f\v]*+(?:script|style)))*+)</\6>"
    r"|(<)", re.I | re.A)                                             # 9 anything else


class Element:
    __slots__ = ("tag", "attrs", "words", "inner", "first", "last")

    def __init__(self, tag: str, attrs: dict, words: list[str], first: int):
        self.tag, self.attrs, self.words, self.first, self.last = tag, attrs, words, first, None
        self.inner = None

    def is_a(self, tag: str, cls: str | None = None) -> bool:
        """Same tag and, where asked, ``cls`` as one of the element's classes
        or as its whole class attribute."""
        if self.tag != tag.lower():
            return False
        own = (self.attrs.get("class") or "").split()
        return cls is None or cls in own or cls.split() == own

    def text(self) -> str:
        return "".join(self.words[self.first:self.last]).strip()


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[Element] = []
        self.words: list[str] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        ends, holders = IMPLIED_END.get(tag, ((), ()))
        for depth in range(len(self.open) - 1, -1, -1) if ends else ():
            name = self.found[self.open[depth]].tag
            if name in ends:
                self.shut(depth)
            if name in ends or name in holders:
                break
        self.found.append(Element(tag, dict(reversed(attrs)) if attrs else {}, self.words, len(self.words)))
        self.open.append(len(self.found) - 1)
        if tag in VOID:
            self.shut(len(self.open) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.found[self.open[depth]].tag == tag:
                self.shut(depth)
                return

    def handle_data(self, data):
        self.words.append(data)

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a malformed declaration or marked section: read on behind it
            end = self.rawdata.find(">", i)
            return end + 1 if end >= 0 else len(self.rawdata)

    def read_plain(self, html: str) -> bool:
        """Reads a page of plain markup; False at the first thing that isn't."""
        for token in PLAIN.finditer(html):
            kind = token.lastindex
            if kind == 1:
                self.handle_data(unescape(token[1]))
            elif kind == 2:
                self.handle_endtag(token[2].lower())
            elif kind == 5:
                tag = token[3].lower()
                self.handle_starttag(tag, plain_attrs(token[4]))
                if token[5]:
                    self.handle_endtag(tag)
            elif kind == 8:
                tag = token[6].lower()
                self.handle_starttag(tag, plain_attrs(token[7]))
                if token[8]:
                    self.handle_data(token[8])
                self.handle_endtag(tag)
            elif kind == 9:
                return False
        return True

    def shut(self, depth: int) -> None:
        for i in self.open[depth:]:
            self.found[i].last, self.found[i].inner = len(self.words), (i + 1, len(self.found))
        del self.open[depth:]


@lru_cache(maxsize=10_000)
def plain_attrs(text: str) -> tuple[tuple[str, str | None], ...]:
    """The attributes of a plain start tag, as ``html.parser`` reports them."""
    out = []
    for name, value in PLAIN_ATTR.findall(text):
        value = value[1:] if value else None
        if value and value[0] in "\"'":
            value = value[1:-1]
        out.append((name.lower(), unescape(value) if value else value))
    return tuple(out)


def parsed(html: str) -> list[Element]:
    """All elements of a page, by ``html.parser``."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.shut(0)
    return reader.found


def elements(html: str | None) -> list[Element]:
    """All elements of a page; malformed declarations are skipped."""
    reader = _Reader()
    if not reader.read_plain(html or ""):
        return parsed(html)
    reader.shut(0)
    return reader.found


def select(found: list[Element], tag: str, cls: str | None = None, within: Element | None = None) -> list[Element]:
    lo, hi = within.inner if within is not None else (0, len(found))
    tag = tag.lower()
    return [e for e in found[lo:hi] if e.tag == tag and e.is_a(tag, cls)]
