"""A one-pass scanner of HTML tags whose time is linear in the page, broken quotes and unclosed tags included."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Elements whose content is no markup, elements without content.
RAW = "script|style|noscript|template|svg|iframe|object|textarea|select|math|canvas|audio|video|title"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW_OPEN = re.compile(rf"<({RAW})\b", re.I)
_RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW.split("|")}
_SPECIAL, _NAME_END = re.compile(r"[>\"']"), re.compile(r"[\s/>]")


class _Next:
    """The next place of a pattern from a position on, remembered, so that repeated questions about one stretch are one scan."""

    def __init__(self, pattern: re.Pattern, text: str):
        self.pattern, self.text, self.low, self.at = pattern, text, 0, -1

    def __call__(self, i: int) -> int:
        """Its place, or the length of the text."""
        if not self.low <= i <= self.at:
            m = self.pattern.search(self.text, i)
            self.low, self.at = i, m.start() if m else len(self.text)
        return self.at


class _Ends:
    """Where a tag ends: the first > outside quotes; a quote without its partner ends nothing."""

    def __init__(self, text: str):
        self.text, self.special, self.known = text, _Next(_SPECIAL, text), {}

    def __call__(self, i: int) -> int:
        """The place behind the > of a tag whose attributes begin at i, or -1."""
        path, n = [], len(self.text)
        while True:
            s = self.special(i)
            if s in self.known:
                end = self.known[s]
                break
            path.append(s)
            if s == n:
                end = -1
                break
            if self.text[s] == ">":
                end = s + 1
                break
            close = self.text.find(self.text[s], s + 1)
            if close < 0:
                end = -1
                break
            i = close + 1
        for s in path:
            self.known[s] = end
        return end


def tokens(html: str) -> Iterator[tuple[int, int, str | None, bool, str, str]]:
    """(start, end, name, closing, attributes, content) of each tag. name is None for comments and declarations; an element
    of RAW is one token with its content. What is no tag is text between tokens."""
    ends, name_end = _Ends(html), _Next(_NAME_END, html)
    at, n, bare = html.find("<"), len(html), False
    while at >= 0:
        c = html[at + 1 : at + 2]
        end, out = -1, None
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = n if end < 0 else end + 3
            out = (at, end, None, False, "", "")
        elif c and c in "!?":
            end = -1 if bare else html.find(">", at + 2) + 1 or -1
            bare = bare or end < 0
            out = (at, end, None, False, "", "")
        elif (raw := _RAW_OPEN.match(html, at)) and (opened := ends(raw.end())) > 0:
            name = raw[1].lower()
            close = _RAW_END[name].search(html, opened)
            end = close.end() if close else n
            out = (at, end, name, False, html[raw.end() : opened - 1], html[opened : close.start() if close else n])
        elif c:
            first = at + 1 + (c == "/")
            if html[first : first + 1].isascii() and html[first : first + 1].isalpha():
                named = name_end(first)
                end = ends(named)
                if end > 0:
                    out = (at, end, html[first:named].lower(), c == "/", html[named : end - 1], "")
        if end > 0:
            yield out
        at = html.find("<", end if end > 0 else at + 1)


_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")


def attributes(text: str) -> dict[str, str]:
    """Names in lower case with their values, the first of equal names."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), a or b or c)
    return out
