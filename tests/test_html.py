"""The tag scanner against plain patterns, and its time on broken pages."""

import random
import re
import time

import pytest

from marketloom.functions import html as H

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<raw>" + H.RAW + r")\b(?P<ra>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>(?P<in>.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<a>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)


def plain(page):
    out = []
    for m in TAG.finditer(page):
        name = (m["raw"] or m["name"] or "").lower() or None
        out.append((m.start(), m.end(), name, m["close"] == "/", m["ra"] or m["a"] or "", m["in"] or ""))
    return out


def test_tokens_brute_force():
    r = random.Random(2)
    parts = ["<", ">", "a", "/", " ", "'", '"', "<p>", "</p>", "<!--", "-->", "<!x>", "<title>", "</title >", "<script", "</script>", "=", "<a href='x>y'>", "b c", "<?", "\n", "<li"]
    for _ in range(20_000):
        page = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert list(H.tokens(page)) == plain(page), page


def test_attributes():
    assert H.attributes(""" Class="a b" id='x' data-sku=9 hidden href = "u?v=1" class=z""") == {"class": "a b", "id": "x", "data-sku": "9", "hidden": "", "href": "u?v=1"}


@pytest.mark.parametrize("unit", ["<a '", '<a "', "<li>", "<a", "<", "<!", "<!--", "<script", "<script>", "</a", "<a'\"", "<p x=\"'\" y='", "<a b=\"c'>", "<li><a href=x>"])
def test_time_is_linear(unit):
    began = time.time()
    n = sum(1 for _ in H.tokens(unit * (1_000_000 // len(unit))))
    assert time.time() - began < 3 and n >= 0
