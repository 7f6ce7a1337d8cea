"""Reading of pages: against the plain patterns, and in time that grows with the page; the posterior against plain loops."""

import html
import random
import re
import time

import pytest

from tidepanel.llm import langid

HIDDEN = re.compile(r"<(script|style|template|noscript)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
DECLARED = re.compile(r"""<html\b[^>]*?\b(?:xml:)?lang\s*=\s*["']?\s*([A-Za-z]{2,3})\b|<meta\b[^>]*?content-language["'][^>]*?content\s*=\s*["']?\s*([A-Za-z]{2,3})\b""", re.I)
PARTS = [
    "<script>", "</script>", "<SCRIPT x", "</Script >", "<style", "</style>", "<!--", "-->", "<p>", "a < b", ">", "text", "&amp;", "<", "<html lang='de'>", "<html>",
    "<meta http-equiv=\"content-language\" content=\"fr\">", "<meta content='x'>", "<html xml:lang = en ", "\n", "<template>", "</template>",
]


def test_pages_are_read_like_by_plain_patterns():
    rng = random.Random(2)
    for _ in range(5000):
        page = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))
        plain = html.unescape(re.sub(r"<[^>]*>", " ", HIDDEN.sub(" ", page)))
        assert langid.visible_text(page).split() == plain.split(), page
        m = DECLARED.search(page)
        assert langid.declared_language(page) == ((m.group(1) or m.group(2)).lower() if m else None), page


@pytest.mark.parametrize("unit", ["<script ", "<", "<!--", "<html ", "<meta content-language\" ", "<style></sty", "<script></script", "<template><!--"])
def test_odd_pages_take_linear_time(unit):
    page = unit * (600_000 // len(unit))
    began = time.perf_counter()
    langid.visible_text(page), langid.declared_language(page), langid.visible_text(page + ">"), langid.declared_language(page + ">")
    assert time.perf_counter() - began < 5


def test_domains():
    assert langid.address_parts("http://de.news.example.co.uk/fr/x")[1:] == ("example.co.uk", "uk", ["de", "news", "fr"])
    assert langid.address_parts("https://www.example.com/de-at/")[1:] == ("example.com", "com", ["www", "de"])
