"""Product cards and article fields of stored pages."""

import html
import re
import time
import tracemalloc

import pyarrow as pa
import pytest

from marketloom.plans import catalog
from marketloom.sources import pages as PG

PAGE = """<title>Shop</title><ul class=products><li data-sku="S1"><a href="/p1">Fridge &amp; more</a><del>KSh 1,000</del><ins>KSh 900</ins></li><li>no link</li>
<li><a href='/p2'>Open item</a><span class="price">KSh 70.50</span>
<li class="product" data-brand=Acme data-category="Cooling"><a href=/p3><img alt=x></a><h2>Chest <b>freezer</b></h2><span class="price">KSh 5,000</span></ul>
<div class="product-card"><div><a href="/p4"><h3>Oven</h3></a><p class=brand>Bolt</p><p class="category">Cooking</p><span itemprop="price">30</span></div></div>
<article itemtype="https://schema.org/Product"><meta itemprop=sku content=S5><a href=/p5>Kettle</a></article><div class="production"><a href=/no>no card</a></div>
<script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "TV &quot;X&quot;", "sku": 7, "brand": {"name": "Cold"}, "offers": [{"price": "1,250.5"}], "url": "/p6", "category": "TV"}, {"@type": "Offer"}]}</script>
<script type="application/ld+json">{broken</script>"""


def test_cards_of_all_containers(spark):
    rows = PG.product_cards(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")).collect()
    got = [(r.name, r.url, r.sku, r.regular_price, r.sale_price, r.brand, r.category) for r in rows]
    assert got == [
        ("Fridge & more", "/p1", "S1", 1000.0, 900.0, None, None), ("Open item", "/p2", None, 70.5, None, None, None), ("Chest freezer", "/p3", None, 5000.0, None, "Acme", "Cooling"),
        ("Oven", "/p4", None, 30.0, None, "Bolt", "Cooking"), ("Kettle", "/p5", "S5", None, None, None, None), ('TV "X"', "/p6", "7", 1250.5, None, "Cold", "TV"),
    ]
    assert [r.position for r in rows] == list(range(6)) and {r.page_id for r in rows} == {1}


def test_list_items_of_given_pages_brute_force(spark):
    """On the given pages, whose lists are well formed, cards are the list items with a link."""
    sf = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect():
        page = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", r.html or "", flags=re.S)
        for m in re.finditer(r"<li\b[^>]*>(.*?)</li>", page, re.S):
            if a := re.search(r"<a\b[^>]*href=[\"']?([^\"'>\s]+)[^>]*>(.*?)</a>", m[1], re.S):
                want.append((r.page_id, " ".join(html.unescape(re.sub(r"<[^>]*>", "", a[2])).split()), a[1]))
    got = [(r.page_id, r.name, r.url) for r in catalog.QUERIES["s11"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and want


def test_article_fields_brute_force(spark):
    """On the given pages, against patterns over the article element."""
    sf = "/root/testdata/sf0.001"
    rows = {r.page_id: r for r in catalog.QUERIES["s12"](spark, sf).collect()}
    flat = lambda s: " ".join(html.unescape(re.sub(r"<[^>]*>", " ", s)).split())
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        page = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", " ", p.html or "", flags=re.S)
        body = re.search(r"<article\b[^>]*>(.*?)</article>", page, re.S)
        paras = [flat(x) for x in re.findall(r"<p\b[^>]*>(.*?)(?=</p>|<p\b|</article|\Z)", body[1] if body else page, re.S)]
        assert rows[p.page_id].text.split("\n") == ([x for x in paras if x] or [""])
        title = re.search(r"<h1\b[^>]*>(.*?)</h1>", page, re.S) or re.search(r"<title>(.*?)</title>", page, re.S)
        assert rows[p.page_id].title == (flat(title[1]) if title else "")


def test_article_dates_and_broken_pages():
    page = "<title>T</title><p>in 2024-05-06 <b>x</b>y</p><article><h1>Head</h1><p>one<p>two <time datetime='2024-01-02T10:00'>now</time></article><p>after</p>"
    assert PG.article_of(page) == ("Head", "one\ntwo now", "2024-01-02")
    assert PG.article_of("<title>T &amp; U</title><p>a</p> on 2024-05-06") == ("T & U", "a", "2024-05-06")
    assert PG.article_of("") == ("", "", None)


@pytest.mark.parametrize("unit", ["<li>", "<li><a href=x>", "<a '", "<ul><li>", "<p>", "<article>", "<div class=product>", "<del>", "<h1>", "</li>"])
def test_a_megabyte_of_unclosed_tags(unit):
    page = unit * (1_000_000 // len(unit))
    for f in (PG.cards_of, PG.article_of):
        began = time.process_time()
        f(page)
        assert time.process_time() - began < 8, f


def test_pages_of_a_batch_are_read_one_by_one(spark):
    """A batch has up to 10,000 pages; their texts are not Python strings all at once."""

    class Taken:
        sparkSession = spark
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    n = 600
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["http://a.example.com/x"] * n), pa.array([f"<h1>T{i}</h1><p>word" + " " * 100_000 for i in range(n)])], ["page_id", "url", "html"])
    run = PG.article_fields(Taken())
    tracemalloc.start()
    got = [r for b in run(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r["page_id"], r["title"], r["text"]) for r in got] == [(i, f"T{i}", "word") for i in range(n)]
    assert peak < 20_000_000
