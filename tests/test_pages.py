from pyspark.sql import functions as F

from tagloom.functions.html import html_elements
from tagloom.operators import pages as P

HTML = """<html><head><title> Shop </title><meta name="description" content="Nice"><meta property="og:title" content="OG">
<script type="application/ld+json">{"@type": "Product", "name": "Novo 5", "offers": {"price": "9.99"}}</script></head><body>
<nav class="Breadcrumb"><ol><li><a href="/">Home</a></li><li>&raquo;</li></ol></nav>
<h1>Heading</h1><a href="/vape-kits">Kits</a><a href="/products/smok-novo-5">Novo</a><a href="/vape-kits">again</a>
<div class="hero-banner big"><img src="/hero.jpg"></div>
<div class="product-gallery"><img data-src="../g.png" srcset="s1.png 1x, s2.png 2x"><img src="/logo.png"><img src="/hero.jpg"></div>
<img class="product-image" width="50" height="50" src="/tiny.png"><img src="/big.png"><span class="price">£1</span>
<div class="stock">Sold OUT</div><a href="/press/media-kit.zip">Media kit</a><div style="background:url('/bg.png')" data-zoom></div></body></html>"""


def frames(spark):
    pages = spark.createDataFrame([(1, "https://x.com/a/b.html", HTML)], "page_id long, url string, html string")
    return pages, html_elements(pages)


def test_metadata(spark):
    pages, elements = frames(spark)
    row = P.page_metadata(elements, pages).first()
    assert (row.title, row.description, row.og_title, row.product_name, row.price, row.in_stock) == \
        ("Shop", "Nice", "OG", "Novo 5", "9.99", False)


def test_links(spark):
    got = {r.raw: r for r in P.links(frames(spark)[1]).collect()}
    assert got["/vape-kits"].is_category and got["/vape-kits"].text == "Kits" and not got["/vape-kits"].is_product
    assert got["/products/smok-novo-5"].is_product and got["/products/smok-novo-5"].link == "https://x.com/products/smok-novo-5"
    media = P.media_links(frames(spark)[1]).filter("file_type = '.zip'").first()
    assert media.by_keyword and media.link.endswith("media-kit.zip")


def test_images(spark):
    got = [(r.image_url, r.kind, r.priority) for r in P.page_images(frames(spark)[1]).orderBy("ord", "image_url").collect()]
    assert ("https://x.com/hero.jpg", "hero", "high") in got
    assert ("https://x.com/g.png", "gallery", "high") in got and ("https://x.com/a/s2.png", "gallery", "high") in got
    assert ("https://x.com/bg.png", "zoom", "high") in got
    assert not any("logo" in url for url, _, _ in got)
    plain = {r.image_url for r in P.plain_images(frames(spark)[1]).collect()}
    assert "https://x.com/big.png" in plain and "https://x.com/tiny.png" not in plain


def test_breadcrumbs_repeat_nested_text(spark):
    rows = P.breadcrumbs(frames(spark)[1]).orderBy("ord").collect()
    assert [r.text for r in rows] == ["Home", "Home"]


def test_brands_by_list_order(spark):
    brands = spark.createDataFrame([("Geek Bar", 0), ("SMOK", 1)], "brand string, ord int")
    rows = spark.createDataFrame([(1, "/p/smok-geek-bar", ""), (2, "/p/x", "a Geek bar by smok"), (3, "/p", "none")],
                                 "row_id int, url string, text string")
    got = {r.row_id: r.brand for r in P.match_brands(rows, brands).collect()}
    assert got == {1: "Geek Bar", 2: "Geek Bar"}
    assert P.match_brands(rows, brands).filter(F.col("row_id") == 3).count() == 0


def test_other_references_stay_if_asked(spark):
    html = ("<title>a &amp; b &lt;c&gt; d&amp</title><script type='application/ld+json'>{\"@type\": \"Product\", \"description\": \"x & y\"}</script>"
            "<h1>A&ltB&ampx&#65;&quot; & C&am</h1><script>&amp")
    pages = spark.createDataFrame([(1, "https://x.com/", html)], "page_id long, url string, html string")
    row = P.page_metadata(html_elements(pages, references=["lt", "gt", "amp"]), pages).first()
    assert (row.title, row.product_name, row.description) == ("a & b <c> d&amp", "A&ltB&ampx&#65;&quot; & C&am", "x & y")
    assert P.page_metadata(html_elements(pages), pages).first().title == "a & b <c> d&"


def test_elements_are_given_on_by_a_few_megabytes(spark, monkeypatch):
    from tagloom.functions import html
    assert len(html._batch([(1, 0, "a", {"href": "x"}, "t", "x", [], ["p"])])) == 1
    sizes = []

    class Pages:  # stands in for a table, to see the batches
        def select(self, *_):
            return self

        def mapInArrow(self, parse, schema):
            import pyarrow as pa
            many = 400
            batch = pa.RecordBatch.from_pydict({"page_id": list(range(many)), "url": ["https://x.com/"] * many, "html": ["<div><p>" + "word " * 4000 + "</p></div>"] * many})
            sizes.extend((b.num_rows, b.nbytes) for b in parse([batch]))

    html.html_elements(Pages())
    assert sum(n for n, _ in sizes) == 800 and max(size for _, size in sizes) < 3 * html.HELD
