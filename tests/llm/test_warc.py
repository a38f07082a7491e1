"""The reader of pages beside one that looks at each character from each start, and on markup that is never closed."""
import html
import random
import time

import pytest
from pyspark.sql import functions as F

from tagloom.llm import warc


def closed_at(page, at):
    """Where a tag ends whose name ends at ``at``, by walking on."""
    quote = None
    for i in range(at, len(page)):
        c = page[i]
        if quote:
            quote = None if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == ">":
            return i
    return -1


def plain_tags(page):
    out, i = [], 0
    while i < len(page):
        name, j = "", i + 1
        if page[i] == "<" and j < len(page):
            if page[j] in "!?":
                end, inner = page.find(">", j + 1), ""
            else:
                j += page[j] == "/"
                k = j
                while k < len(page) and page[k].isascii() and page[k].isalnum() and (k > j or page[k].isalpha()):
                    k += 1
                end = closed_at(page, k) if k > j else -1
                name, inner = page[i + 1:k].lower(), page[k:end]
            if end >= 0:
                out.append((i, end + 1, name, inner))
                i = end
        i += 1
    return out


def test_tags_are_those_of_a_plain_walk():
    rng = random.Random(5)
    bits = ["<", ">", "<a", "</a", "<!", "<?", "'", '"', "=", " ", "x", "1", "/", "é", "<b c='>'>", '<i j="k">']
    for _ in range(20_000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 16)))
        assert list(warc.tags(page)) == plain_tags(page), page


@pytest.mark.parametrize("unit", ["<a ", "<a '", '<a "', "<!", "<?", "</a", "'", "<a b=", "<", "&#1", "<!--", "<script", "</script ", "<a href='x' "])
def test_a_megabyte_of_unclosed_markup(unit):
    for end in ("", ">", "'>"):
        page = unit * (1_000_000 // len(unit)) + end
        start = time.perf_counter()
        warc.parsed(page, "http://a.example/")
        assert time.perf_counter() - start < 8  # tens of milliseconds to two seconds on an idle core; a second look at the rest takes hours


def test_long_names_values_and_numbers():
    start = time.perf_counter()
    text, _, links, metas = warc.parsed(f"<meta {'a' * 500_000}><meta {'b ' * 200_000}><a href{' ' * 300_000}=y c>t</a>&#{'9' * 10_000};&#{'0' * 9_000}65;&#x{'f' * 9_000};", "http://a.example/")
    assert time.perf_counter() - start < 8
    assert links == [{"path": "a@/href", "url": "http://a.example/y", "text": "t"}] and not metas
    assert text == "t�A�"
    for t in ("&amp;&#0;&#65;&#x41;&#x110000;&#1114112;&lt", "&#", "&#x;", "&#00", "&#xd800;"):
        assert warc.unescaped(t) == html.unescape(t)


def test_pages_of_broken_markup_give_two_records_each(spark):
    pages = spark.createDataFrame([(1, "u", "<a '" * 50_000), (2, None, "<p>x<b title='>'>y"), (2, None, "<p>x<b title='>'>y"), (None, "u", None), (4, "u", "")], "page_id long, url string, html string")
    got = warc.derive(warc.responses(pages.withColumn("block", F.lit("clash"))))
    assert got.count() == 10
    assert {r.block for r in got.filter("page_id = 2 and record_type = 'conversion'").collect()} == {"xy"}
