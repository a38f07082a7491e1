"""One parse of a page into rows of elements; everything else is column logic.

The parse is a small stdlib helper inside ``mapInArrow``: one page at a time, its
elements given on by a few megabytes, however many pages a batch has.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Attributes that may hold an image URL, in reading order.
IMAGE_ATTRIBUTES = ["src", "data-src", "data-lazy", "data-lazy-src", "data-original", "data-zoom-image",
                    "data-large-image", "data-full-image", "data-srcset", "srcset"]
TEXT_TAGS = {"title", "h1", "a", "li", "span", "nav", "ol", "ul", "div", "script"}

ELEMENTS = """page_id long, ord int, tag string, attrs map<string,string>, text string, href string,
              image_urls array<string>, within array<string>"""
ARROW = pa.schema([("page_id", pa.int64()), ("ord", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
                   ("text", pa.string()), ("href", pa.string()), ("image_urls", pa.list_(pa.string())), ("within", pa.list_(pa.string()))])
HELD = 4 << 20  # about so many characters of elements are held before they are given on


def _image_urls(attrs: dict[str, str], base: str) -> list[str]:
    found = []
    for name in IMAGE_ATTRIBUTES:
        value = attrs.get(name)
        if not value:
            continue
        if name.endswith("srcset"):
            found += [part.split()[0] for part in value.split(",") if part.strip()]
        else:
            found.append(value)
    style = re.search(r"url\(['\"]?([^'\"]+)['\"]?\)", attrs.get("style") or "")
    if style:
        found.append(style.group(1))
    return [_joined(base, url) for url in found]


def _joined(base: str, url: str) -> str:
    try:
        return urljoin(base, url)
    except ValueError:
        return url


class _Elements(HTMLParser):
    """Elements in document order with their text and what encloses them.

    ``within`` lists an enclosing element's tag, ``.class``, ``tag.class`` and ``[attr]`` marks
    (and ``[attr=value]`` for roles), so CSS ancestors are array lookups.
    """

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.rows, self.open = base, [], []

    def handle_starttag(self, tag, attrs):
        values = {k: (v or "") for k, v in attrs}
        row = {"tag": tag, "attrs": values, "parts": [], "within": [m for _, marks, _ in self.open for m in marks]}
        self.rows.append(row)
        if tag not in VOID:
            classes = values.get("class", "").split()
            marks = [tag] + ["." + c for c in classes] + [f"{tag}.{c}" for c in classes]
            marks += [f"[{k}]" for k in values if k.startswith("data-")]
            marks += [f"[{k}={v}]" for k, v in values.items() if k == "data-role"]
            self.open.append((tag, marks, row))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        for tag, _, row in self.open:
            if tag in TEXT_TAGS:
                row["parts"].append(data)


def _only(references: list[str]) -> re.Pattern:
    """Scripts and styles, which hold no references and run to the end of the page if not closed, or an '&' that
    starts none of these references."""
    return re.compile(rf"(<((?i:script|style))\b.*?(?:</(?i:\2)\s*>|\Z))|&(?!(?:{'|'.join(references)});)", re.S)


def _parse(page_id: int, url: str, html: str, others: re.Pattern | None) -> Iterator[tuple]:
    parser = _Elements(url or "")
    parser.feed(others.sub(lambda m: m.group(1) or "&amp;", html or "") if others else html or "")
    parser.close()
    for i, row in enumerate(parser.rows):
        attrs = row["attrs"]
        href = _joined(url or "", attrs["href"]) if "href" in attrs else None
        text = "".join(row["parts"]) if row["tag"] in TEXT_TAGS else None
        yield page_id, i, row["tag"], attrs, text, href, _image_urls(attrs, url or ""), row["within"]


def html_elements(pages: DataFrame, references: list[str] | None = None) -> DataFrame:
    """Elements of each page (``page_id``, ``url``, ``html``) with attributes, text,
    resolved link and image URLs, and enclosing marks.

    All character references are read as browsers do, some without their semicolon as well, ``&amp`` as ``&``.  If
    ``references`` names some, these and ``amp`` alone are read, with their semicolon; others stay as they are written."""
    others = None if references is None else _only([*references, "amp"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for page in zip(*batch.columns):
                for row in _parse(*[value.as_py() for value in page], others):
                    rows.append(row)
                    held += 200 + len(row[4] or "") + sum(map(len, row[7]))
                    if held > HELD:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(parse, ELEMENTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    columns[3] = [list(attrs.items()) for attrs in columns[3]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types)], schema=ARROW)
