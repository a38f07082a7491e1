"""Derived records of web captures: for each response a metadata record (JSON) and a plain-text conversion.

Each derived record names the response it came from (``WARC-Refers-To``), keeps its target, date, HTTP
headers and payload digest, and has a digest of its own block.  Record ids follow from the content, so a
task that runs again makes the same records.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_OPENING, _MARK = re.compile(r"<(?:(/?[a-zA-Z][a-zA-Z0-9]*+)|[!?])"), re.compile("[>\"']")
#: A name and, if it has one, its value; a name is taken whole, so one without a value is looked at once.
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.\-]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
_NUMBERED = re.compile(r"&#0*(?=[0-9])|&#[xX]0*(?=[0-9a-fA-F])")
_TOO_LARGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
#: Elements that begin a new line of text.
BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "h1", "h2", "h3",
          "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "title", "tr", "ul"}
RESPONSES = "page_id {id}, record_id string, target_uri string, warc_date string, http_headers string, payload binary"
DERIVED = ("page_id {id}, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
           "content_length long, block_digest string, source_digest string, block string")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join('' if p is None else str(p) for p in parts))}>"


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of pages that were stored without their transport; a null page is an empty payload, a
    null URL an empty target.  Repeated rows have equal record ids."""
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    url = F.coalesce(F.col(url_col), F.lit(""))
    seed = F.sha2(F.concat_ws("\x1f", F.lit("response"), F.col(id_col).cast("string"), url, F.sha2(body, 256)), 256)
    part = lambda a, n: F.substring(seed, a, n)
    name = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("8"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12)), F.lit(">"))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col(id_col).alias("page_id"), name.alias("record_id"), url.alias("target_uri"), F.lit(date).alias("warc_date"),
                        headers.alias("http_headers"), body.alias("payload"))


def _closings(page: str) -> tuple[list[int], list[int]]:
    """Places of ``>`` and quotes, and for each of them, met outside of quotes, where the tag around it would end (-1: nowhere).

    Made once from the end of the page, so unclosed tags and quotes cost no second look at what follows them.
    """
    marks = [m.start() for m in _MARK.finditer(page)]
    ends, after = [-1] * (len(marks) + 1), {'"': -1, "'": -1}  # after: the next quote of each kind
    for k in range(len(marks) - 1, -1, -1):
        mark = page[marks[k]]
        if mark == ">":
            ends[k] = marks[k]
        else:
            ends[k] = ends[after[mark] + 1] if after[mark] >= 0 else -1
            after[mark] = k
    return marks, ends


def tags(page: str) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, name (lower case, ``/`` before that of an end tag, empty for declarations) and attributes of each tag.

    A ``>`` inside quotes does not end a tag; what is never closed is text.  Time grows with the length of the page alone.
    """
    marks, ends = _closings(page)
    at = 0
    for found in _OPENING.finditer(page):
        if found.start() < at:
            continue
        if found[1]:
            end = ends[bisect_left(marks, found.end())]
        elif (end := page.find(">", found.end())) < 0:
            return  # and none further on
        if end >= 0:
            at = end + 1
            yield found.start(), at, (found[1] or "").lower(), page[found.end():end] if found[1] else ""


def unescaped(text: str) -> str:
    """Character references resolved; numbers beyond all characters, of any length, give U+FFFD."""
    if "&#" in text:
        text = _TOO_LARGE.sub("\ufffd", _NUMBERED.sub(lambda m: m[0].rstrip("0"), text))
    return html.unescape(text)


def parsed(page: str, base: str) -> tuple[str, str, list, list]:
    """Text, title, links and meta entries of a page; broken markup never fails."""
    out, links, metas, title, at, in_title, anchor = [], [], [], [], 0, False, None
    page = _SKIP.sub(" ", page)
    for start, end, name, inner in tags(page):
        words, at = page[at:start], end
        if words:
            (title if in_title else out).append(words)
            if anchor is not None:
                anchor.append(words)
        if name.lstrip("/") in BLOCKS:
            out.append("\n")
        if name in ("title", "/title"):
            in_title = name == "title"
        elif name in ("a", "img", "link", "meta"):
            have = {m[1].lower(): unescaped(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(inner) if m.end() > m.end(1)}
            where = have.get("href") if name != "img" else have.get("src")
            if where:
                links.append({"path": f"{name}@/{'src' if name == 'img' else 'href'}", "url": _joined(base, where)})
                if name == "a":
                    anchor = links[-1]["text"] = []
            if name == "meta" and have:
                metas.append(have)
        elif name == "/a":
            anchor = None
    (title if in_title else out).append(page[at:])
    tidy = lambda parts: " ".join(unescaped("".join(parts)).split())
    for link in links:
        if "text" in link:
            link["text"] = tidy(link["text"])
    lines = (" ".join(line.split()) for line in unescaped("".join(out)).split("\n"))
    return "\n".join(line for line in lines if line), tidy(title), links, metas


def _joined(base: str, where: str) -> str:
    try:
        return urljoin(base, where)
    except ValueError:
        return where


def derive(records: DataFrame) -> DataFrame:
    """Two rows (``metadata``, ``conversion``) for each response record; see ``DERIVED`` for the columns.

    The conversion has the text of the page, one line per block; an empty page gives an empty one.  Bytes that
    are no UTF-8 become replacement characters.  Columns beside those of ``RESPONSES`` are not read.
    """
    kind = records.schema["page_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows = []
                for r in part.select(["record_id", "target_uri", "warc_date", "http_headers", "payload"]).to_pylist():
                    payload, target = r["payload"] or b"", r["target_uri"] or ""
                    source = digest(payload)
                    text, title, links, metas = parsed(payload.decode("utf-8", "replace"), target)
                    status, *fields = (r["http_headers"] or "").strip().split("\r\n")
                    meta = json.dumps({
                        "WARC-Refers-To": r["record_id"], "WARC-Target-URI": target, "WARC-Payload-Digest": source, "Actual-Content-Length": len(payload),
                        "HTTP-Response-Metadata": {"Status": status, "Headers": dict(f.split(": ", 1) for f in fields if ": " in f),
                                                   "HTML-Metadata": {"Title": title, "Metas": metas, "Links": links}}}, ensure_ascii=False, sort_keys=True)
                    for name, content, block in (("metadata", "application/json", meta), ("conversion", "text/plain", text)):
                        data = block.encode("utf-8", "replace")
                        rows.append((name, record_id(name, r["record_id"], source), r["record_id"], target, r["warc_date"], content, len(data), digest(data), source, data))
                columns = list(zip(*rows)) or [[]] * 10
                kinds = [pa.string()] * 6 + [pa.int64()] + [pa.string()] * 2 + [pa.binary()]
                made = [pa.array(list(c), t) for c, t in zip(columns, kinds)]
                made[-1] = made[-1].cast(pa.string())
                ids = part.column("page_id").take(pa.array([i for i in range(part.num_rows) for _ in (0, 1)], pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, *made], [f.split()[0] for f in DERIVED.split(", ")])

    columns = [f.split()[0] for f in RESPONSES.split(", ")]
    return records.select(*columns).mapInArrow(make, DERIVED.format(id=kind))


def serialised(records: DataFrame) -> DataFrame:
    """Adds ``warc``: each derived record as the bytes of a WARC file, which may be joined in any order."""
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), F.col("record_id"), F.lit("\r\nWARC-Refers-To: "), F.col("refers_to"),
        F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("target_uri", r"[\r\n]", ""), F.lit("\r\nWARC-Date: "), F.col("warc_date"), F.lit("\r\nWARC-Block-Digest: "), F.col("block_digest"),
        F.lit("\r\nContent-Type: "), F.col("content_type"), F.lit("\r\nContent-Length: "), F.col("content_length").cast("string"), F.lit("\r\n\r\n"))
    return records.withColumn("warc", F.concat(head.cast("binary"), F.col("block").cast("binary"), F.lit("\r\n\r\n").cast("binary")))


def read_records(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of each record of a WARC file's bytes, gzip or plain."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
        size = int(headers.get("Content-Length", 0))
        yield headers, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


def responses_of_files(files: DataFrame, content_col: str = "content") -> DataFrame:
    """Response records of WARC files read as binary (one row per file); ``page_id`` is the record id."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                for headers, block in read_records(data or b""):
                    if headers.get("WARC-Type") != "response":
                        continue
                    top, _, payload = block.partition(b"\r\n\r\n")
                    name = headers.get("WARC-Record-ID", "")
                    row = [name, name, headers.get("WARC-Target-URI", ""), headers.get("WARC-Date", ""), top.decode("utf-8", "replace") + "\r\n\r\n"]
                    yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.string()) for v in row), pa.array([payload], pa.binary())],
                                                     [f.split()[0] for f in RESPONSES.split(", ")])

    return files.select(content_col).mapInArrow(read, RESPONSES.format(id="string"))
