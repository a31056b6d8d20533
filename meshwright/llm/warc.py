"""WARC derivatives: from response records, linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import html
import re
import uuid
from collections.abc import Iterator
from hashlib import sha1, sha256

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space of URLs
#: Elements whose text is code, and those that are not shown; elements that begin and end a line.
CODE = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style")}
UNSEEN = {"template", "noscript", "head"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: What stands between a tag's name and its end: quotes count only behind "=". Possessive, so no text is read twice.
REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record; header values lose line ends, so none can end a header early."""
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in [*headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(headers["content-length"])
    if len(rest) < n:
        raise ValueError("the record is cut short")
    return headers, rest[:n]


def response(page_id: object, url: str | None, body: str | None, date: str) -> bytes:
    """The response record of a stored page. Its id follows from the page's id, address and content."""
    payload = (body or "").encode("utf-8", "replace")
    target = url or f"urn:page:{page_id}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    ident = uuid.uuid5(SPACE, f"{page_id} {target} {sha1(payload).hexdigest()}")
    return record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{ident}>"), ("WARC-Date", date), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload))], http + payload)


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """The page in one pass: ("", "", text), ("start", name, attributes) and ("end", name, ""). Comments, declarations and code are
    left out; what is not closed goes on to the page's end."""
    at = 0
    while (tag := page.find("<", at)) >= 0:
        yield "", "", page[at:tag]
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            at = end + 3 if end >= 0 else len(page)
        elif found := NAME.match(page, tag):
            rest = REST.match(page, found.end())
            if not rest:
                return
            name, at = found[2].lower(), rest.end()
            yield ("end" if found[1] else "start"), name, rest.group()[:-1]
            if not found[1] and name in CODE:
                end = CODE[name].search(page, at)
                at = end.start() if end else len(page)
        elif page[tag + 1 : tag + 2] in ("!", "?", "/"):
            end = page.find(">", tag)
            at = end + 1 if end >= 0 else len(page)
        else:
            yield "", "", "<"
            at = tag + 1
    yield "", "", page[at:]


def read_page(page: str) -> tuple[str, str | None, str | None, list[str]]:
    """The text of a page (no markup, code, comments or unseen parts; a line for each block, white space folded, character
    references resolved), its title, its language and its links, in time linear in its length."""
    text: list[str] = []
    title: list[str] | None = None
    unseen = open_title = ""
    lang, links = None, []
    for kind, name, value in pieces(page):
        if not kind:
            if open_title:
                title.append(value)
            if not unseen and not open_title:
                text.append(value)
            continue
        if kind == "start":
            if name == "title" and title is None:
                title, open_title = [], name
            if name in ("a", "html"):
                own = {}
                for k, *v in ATTRIBUTE.findall(value):
                    own.setdefault(k.lower(), html.unescape(next((x for x in v if x), "")))
                if name == "a" and "href" in own:
                    links.append(own["href"])
                if name == "html" and lang is None:
                    lang = own.get("lang") or None
            if name in UNSEEN and not unseen:
                unseen = name
        if name == open_title and kind == "end":
            open_title = ""
        if (unseen and kind == "end" and name == unseen) or (unseen == "head" and name == "body"):
            unseen = ""
        if name in BLOCKS and not unseen:
            text.append("\n")
    lines = (" ".join(html.unescape(line).split()) for line in "".join(text).split("\n"))
    return "\n".join(line for line in lines if line), None if title is None else " ".join(html.unescape("".join(title)).split()), lang, links


def derive(source: bytes) -> tuple[bytes, bytes]:
    """The metadata and the conversion record of a response record, both referring to it."""
    headers, block = parse(source)
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *fields = head.decode("latin-1").split("\r\n")
    page = payload.decode("utf-8", "replace")
    ident, target, date = (headers[k] for k in ("warc-record-id", "warc-target-uri", "warc-date"))
    common = [("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Refers-To", ident), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date)]
    shown, title, lang, links = read_page(page)
    text = shown.encode("utf-8", "replace")
    names = {kind: f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {ident}')}>" for kind in ("metadata", "conversion")}
    about = [("http-status", status), *((f"http-{k.strip().lower()}", v.strip()) for k, _, v in (f.partition(":") for f in fields)), ("source-block-digest", headers["warc-block-digest"]), ("source-payload-digest", headers.get("warc-payload-digest", digest(payload))), ("source-content-type", headers["content-type"]), ("source-length", str(len(payload))), ("conversion", names["conversion"]), ("conversion-payload-digest", digest(text))]
    about += [("title", title)] if title else []
    about += [("lang", lang)] if lang else []
    about += [("outlink", x) for x in links]
    fields_block = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in about).encode("utf-8", "replace")
    metadata = record([("WARC-Type", "metadata"), ("WARC-Record-ID", names["metadata"]), *common, ("Content-Type", "application/warc-fields")], fields_block)
    conversion = record([("WARC-Type", "conversion"), ("WARC-Record-ID", names["conversion"]), *common, ("WARC-Source-Payload-Digest", headers.get("warc-payload-digest", digest(payload))), ("WARC-Payload-Digest", digest(text)), ("Content-Type", "text/plain; charset=utf-8")], text)
    return metadata, conversion


COLUMNS = "kind string, record_id string, refers_to string, target_uri string, block_digest string, length long, record_sha256 string"


def warc_derivatives(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", key: str = "page_id", url: str = "url", body: str = "html", source: str | None = None, with_records: bool = False) -> DataFrame:
    """Two rows, metadata and conversion, for each row of pages: key, kind, record_id, refers_to, target_uri, block_digest, length
    (of the block), record_sha256, and with with_records also record, the whole record.

    source: a column with response records; without it they are made from key, url and body, with the given date.
    A null body is an empty page, a null url becomes urn:page:<key>; equal rows give equal records; a source
    that is null or no response record gives no rows. An empty table gives an empty result. One narrow pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, values in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if source is None:
                    stored = response(*values, date)
                elif values[1] is None:
                    continue
                else:
                    stored = bytes(values[1])
                    try:
                        if parse(stored)[0].get("warc-type") != "response":
                            continue
                    except (ValueError, KeyError):
                        continue
                for made in derive(stored):
                    h, block = parse(made)
                    at.append(i)
                    rows.append((h["warc-type"], h["warc-record-id"], h["warc-refers-to"], h["warc-target-uri"], h["warc-block-digest"], len(block), sha256(made).hexdigest(), made))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]
            names = [key, *(x.split()[0] for x in COLUMNS.split(", ")), "record"]
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            n = 9 if with_records else 8
            yield pa.RecordBatch.from_arrays(arrays[:n], names=names[:n])

    rows = pages.select(key, source) if source else pages.select(key, url, body)
    return rows.mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, {COLUMNS}" + (", record binary" if with_records else ""))
