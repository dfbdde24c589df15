"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

Records are rows; `write` lays them down as WARC/1.0 files, and `read` gets them back. Both kinds of
derivative name the response in WARC-Refers-To, carry its source headers on, and have digests.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
SPACE_ID = uuid.uuid5(uuid.NAMESPACE_URL, "urn:lexigraph:warc")
RESPONSE = "page_id long, record_id string, target_uri string, warc_date string, http_headers string, payload string"
DERIVED = "page_id long, record_id string, warc_type string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, payload_digest string, source_headers string, block string"

COMMENT, START = re.compile("-->"), re.compile("<(/?)([a-zA-Z][^\\s/>]*)|<[!?]")
#: What stands in a tag up to a quoted value, with that value; a quote that is never closed counts as a character.
PART = re.compile(r"""[^>=]*(?:=\s*(?:"[^"]*"|'[^']*')?)?""")
#: Elements that are not shown. An unclosed comment, script or style hides the rest of the page; of the others only the tag goes.
HIDDEN, ENDLESS = frozenset(("script", "style", "noscript", "template", "svg")), ("--", "script", "style")
#: What may stand in a head, besides white space and comments: with content, and without.
HEAD_CONTENT, HEAD_TAGS = frozenset(("script", "style", "noscript", "template", "noframes", "title")), frozenset(("base", "basefont", "bgsound", "link", "meta", "html"))
NOT_IN_HEAD = frozenset(("head", "body", "html", "br"))
CLOSING = {"--": COMMENT} | {x: re.compile(rf"</{x}\s*>", re.I) for x in HIDDEN | HEAD_CONTENT}
BLOCKS = frozenset("p div br hr h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th article section nav header footer aside main form pre blockquote figure figcaption address html body title".split())
HREF, LANG = (re.compile(rf"""[\s"'/]{x}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I) for x in ("href", "lang"))
INLINE_SPACE = re.compile(r"[^\S\n]+")


def encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, '|'.join(map(str, parts)))}>"


def scan(page: str) -> tuple[list[str], str | None, str | None, list[str]]:
    """Parts of the visible text, the title, the language and the link targets of `page`, all as written, in one pass.

    Each character is looked at a bounded number of times, so that no markup, however broken, costs more than
    its length. Blocks give line ends; comments, script, style, noscript, template and svg give a blank, as
    does a head, which ends where it is closed or where something begins that cannot stand in it.
    """
    parts: list[str] = []
    links: list[str] = []
    title = lang = None
    absent: set[str] = set()  # names that close nowhere further on, so that a page is searched for each but once
    at, in_head = 0, False

    def close(name: str, start: int) -> tuple[int, int]:
        """Where the content from `start` ends, and where the tag or mark that closes it ends."""
        found = None if name in absent else CLOSING[name].search(page, start)
        if found:
            return found.span()
        absent.add(name)
        return (len(page),) * 2 if name in ENDLESS else (start,) * 2

    while at < len(page):
        low = page.find("<", at)
        low = len(page) if low < 0 else low
        text = page[at:low]
        if text and not (in_head and text.isspace()):
            in_head = False
            parts.append(text)
        if low == len(page):
            break
        m = START.match(page, low)
        if not m:
            in_head = False
            parts.append("<")
            at = low + 1
            continue
        if page.startswith("<!--", low):
            at = close("--", low + 4)[1]
            parts.append(" ")
            continue
        at = m.end()
        while at < len(page) and page[at] != ">":
            at = PART.match(page, at).end()
        at = min(at + 1, len(page))
        name, closing, tag = (m[2] or "").lower(), m[1] == "/", page[low:at]
        if name == "html" and not closing and lang is None:
            lang = value(LANG, tag)
        if in_head:
            if not m[2]:
                continue
            if closing and name == "head":
                in_head = False
                continue
            if closing and name not in NOT_IN_HEAD or not closing and name in HEAD_TAGS:
                continue
            if not closing and name in HEAD_CONTENT:
                start = at
                end, at = close(name, start)
                if name == "title" and title is None and at > start:
                    title = page[start:end]
                continue
            in_head = False
        if not closing and name == "head":
            in_head = True
            parts.append(" ")
        elif not closing and name in HIDDEN:
            at = at if tag.endswith("/>") and name == "svg" else close(name, at)[1]
            parts.append(" ")
        elif name in BLOCKS:
            parts.append("\n")
            if name == "title" and not closing and title is None:
                end, after = close(name, at)
                title = page[at:end] if after > at else None
        elif name == "a" and not closing and (target := value(HREF, tag)) is not None:
            links.append(target)
    return parts, title, lang, links


def value(pattern: re.Pattern, tag: str) -> str | None:
    found = pattern.search(tag)
    return next((x for x in found.groups() if x is not None), "") if found else None


def plain(page: str, parts: list[str] | None = None) -> str:
    """Visible text, one line per block, without scripts, comments, head and markup."""
    text = entities.unescape("".join(scan(page)[0] if parts is None else parts))
    return "\n".join(x for x in (INLINE_SPACE.sub(" ", line).strip() for line in text.split("\n")) if x)


def fields(page: str, headers: dict[str, str], found: tuple | None = None) -> str:
    """The block of a metadata record, as application/warc-fields."""
    _, title, lang, links = found or scan(page)
    lines = [f"title: {' '.join(entities.unescape(title).split())}"] if title is not None else []
    lines += [f"language: {lang}"] if lang else []
    lines += [f"source-{k.lower()}: {v}" for k, v in headers.items()]
    lines += [f"outlink: {entities.unescape(x)} L a/@href".replace("\n", " ").replace("\r", " ") for x in links]
    return "".join(x + CRLF for x in lines)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A response record per page, its id made from page id, address and content, so that a rerun gives the same one."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, url, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                body = page or ""
                data = encoded(body)
                headers = {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(data))}
                rows.append((key, record_id("response", key, url, digest(data)), url, date, json.dumps(headers), body))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.string()) for i, c in enumerate(zip(*rows, strict=True) if rows else [()] * 6)], names=[x.split()[0] for x in RESPONSE.split(", ")])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, RESPONSE)


def derive(records: DataFrame) -> DataFrame:
    """Two rows per response, a metadata and a conversion record, linked to it by `refers_to`.

    `payload_digest` is that of the response's payload in both; `block_digest` is that of the
    record's own block. A null or empty payload gives an empty conversion; a null address stays
    null and is left out of headers. Equal rows give equal records. Rows are independent, so nothing is
    shuffled, and an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for key, source, url, date, headers, page in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                page = page or ""
                payload, found = digest(encoded(page)), scan(page)
                for kind, content, block in (("metadata", "application/warc-fields", fields(page, json.loads(headers or "{}"), found)), ("conversion", "text/plain", plain(page, found[0]))):
                    data = encoded(block)
                    rows.append((key, record_id(kind, source), kind, source, url, date, content, len(data), digest(data), payload, headers, block))
            yield from as_batches(rows)

    return records.select(*[x.split()[0] for x in RESPONSE.split(", ")]).mapInArrow(run, DERIVED)


def response_records(records: DataFrame) -> DataFrame:
    """The responses themselves as records that `write` takes: status line, source headers and payload make the block.

    `refers_to` of a derived record names one of these. A response without headers has a status line only.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for key, source, url, date, headers, page in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                block = "HTTP/1.1 200 OK" + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in json.loads(headers or "{}").items()) + CRLF + (page or "")
                data = encoded(block)
                rows.append((key, source, "response", None, url, date, "application/http; msgtype=response", len(data), digest(data), digest(encoded(page or "")), headers, block))
            yield from as_batches(rows)

    return records.select(*[x.split()[0] for x in RESPONSE.split(", ")]).mapInArrow(run, DERIVED)


def as_batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    columns = [x.split() for x in DERIVED.split(", ")]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if t == "long" else pa.string()) for c, (_, t) in zip(zip(*rows, strict=True), columns, strict=True)], names=[n for n, _ in columns])


NAMES = {"WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri", "WARC-Date": "warc_date", "WARC-Block-Digest": "block_digest", "WARC-Payload-Digest": "payload_digest", "X-Source-ID": "page_id", "X-Source-Headers": "source_headers", "Content-Type": "content_type", "Content-Length": "content_length"}


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Records as WARC files under `path`. A record ends with two line ends, which is the writer's separator."""
    name = lambda k, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}: "), F.col(c).cast("string"), F.lit(CRLF))).otherwise("")
    record = F.concat(F.lit(f"WARC/1.0{CRLF}"), *[name(*x) for x in NAMES.items()], F.lit(CRLF), F.col("block"))
    records.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("compression", compression).text(path)


def unpacked(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """`data` in chunks, decompressed if it is gzip, one member after the other."""
    while data[:2] == b"\x1f\x8b":
        inflater = zlib.decompressobj(31)
        at = 0
        while not inflater.eof and at < len(data):
            yield inflater.decompress(data[at : at + step])
            at += step
        data = inflater.unused_data + data[at:] if inflater.eof else b""
    yield from (data[i : i + step] for i in range(0, len(data), step))


def parsed(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record. What stands between records, or is cut off at the end, is passed over.

    A record without a length, or with one that is no number, ends before the next line that begins a record.
    """
    held, ended = bytearray(), False

    def more() -> bool:
        nonlocal ended
        chunk = next(chunks, None)
        ended = chunk is None
        held.extend(chunk or b"")
        return not ended

    def find(pattern: re.Pattern, start: int) -> re.Match | None:
        while not (m := pattern.search(held, start)):
            start = max(start, len(held) - 64)
            if not more():
                return None
        return m

    while first := find(RECORD, 0):
        del held[: first.start(1)]
        end = find(BLANK, 0)
        if end is None:
            return
        head, body = bytes(held[: end.start()]).decode("utf-8", "replace"), end.end()
        headers: dict[str, str] = {}
        last = None
        for line in head.splitlines()[1:]:
            if line[:1] in " \t" and last:  # a header that goes on
                headers[last] += " " + line.strip()
                continue
            k, colon, v = line.partition(":")
            if colon:
                last = k.strip().lower()
                headers[last] = v.strip()
        size = int(headers["content-length"]) if headers.get("content-length", "").isdecimal() else None
        if size is None:
            after = find(NEXT, body - 2)
            stop = max(body, after.start() if after else len(held.rstrip(b"\r\n")))
        else:
            while len(held) < body + size and more():
                pass
            if len(held) < body + size:
                return
            stop = body + size
        yield headers, bytes(held[body:stop])
        del held[:stop]


RECORD, BLANK, NEXT = re.compile(rb"(?:\A|\n|(?<=\n))(WARC/\d)"), re.compile(rb"\r?\n\r?\n"), re.compile(rb"(?:\r?\n){1,2}(?=WARC/\d)")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records under `path`, written by `write` or by others; a task for each file, which holds that file as it lies and one record.

    Names of headers count in any case, compressed and plain files may be mixed, and files may have a
    compressed member for each record. A block that is no UTF-8 has replacement characters; its length and
    digests are those of its headers, and null where they have none.
    """
    lower = {k.lower(): v for k, v in NAMES.items()}
    columns = [x.split()[0] for x in DERIVED.split(", ")]

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows, held = [], 0
                for headers, block in parsed(unpacked(data)):
                    row = {v: headers.get(k) for k, v in lower.items()} | {"block": block.decode("utf-8", "replace"), "content_length": len(block)}
                    row["page_id"] = int(row["page_id"]) if (row["page_id"] or "").lstrip("-").isdecimal() else None
                    rows.append(tuple(row[c] for c in columns))
                    held += len(block)
                    if held > 8 << 20 or len(rows) >= 10_000:
                        yield from as_batches(rows)
                        rows, held = [], 0
                yield from as_batches(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, DERIVED)


def responses_of(records: DataFrame) -> DataFrame:
    """The responses among records that were read, as `derive` takes them: the HTTP headers of the block, and its payload."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, source, url, date, block in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                head, _, page = re.sub("\r?\n\r?\n", "\0", block or "", count=1).partition("\0")
                pairs = [line.partition(":") for line in head.splitlines()[1:]]
                rows.append((key, source, url, date, json.dumps({k.strip(): v.strip() for k, colon, v in pairs if colon}), page))
            names = [x.split()[0] for x in RESPONSE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.string()) for i, c in enumerate(zip(*rows, strict=True) if rows else [()] * 6)], names=names)

    return records.where("warc_type = 'response'").select("page_id", "record_id", "target_uri", "warc_date", "block").mapInArrow(run, RESPONSE)
