"""WARC derivatives: metadata and plain-text conversion records from response records (operator 8).

Response records are read from WARC files as the standard has them: versions 1.0 and 1.1, plain or in gzip members,
fields in any order and case, folded lines, with the message in chunks or compressed.  For each response two records are
built: `metadata`, a JSON block with the response's source headers, title, links and digests, and `conversion`, the
page's plain text.  Both name the response in WARC-Refers-To and keep its target URI and date; record ids are derived
from the response's id and the kind, so that a second run gives the same records.  Digests are sha1 in base 32, as usual
in WARC files.

Records are made in one map over the responses, without a shuffle.  Files are written as gzip members, one record each,
one file per task, renamed when complete, and read record by record, so that memory is bounded by the longest record.
Pages are scanned by one pass over their bytes: each search goes on where the last one ended, so unclosed tags, comments
and elements cost no more than others; an element whose text isn't shown hides the rest of a page that never closes it.

Defined cases: a null or empty payload gives records with an empty title, no links and an empty text; null URI and
date stay empty headers; control characters in a header field are percent-encoded; bytes that are not of the page's
character set become replacement characters; an absent digest is computed, a wrong block digest is an error; repeated
responses give repeated records; an empty table gives none; columns beside those named are not looked at.
"""

from __future__ import annotations

import codecs
import gzip
import hashlib
import html
import io
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import fresh_dir, materialise, open_path, publish

VERSION = "WARC/1.1"
RESPONSE = "page_id long, record_id string, target_uri string, date string, headers string, payload string, block_digest string, payload_digest string"
RECORD = "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, source_headers string, content_length long, block string"
#: Records that leave a task in one batch, and bytes of their blocks.
MANY, LARGE = 500, 8 << 20

#: Elements whose content is not shown, and those that begin a new line.
HIDDEN = frozenset(b"script style noscript template title".split())
BLOCKS = frozenset(b"p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section nav header footer blockquote pre".split())
_NAME = re.compile(rb"/?([a-z][a-z0-9-]*+)", re.I)
#: Text up to a complete tag, and the tag: its slash, name and attributes.
_TAG = re.compile(rb"([^<]*+)<(/?)([a-z][a-z0-9-]*+)([^>]*+)>", re.I)
_ATTRIBUTE = re.compile(rb"""[\s/]*+(?:([^\s/=]++)(?:\s*+=\s*+(?:"([^"]*+)"?+|'([^']*+)'?+|([^\s]*+)))?+|=)""")
_LONG_NUMBER = re.compile(r"&#[0-9]{8,}+")
_BLANKS = re.compile("  ++")
#: Paths from the root that stay as they are when they are made absolute, if no step begins with a dot.
_PLAIN_PATH = re.compile(r"/(?:[\w%~,-][\w%~,./-]*+)?")
#: Effort of gzip: a record is small, and compressing it costs more than anything else that is done with it.
LEVEL = 1
#: Bytes of a compressed file that are read at once.
CHUNK = 1 << 16
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
_BASE_32 = bytes.maketrans(bytes(range(32)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
#: Half the bits of each number in a row go up into a number of their own: by how much, and masks of those that stay and go.
_HALVES = [(3 * n // 5, sum(((1 << n) - 1) << (2 * at) for at in range(0, 128, 8 * n // 5)), sum(((1 << n) - 1) << (2 * at + 8 * n // 5) for at in range(0, 128, 8 * n // 5))) for n in (80, 40, 20, 10, 5)]
_encode = json.JSONEncoder(ensure_ascii=False).encode


def digest(block: bytes) -> str:
    """sha1 in base 32: its 160 bits are spread over 32 bytes (the library's encoder takes longer than the hash)."""
    n = int.from_bytes(hashlib.sha1(block).digest())
    for up, stay, go in _HALVES:
        n = n & stay | n << up & go
    return "sha1:" + n.to_bytes(32).translate(_BASE_32).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def field(value: str | None) -> str:
    """A header field's value: one line, whatever was in it."""
    if value and value.isprintable():
        return value.strip()
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", value or "").strip()


# -- pages ----------------------------------------------------------------------------------------------------------


def _unescaped(text: bytes) -> str:
    told = text.decode(errors="replace")
    return html.unescape(_LONG_NUMBER.sub("&#99999999", told) if "&#" in told else told)


def _close(low: bytes, name: bytes, at: int) -> int:
    """Where the end tag of an element begins, the page's length if nowhere."""
    tag = b"</" + name
    while (at := low.find(tag, at)) >= 0:
        at += len(tag)
        if low[at : at + 1] in (b"", b" ", b"\t", b"\n", b"\r", b"\f", b"/", b">"):
            return at - len(tag)
    return len(low)


def scan(page: str) -> tuple[str, list[bytes], list[str]]:
    """Title, pieces of visible text, and targets of the anchors as they are written."""
    raw = page.encode(errors="replace")
    low, n, at = raw.lower(), len(raw), 0
    title: bytes | None = None
    text: list[bytes] = []
    targets: list[str] = []
    while at < n:
        if tag := _TAG.match(raw, at):
            piece, slash, name, rest = tag.groups()
            text.append(piece)
            at, name = tag.end(), name.lower()
            if name in BLOCKS:
                text.append(b"\n")
            elif slash:
                continue
            elif name == b"a":
                for key, *values in _ATTRIBUTE.findall(rest.rstrip(b"/ \t\n\r\f\v")):
                    if key.lower() == b"href":
                        targets.append(_unescaped(b"".join(values)))
                        break
            elif name in HIDDEN:
                stop = _close(low, name, at)
                if name == b"title" and title is None:
                    title = raw[at:stop]
                at = stop
            continue
        begin = low.find(b"<", at)
        if begin < 0:
            begin = n
        text.append(raw[at:begin])
        if begin == n:
            break
        if low.startswith(b"<!--", begin):
            end = low.find(b"-->", begin + 4)
            at = n if end < 0 else end + 3
        elif name := _NAME.match(low, begin + 1):
            # a tag that never ends
            if name[1] in BLOCKS:
                text.append(b"\n")
            break
        elif low[begin + 1 : begin + 2] in (b"!", b"?", b"/"):
            end = low.find(b">", begin)
            at = n if end < 0 else end + 1
        else:
            text.append(b"<")
            at = begin + 1
    return _unescaped(title or b"").strip(), text, targets


def plain_text(page: str, pieces: list[bytes] | None = None) -> str:
    """Visible text, one line for each block."""
    text = _unescaped(b"".join(scan(page)[1] if pieces is None else pieces))
    for blank in "\xa0\t\r\f\v":
        text = text.replace(blank, " ")
    lines = (x.strip() for x in _BLANKS.sub(" ", text).split("\n"))
    return "\n".join(x for x in lines if x)


def _absolute(uri: str, link: str) -> str:
    try:
        return urljoin(uri, link)
    except ValueError:
        return link


def links(targets: list[str], uri: str) -> list[str]:
    """Targets, absolute, first occurrences in order."""
    try:
        base = urlsplit(uri)
    except ValueError:
        base = urlsplit("")
    root = f"{base.scheme}://{base.netloc}" if base.scheme in ("http", "https") and base.netloc else ""
    return list(dict.fromkeys(root + x if root and _PLAIN_PATH.fullmatch(x) and "/." not in x else _absolute(uri, x) for x in dict.fromkeys(targets)))


# -- the file format ------------------------------------------------------------------------------------------------


def to_bytes(head: list[tuple[str, str]], block: bytes) -> bytes:
    """One record; the length and the block's digest are added."""
    every = [*head, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return (VERSION + "\r\n" + "".join(f"{k}: {field(v)}\r\n" for k, v in every) + "\r\n").encode(errors="replace") + block + b"\r\n\r\n"


def parse(data: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records (fields by lower-case name, block) of a stream, one after the other."""
    while True:
        line = data.readline()
        while line in (b"\r\n", b"\n"):
            line = data.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        lines = []
        while (line := data.readline()) not in (b"\r\n", b"\n", b""):
            lines.append(line)
        head: dict[str, str] = {}
        last = ""
        for text in b"".join(lines).decode(errors="replace").split("\n"):
            name, colon, value = text.partition(":")
            if text[:1] in " \t" and last:
                head[last] = f"{head[last]} {text.strip()}".strip()
            elif colon:
                last = name.strip().lower()
                head[last] = value.strip()
        if not head.get("content-length", "").isdigit():
            raise ValueError(f"record {head.get('warc-record-id')} has no length")
        size = int(head["content-length"])
        block = data.read(size)
        if len(block) < size:
            raise ValueError(f"record {head.get('warc-record-id')} is cut short")
        told = head.get("warc-block-digest", "")
        if told.lower().startswith("sha1:") and told[5:].upper() != digest(block)[5:]:
            raise ValueError(f"digest of {head.get('warc-record-id')} differs")
        yield head, block


class Members(io.RawIOBase):
    """What the gzip members of a stream hold, one after the other; zeros between and after them are padding."""

    def __init__(self, data: BinaryIO):
        self.data, self.rest, self.member = data, b"", None

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        n = 0
        while n < len(into):
            if self.member is None:
                while not (rest := self.rest.lstrip(b"\0")) and (rest := self.data.read(CHUNK)):
                    self.rest = rest
                if not rest:
                    break
                self.rest, self.member = rest, zlib.decompressobj(31)
            room = len(into) - n
            piece = self.member.decompress(self.rest, room)
            into[n : n + len(piece)] = piece
            n += len(piece)
            if self.member.eof:
                self.rest, self.member = self.member.unused_data, None
                continue
            self.rest = self.member.unconsumed_tail
            if not self.rest and len(piece) < room:
                self.rest = self.data.read(CHUNK)
                if not self.rest:
                    raise EOFError("a gzip member is cut short")
        return n


def records_of(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a file, plain or of gzip members."""
    fs, at = open_path(path)
    with fs.open_input_stream(at, compression=None) as f, io.BufferedReader(f) as raw:
        if raw.peek(2)[:2] == b"\x1f\x8b":
            with io.BufferedReader(Members(raw), 1 << 20) as lines:
                yield from parse(lines)
        else:
            yield from parse(raw)


def _batches(rows: Iterator[dict], schema: pa.Schema, weight: str) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[weight] or "")
        if len(held) >= MANY or size >= LARGE:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string()}[x.split()[1]]) for x in ddl.split(", ")])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        names = batch.schema.names
        for k in range(0, len(batch), MANY):
            # texts become Python's faster by way of numpy
            columns = (c.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(c.type) else c.to_pylist() for c in batch.slice(k, MANY).columns)
            for values in zip(*columns, strict=True):
                yield dict(zip(names, values, strict=True))


def _write(rows: DataFrame, path: str, record, of=_rows) -> DataFrame:
    """(file, n) of the files under path, each with record(row), the bytes of a record, of one task's rows, as of(batches) has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n, sink = f"{path}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0, None
        fs, final = open_path(name)
        tmp = f"{final}.tmp-{os.getpid()}-{TaskContext.get().taskAttemptId()}"
        for r in of(batches):
            if sink is None:
                fs.create_dir(os.path.dirname(final), recursive=True)
                sink = fs.open_output_stream(tmp, compression=None)
            sink.write(gzip.compress(record(r), LEVEL, mtime=0))
            n += 1
        if sink:
            sink.close()
            publish(fs, tmp, final)
            yield pa.RecordBatch.from_pydict({"file": [name], "n": pa.array([n], pa.int64())})

    return rows.mapInArrow(run, "file string, n long")


def _dealt(files: DataFrame) -> DataFrame:
    """As many tasks as files, since the table is small and what it names is not."""
    return files.select("file").repartitionByRange(max(1, files.count()), "file")


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for batch in batches:
        yield from batch.column("file").to_pylist()


def _read(files: DataFrame, ddl: str, rows, weight: str) -> DataFrame:
    """rows(path) of every file."""
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in _paths(batches):
            yield from _batches(rows(path), schema, weight)

    return _dealt(files).mapInArrow(run, ddl)


# -- responses ------------------------------------------------------------------------------------------------------


def _message(block: bytes) -> tuple[str, bytes]:
    """Head and payload of an HTTP message; the payload without chunks and compression."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        head, gap, body = block.partition(b"\n\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(":") for x in head.decode(errors="replace").split("\n"))}
    if fields.get("transfer-encoding") == "chunked":
        whole, at = [], 0
        while (end := body.find(b"\r\n", at)) >= 0:
            try:
                size = int(body[at:end].split(b";")[0], 16)
            except ValueError:
                size = -1
            if size < 0:
                # what is called chunked is not
                whole = [body]
                break
            if not size:
                break
            whole.append(body[end + 2 : end + 2 + size])
            at = end + 2 + size + 2
        body = b"".join(whole)
    if fields.get("content-encoding") in ("gzip", "x-gzip", "deflate") and body:
        for wbits in (47, -15):
            try:
                body = zlib.decompressobj(wbits).decompress(body)
                break
            except zlib.error:
                continue
    return (head + gap).decode(errors="replace"), body


def _text(head: str, body: bytes) -> str:
    named = re.search(r"content-type:[^\n]*charset\s*=\s*[\"']?([\w.:-]+)", head, re.I)
    try:
        return body.decode(codecs.lookup(named[1] if named else "utf-8").name, errors="replace")
    except (LookupError, UnicodeError):
        return body.decode(errors="replace")


def write_pages(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(file, n): stored pages (page_id, url, html) as response records under path, with a plain HTTP head and this date."""

    def record(r: dict) -> bytes:
        payload, uri = (r["html"] or "").encode(errors="replace"), field(r["url"])
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        return to_bytes([
            ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", r["page_id"], uri)), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Payload-Digest", digest(payload)),
            ("X-Page-ID", "" if r["page_id"] is None else str(r["page_id"])), ("Content-Type", "application/http; msgtype=response"),
        ], http + payload)

    return _write(pages.select("page_id", "url", "html"), path, record)


def responses_of(path: str) -> Iterator[dict]:
    """The rows (RESPONSE) of a file's response records."""
    for head, block in records_of(path):
        if head.get("warc-type", "").lower() != "response":
            continue
        http, payload = _message(block)
        page = head.get("x-page-id", "")
        yield {
            "page_id": int(page) if re.fullmatch(r"-?\d{1,18}", page) else None, "record_id": head.get("warc-record-id", ""), "target_uri": head.get("warc-target-uri", "").removeprefix("<").removesuffix(">"),
            "date": head.get("warc-date", ""), "headers": http, "payload": _text(http, payload), "block_digest": head.get("warc-block-digest") or digest(block),
            "payload_digest": head.get("warc-payload-digest") or digest(payload),
        }


def read_responses(files: DataFrame) -> DataFrame:
    """The response records (RESPONSE) of WARC files (file); page_id only where our own field names one."""
    return _read(files, RESPONSE, responses_of, "payload")


# -- derivatives ----------------------------------------------------------------------------------------------------


def derived(r: dict) -> Iterator[dict]:
    """The two rows (RECORD) of a response's row."""
    page, uri, date, headers, source = r["payload"] or "", r["target_uri"] or "", r["date"] or "", r["headers"] or "", r["record_id"]
    title, pieces, targets = scan(page)
    text = plain_text(page, pieces)
    payload_digest = r["payload_digest"] or digest(page.encode(errors="replace"))
    conversion = record_id("conversion", source)
    about = {
        "refers-to": source, "conversion": conversion, "response-block-digest": r["block_digest"], "response-payload-digest": payload_digest,
        "http-headers": headers, "title": title, "links": links(targets, uri), "text-characters": len(text),
    }
    for kind, id_, content, block in (
        ("metadata", record_id("metadata", source), "application/json", _encode(about)),
        ("conversion", conversion, "text/plain; charset=utf-8", text),
    ):
        data = block.encode(errors="replace")
        yield {
            "page_id": r["page_id"], "record_type": kind, "record_id": id_, "refers_to": source, "target_uri": uri, "date": date, "content_type": content,
            "block_digest": digest(data), "payload_digest": payload_digest, "source_headers": headers, "content_length": len(data), "block": data.decode(),
        }


def derive(responses: DataFrame) -> DataFrame:
    """Two records (RECORD) for each response (RESPONSE): metadata, which links to the conversion, and conversion."""
    schema, columns = _arrow(RECORD), [x.split()[0] for x in RESPONSE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((x for r in _rows(batches) for x in derived(r)), schema, "block")

    return responses.select(*columns).mapInArrow(run, RECORD)


def _derivative(r: dict) -> bytes:
    return to_bytes([
        ("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Refers-To", r["refers_to"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Date", r["date"]),
        ("WARC-Source-Payload-Digest", r["payload_digest"]), ("WARC-Source-Headers", json.dumps(r["source_headers"])), ("X-Page-ID", "" if r["page_id"] is None else str(r["page_id"])),
        ("Content-Type", r["content_type"]),
    ], r["block"].encode(errors="replace"))


def write_warc(records: DataFrame, path: str) -> DataFrame:
    """(file, n) of the files with records (RECORD) written under path."""
    return _write(records, path, _derivative)


def derive_files(files: DataFrame, path: str) -> DataFrame:
    """write_warc(derive(read_responses(files)), path) in one map: what a file holds stays in one process."""
    return _write(_dealt(files), path, _derivative, lambda batches: (x for name in _paths(batches) for r in responses_of(name) for x in derived(r)))


def read_warc(files: DataFrame) -> DataFrame:
    """The metadata and conversion records (RECORD) of files (file) that write_warc made."""

    def rows(path: str) -> Iterator[dict]:
        for head, block in records_of(path):
            if head.get("warc-type") in ("metadata", "conversion"):
                page = head.get("x-page-id", "")
                yield {
                    "page_id": int(page) if page else None, "record_type": head["warc-type"], "record_id": head.get("warc-record-id", ""), "refers_to": head.get("warc-refers-to", ""),
                    "target_uri": head.get("warc-target-uri", ""), "date": head.get("warc-date", ""), "content_type": head.get("content-type", ""), "block_digest": head.get("warc-block-digest") or digest(block),
                    "payload_digest": head.get("warc-source-payload-digest", ""), "source_headers": json.loads(head.get("warc-source-headers") or '""'), "content_length": len(block),
                    "block": block.decode(errors="replace"),
                }

    return _read(files, RECORD, rows, "block")


def derivatives_of_pages(pages: DataFrame) -> DataFrame:
    """Pages to response files, these to derivative files, and what the latter hold (RECORD)."""
    spark = pages.sparkSession
    responses = materialise(write_pages(pages, fresh_dir(spark, "responses")), "files")
    return read_warc(materialise(derive_files(responses, fresh_dir(spark, "derivatives")), "files"))
