"""WARC archives: a writer with revisit records and a salvage reader.

The writer makes one record per page, each a gzip member of its own: a response with the page's bytes, or a revisit of
the response that has the same payload. The reader checks each member (gzip sums) and record (version line,
header, length, closing lines, block and payload digests). Where a check fails it searches for the next member or
version line from which a record passes all checks, also inside a member, goes on there, and logs the byte gap it has
left out. Of a damaged member the records before and after the fault are kept, but for one that ends where nothing
shows that it was whole: neither the member's sum nor a version line behind it.

Archives are written by tasks under a shared folder, each try of a task into files of its own; a manifest row names
a file only when its task has succeeded. Files, members and records are read as streams: a payload of any size is
digested while it is read, and only header lines (and payloads, where they are asked for) are held in memory.
`round_trip` fails if what was read is not what was written.

Defined results: null html is an empty payload; a null url leaves the target out; pages without an id are
revisits of a response with an id where there is one, else responses; repeated rows of the response's id are
responses too; an empty table writes no archive; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, cut

ARCHIVE_BYTES, BLOCK = 32 << 20, 1 << 20
#: Bytes that are unpacked, digested or compressed at once, and of a header line without a colon.
CHUNK, NO_COLON = 1 << 16, 256
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Upper halves of record ids: of rows with a page id, and of rows without one.
WITH_ID, WITHOUT_ID = 0x6C6F6F6D_70616765, 0x6C6F6F6D_6E6F6E65
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_HTTP_LENGTH = re.compile(rb"(?i)\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n")


def uri(folder: str) -> str:
    """folder as a URI with a scheme and //, as Arrow's file systems want it."""
    if "://" in folder:
        return folder
    return "file://" + folder.removeprefix("file:")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(page_id: int | None, data: bytes = b"") -> str:
    low = page_id & (1 << 64) - 1 if page_id is not None else int.from_bytes(hashlib.sha1(data).digest()[:8], "big")
    return f"<urn:uuid:{uuid.UUID(int=(WITH_ID if page_id is not None else WITHOUT_ID) << 64 | low)}>"


def page_of(urn: str | None) -> int | None:
    """The page id in a record id of record_urn."""
    try:
        value = uuid.UUID((urn or "").strip("<> ").removeprefix("urn:uuid:")).int
    except ValueError:
        return None
    if value >> 64 != WITH_ID:
        return None
    low = value & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def record_parts(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> list[bytes]:
    """The parts of one WARC/1.1 record; with refers_to a revisit of that page's response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = payload if refers_to is None else b""
    block = hashlib.sha1(http)
    block.update(body)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_urn(page_id, payload)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(block.digest()).decode()),
        ("WARC-Refers-To", record_urn(refers_to) if refers_to is not None else None),
        ("WARC-Profile", PROFILE if refers_to is not None else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + len(body))),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return [b"WARC/1.1\r\n" + head.encode() + b"\r\n" + http, body, b"\r\n\r\n"]


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    return b"".join(record_parts(page_id, url, payload, refers_to))


def plan_records(pages: DataFrame) -> DataFrame:
    """pages with refers_to: of equal payloads the largest page_id is the response."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("__d", F.sha1("html"))
    first = cut(rows.groupBy("__d").agg(F.max("page_id").alias("__r")))  # then adaptive execution can split a payload that most pages have
    return rows.join(first, "__d").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("__r")), F.col("__r")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes plan_records() rows under folder; a checkpointed manifest (path, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri(folder))
        out = path = None
        n = size = 0
        done = []

        def close():
            out.close()
            done.append((path, n, size))

        store.create_dir(base)
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            for k in range(batch.num_rows):
                if out is None:
                    path, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                for part in record_parts(get("page_id")[k].as_py(), get("url")[k].as_py(), get("html")[k].as_py().encode(), get("refers_to")[k].as_py()):
                    view = memoryview(part)
                    for i in range(0, len(view), BLOCK):
                        size += out.write(pack.compress(view[i : i + BLOCK]))
                size += out.write(pack.flush())
                n += 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return cut(plan_records(pages).mapInArrow(run, "path string, records long, bytes long"))


class Blocks:
    """A file read in blocks, a few of which are kept."""

    def __init__(self, file, size: int):
        self.file, self.size, self.kept = file, size, {}

    def read(self, at: int, n: int) -> bytes:
        out = []
        while n > 0 and at < self.size:
            k = at // BLOCK
            if k not in self.kept:
                if len(self.kept) > 4:
                    self.kept.pop(next(iter(self.kept)))
                self.file.seek(k * BLOCK)
                self.kept[k] = self.file.read(BLOCK)
            part = self.kept[k][at - k * BLOCK : at - k * BLOCK + n]
            if not part:
                break
            out.append(part)
            at, n = at + len(part), n - len(part)
        return b"".join(out)

    def find(self, at: int) -> int:
        """The next place at or after `at` that looks like a member or a version line, else the size."""
        while at < self.size:
            got = self.read(at, BLOCK)
            if m := _START.search(got):
                return at + m.start()
            at += max(1, len(got) - 9)
        return self.size


class Bad(ValueError):
    """A failed check of a record."""


class Broken(Bad):
    """A gzip member that can't be unpacked any further, or ends before its end."""


class Stream:
    """Bytes read in order; at is the number read so far. A mark can be gone back to."""

    def __init__(self):
        self.held, self.pos, self.at = b"", 0, 0

    def more(self) -> bytes:
        raise NotImplementedError

    def peek(self, n: int) -> bytes:
        while len(self.held) - self.pos < n and (got := self.more()):
            self.held, self.pos = self.held[self.pos :] + got, 0
        return self.held[self.pos : self.pos + n]

    def read(self, most: int) -> bytes:
        """The next bytes, up to most of them; none at the end."""
        if self.pos == len(self.held):
            self.held, self.pos = self.more(), 0
        got = self.held[self.pos : self.pos + most]
        self.pos += len(got)
        self.at += len(got)
        return got

    def exactly(self, n: int) -> bytes:
        got = self.peek(n)
        self.pos += len(got)
        self.at += len(got)
        return got

    def line(self) -> bytes:
        """A header line with its end; it has a colon or goes on the line before it."""
        parts, size = [], 0
        while not parts or not parts[-1].endswith(b"\n"):
            if self.pos == len(self.held):
                self.held, self.pos = self.more(), 0
            if not self.held:
                break
            end = self.held.find(b"\n", self.pos)
            parts.append(self.read(len(self.held) if end < 0 else end + 1 - self.pos))
            if size < NO_COLON <= (size := size + len(parts[-1])) and b":" not in (start := b"".join(parts)[:NO_COLON]) and start[:1] not in (b" ", b"\t"):
                raise Bad("header")
        return b"".join(parts)

    def to_version(self) -> bool:
        """Goes on to the next version line behind this place, if there is one."""
        self.exactly(1)
        while True:
            if m := _VERSION.search(self.held, self.pos):
                self.at += m.start() - self.pos
                self.pos = m.start()
                return True
            keep = max(self.pos, len(self.held) - 9)
            self.at += keep - self.pos
            if not (got := self.more()):
                self.at += len(self.held) - keep
                self.pos = len(self.held)
                return False
            self.held, self.pos = self.held[keep:] + got, 0


class Plain(Stream):
    """A file from a place on."""

    def __init__(self, blocks: Blocks, place: int):
        super().__init__()
        self.blocks, self.place = blocks, place

    def more(self) -> bytes:
        got = self.blocks.read(self.place, CHUNK)
        self.place += len(got)
        return got


class Member(Stream):
    """What a gzip member holds; place is that of the next byte to unpack, behind the member once all is read."""

    def __init__(self, blocks: Blocks, place: int):
        super().__init__()
        self.blocks, self.place, self.unpack = blocks, place, zlib.decompressobj(31)

    def more(self) -> bytes:
        while not self.unpack.eof:
            chunk = self.blocks.read(self.place, CHUNK // 4)
            if not chunk:
                raise Broken("member end")
            try:
                got = self.unpack.decompress(chunk, CHUNK)
            except zlib.error:
                raise Broken("member") from None
            self.place += len(chunk) - len(self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail)
            if got:
                return got
        return b""

    def mark(self) -> tuple:
        return self.held, self.pos, self.at, self.place, self.unpack.copy()

    def back(self, mark: tuple) -> None:
        self.held, self.pos, self.at, self.place, self.unpack = *mark[:4], mark[4].copy()


def parse_record(stream: Stream, keep: bool = False) -> dict | None:
    """The header fields of the next record, its payload's digest and size, and if asked for the payload. Raises Bad.

    None at the end of the stream.
    """
    first = stream.exactly(10)
    if not first:
        return None
    if not _VERSION.fullmatch(first):
        raise Bad("version line")
    fields: dict = {}
    name = None
    try:
        while (line := stream.line()) != b"\r\n":
            if not line.endswith(b"\r\n"):
                raise Bad("header")
            if line[:1] in (b" ", b"\t"):
                fields[name] += " " + line.strip().decode()
            else:
                key, value = line.split(b":", 1)
                name = key.strip().lower().decode()
                fields[name] = value.strip().decode()
        length = fields["content-length"]
        if not (length.isascii() and length.isdigit()):
            raise Bad("header")
    except (ValueError, KeyError) as e:
        raise e if isinstance(e, Bad) else Bad("header") from None
    length = left = int(length)
    http = fields.get("content-type", "").startswith("application/http")
    block, payload, size, tail, parts = hashlib.sha1(), None, 0, b"", []
    while left:
        part = stream.read(min(left, CHUNK))
        if not part:
            raise Bad("length")
        left -= len(part)
        block.update(part)
        if keep:
            parts.append(part)
        if payload is not None:
            payload.update(part)
            size += len(part)
        elif http:
            seen = tail + part
            end = seen.find(b"\r\n\r\n")
            if "http-length" not in fields and (m := _HTTP_LENGTH.search(seen[: end + 4] if end >= 0 else seen)):
                fields["http-length"] = int(m[1])
            if end >= 0:
                payload, size = hashlib.sha1(seen[end + 4 :]), len(seen) - end - 4
            tail = seen[-128:]
    if payload is None:
        payload, size = block, length
    if stream.exactly(4) != b"\r\n\r\n":
        raise Bad("length")
    found = base64.b32encode(payload.digest()).decode()
    if (told := fields.get("warc-block-digest", "")).startswith("sha1:") and told[5:] != base64.b32encode(block.digest()).decode():
        raise Bad("block digest")
    if fields.get("warc-type") != "revisit" and (told := fields.get("warc-payload-digest", "")).startswith("sha1:") and told[5:] != found:
        raise Bad("payload digest")
    return fields | {"digest": found, "size": size, "payload": b"".join(parts)[length - size :] if keep else None}


def member_items(blocks: Blocks, at: int, keep: bool) -> Iterator[tuple]:
    """Items of the gzip member at `at` as in salvage(), then ("end", place behind it).

    Raises Bad if no record is found; Broken, if it breaks off behind those that have been found.
    """
    stream, held, bad, found = Member(blocks, at), None, None, False
    while True:
        mark, start = stream.mark(), stream.at
        try:
            fields = parse_record(stream, keep)
            after = stream.peek(10) if fields else b""
        except Broken:
            raise
        except Bad as e:
            bad = bad or (start, str(e))
            stream.back(mark)
            if stream.to_version():
                continue
            fields, after, start = None, b"", stream.at
        if held and (fields or not after):
            yield *held[:2], stream.place, *held[3:]
            held, found = None, True
        if fields or not after:
            if bad and (found or fields):
                yield "gap", at, stream.place, bad[1], (bad[0], start)
                bad = None
            if fields:
                held = "record", at, stream.place, fields, (start, stream.at)
                if not after or _VERSION.fullmatch(after):
                    yield *held[:2], stream.place, *held[3:]
                    held, found = None, True
            if not after:
                if bad:
                    raise Bad(bad[1])
                yield "end", stream.place
                return


def salvage(blocks: Blocks, keep: bool = False) -> Iterator[tuple[str, int, int, object, tuple[int, int] | None]]:
    """("record", from, to, fields, inner) and ("gap", from, to, reason, inner), in order.

    from and to are places in the file. For what lies in a gzip member they tell what of the member had been read, and
    inner has the places in its unpacked bytes.
    """
    at, gap, why = 0, None, ""
    while at < blocks.size:
        reached = at
        try:
            if blocks.read(at, 2) == b"\x1f\x8b":
                items = member_items(blocks, at, keep)
            else:
                fields = parse_record(stream := Plain(blocks, at), keep)
                items = [("record", at, at + stream.at, fields, None), ("end", at + stream.at)]
            for item in items:
                if gap is not None:
                    yield "gap", gap, at, why, None
                    gap = None
                if item[0] == "end":
                    at = item[1]
                else:
                    yield item
                    reached = item[2]
        except Bad as e:
            if gap is None:
                gap, why = reached, str(e)
            at = blocks.find(max(at + 1, reached))
    if gap is not None:
        yield "gap", gap, blocks.size, why, None


FIELDS = "path string, start long, stop long, inner_start long, inner_stop long, kind string, reason string, record_type string, record_id string, refers_to string, url string, payload_digest string, payload_bytes long, page_id long, refers_to_page long"


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """A row for each record and each gap of the manifest's files; payloads if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(uri(folder))
        kinds = [pa.string(), *[pa.int64()] * 4, *[pa.string()] * 7, *[pa.int64()] * 3, *[pa.binary()] * with_payload]
        names = [x.split()[0] for x in FIELDS.split(", ")] + ["payload"] * with_payload

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_file(path) as file:
                    out, held = [], 0
                    for kind, start, stop, what, inner in salvage(Blocks(file, file.size()), with_payload):
                        place = (path, start, stop, *(inner or (None, None)), kind)
                        if kind == "gap":
                            row = (*place, what, *[None] * 8)
                        else:
                            revisit = what.get("warc-type") == "revisit"
                            row = (
                                *place, None, what.get("warc-type"), what.get("warc-record-id"), what.get("warc-refers-to"), what.get("warc-target-uri"),
                                what.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else what["digest"], what.get("http-length") if revisit else what["size"],
                                page_of(what.get("warc-record-id")), page_of(what.get("warc-refers-to")),
                            )
                        out.append((*row, *([what["payload"] if kind == "record" else None] * with_payload)))
                        held += len(out[-1][-1] or b"") if with_payload else 0
                        if len(out) >= 2000 or held > 16 << 20:
                            yield rows(out)
                            out, held = [], 0
                    if out:
                        yield rows(out)

    paths = manifest.select("path").repartitionByRange(max(1, manifest.count()), "path")  # an archive a task; a stated number is never coalesced
    return paths.mapInArrow(run, FIELDS + ", payload binary" * with_payload)


def unread(manifest: DataFrame, items: DataFrame) -> DataFrame:
    """(path, records, read, gaps) of the manifest's archives that were not read whole."""
    per = items.groupBy("path").agg(F.count_if(F.col("kind") == "record").alias("read"), F.count_if(F.col("kind") == "gap").alias("gaps"))
    both = manifest.join(per.withColumnRenamed("path", "__path"), F.col("path") == F.col("__path"), "left")
    both = both.select("path", "records", F.coalesce("read", F.lit(0)).alias("read"), F.coalesce("gaps", F.lit(0)).alias("gaps"))
    return both.filter("records <> read or gaps > 0")


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of pages, written and read back.

    Raises if an archive gives back other records than were written.
    """
    folder = f"{checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(pages, folder)
    items = cut(read_archives(manifest, folder))
    if lost := unread(manifest, items).limit(3).collect():
        raise RuntimeError(f"archives read with other records than were written: {lost}")
    got = items.filter("kind = 'record'")
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))
