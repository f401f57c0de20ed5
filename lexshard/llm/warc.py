"""WARC archives: writing pages with revisit records, and a reader that salvages what damaged archives still hold.

A record is written as a gzip member of its own; members of other archives may hold many. The reader checks each member and
record (gzip's checksum, the version line, the content length, the block digest). Where a check fails, it goes on at the
next version line, in a packed archive within what the member holds and then at the next member, and logs what is in between
as a quarantined gap. Records before the place where a member is cut off are kept, and those of a damaged member whose own
digest is right.

Tasks write to new names in the shared folder and return these names; only names that a finished task returned are read,
so what a lost or repeated task left behind is never seen.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, open_fs, written
from .words import tidy

#: Fixed value of the query's contract: smaller payloads are never revisits.
LEAST = 100
#: A new archive is begun beyond so many bytes.
ROTATE = 64 << 20
CHUNK = 1 << 20
#: A member of so many bytes at most is unpacked once, a larger one twice.
HELD = 16 << 20
#: Payloads that occur again are broadcast, by digest, if there are so many at most (about 120 bytes each).
BROADCAST_DIGESTS = 200_000
#: Fixed values of the format.
VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digest(block: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(block).digest()).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """A record before compression. A null page_id or url is left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~|\\^`{}\"<>"),
        "WARC-Page-ID": page_id,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": _digest(block),
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To-Page-ID": refers_to,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """data as a gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Bad(ValueError):
    """A check failed."""


class Short(Bad):
    """A check failed that more bytes could pass."""


def parse(data: bytes | bytearray, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at a place in data, and its end. Bad: a check failed."""
    if data[at : at + 7] != b"WARC/1."[: len(data) - at]:
        raise Bad("no version line or no end of the headers")
    if (end := data.find(b"\r\n\r\n", at)) < 0:
        raise Short("no version line or no end of the headers")
    head = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("a header without a colon")
        head[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not (length := head.get("content-length", "")).isdigit():
        raise Bad("no content length")
    stop = end + 4 + int(length)
    if (after := data[stop : stop + 4]) != b"\r\n\r\n":
        raise (Short if b"\r\n\r\n".startswith(after) else Bad)("the content length is wrong or the record is cut off")
    block = bytes(data[end + 4 : stop])
    if (said := head.get("warc-block-digest", "")).startswith("sha256:") and said != _digest(block):
        raise Bad("the block digest is wrong")
    return head, block, stop + 4


class _Bytes:
    """A file's bytes by place; holds the part in use only."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, min(CHUNK, self.size - at)))
        return self.held[at - self.at : at - self.at + n]

    def find(self, what: bytes, at: int) -> int:
        """Where what is next, or the size."""
        while at < self.size:
            part = self.get(at, CHUNK)
            if (i := part.find(what)) >= 0:
                return at + i
            if at + len(part) >= self.size:
                break
            at += len(part) - len(what) + 1
        return self.size


class _Member:
    """The member at a place, unpacked piece by piece; after them its end, and what is wrong with it, if anything."""

    def __init__(self, data: _Bytes, at: int):
        self.data, self.at, self.end, self.wrong, self.cut = data, at, at, "", False

    def __iter__(self) -> Iterator[bytes]:
        unpack, self.end = zlib.decompressobj(31), self.at
        while not unpack.eof:
            part = self.data.get(self.end, 1 << 16)
            if not part:
                self.wrong, self.cut = "the member is cut off", True
                return
            before = unpack.copy()
            try:
                out = unpack.decompress(part)
            except zlib.error as e:
                self.wrong = f"the member is damaged: {e}"
                yield from self._until_error(before, part)
                return
            yield out
            self.end += len(part)
        self.end -= len(unpack.unused_data)

    @staticmethod
    def _until_error(unpack, part: bytes) -> Iterator[bytes]:
        for i in range(len(part)):
            try:
                out = unpack.decompress(part[i : i + 1])
            except zlib.error:
                return
            yield out


def _inside(pieces: Iterator[bytes], sure: bool) -> Iterator[tuple]:
    """(headers, block) of a member's records and (reason, None) for what is between them. Unless sure of its bytes, only
    records with a digest that is right."""
    held, at, bad, pieces = bytearray(), 0, "", iter(pieces)

    def more() -> bool:
        nonlocal at
        for piece in pieces:
            if piece:
                del held[:at]
                at = 0
                held.extend(piece)
                return True
        return False

    while at < len(held) or more():
        try:
            head, block, end = parse(held, at)
            if not sure and not head.get("warc-block-digest", "").startswith("sha256:"):
                raise Bad("the member is damaged and the record has no digest")
        except Bad as e:
            if isinstance(e, Short) and more():
                continue
            bad, at = bad or str(e), at + 1
            while (i := held.find(b"WARC/1.", at)) < 0:
                at = max(at, len(held) - 6)
                if not more():
                    i = len(held)
                    break
            at = i
            continue
        if bad:
            yield bad, None
            bad = ""
        yield head, block
        at = end
    if bad:
        yield bad, None


def _plain_at(data: _Bytes, at: int) -> tuple[bytes, int]:
    if data.get(at, 7) != b"WARC/1." or (end := data.find(b"\r\n\r\n", at) - at) >= data.size - at:
        raise Bad("no version line or no end of the headers")
    head = data.get(at, end)
    length = next((x.partition(b":")[2].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
    if not length.isdigit() or at + end + 8 + int(length) > data.size:
        raise Bad("the content length is wrong or the record is cut off")
    return data.get(at, end + 8 + int(length)), at + end + 8 + int(length)


def _packed(data: _Bytes) -> Iterator[tuple]:
    at, gap, why = 0, -1, ""
    while at < data.size:
        if data.get(at, 3) != MAGIC:
            gap, why = (at, "no gzip member") if gap < 0 else (gap, why)
            at = data.find(MAGIC, at + 1)
            continue
        member, kept, size = _Member(data, at), [], 0
        for piece in member:  # once to the end, to know if it is whole; a large one isn't held
            size += len(piece)
            if size <= HELD:
                kept.append(piece)
            else:
                kept.clear()
        end, wrong = member.end, member.wrong
        last = None
        for item in _inside(iter(kept) if size <= HELD else iter(_Member(data, at)), not wrong or member.cut):
            if item[1] is None and last is None and gap >= 0:
                continue  # the gap goes on
            if gap >= 0:
                yield "gap", gap, at, why, None
                gap = -1
            if last is not None:
                yield _item(last, at, at)
            last = item
        if wrong:
            if last is not None and last[1] is not None:
                yield _item(last, at, at)
            gap, why = (at, wrong) if gap < 0 else (gap, why)
            at = data.find(MAGIC, at + 1)
            continue
        if last is not None and last[1] is not None:
            yield _item(last, at, end)
        elif gap < 0:
            gap, why = at, last[0] if last else "the member is empty"
        at = end
    if gap >= 0:
        yield "gap", gap, data.size, why, None


def _item(item: tuple, start: int, end: int) -> tuple:
    return ("gap", start, end, item[0], None) if item[1] is None else ("record", start, end, *item)


def _plain(data: _Bytes) -> Iterator[tuple]:
    at, gap, why = 0, -1, ""
    while at < data.size:
        try:
            raw, end = _plain_at(data, at)
            head, block, used = parse(raw)
            if used != len(raw):
                raise Bad("there are bytes after the record")
        except Bad as e:
            gap, why = (at, str(e)) if gap < 0 else (gap, why)
            at = data.find(b"WARC/1.", at + 1)
            continue
        if gap >= 0:
            yield "gap", gap, at, why, None
            gap = -1
        yield "record", at, end, head, block
        at = end
    if gap >= 0:
        yield "gap", gap, data.size, why, None


def salvage(file, size: int) -> Iterator[tuple]:
    """("record", start, end, headers, block) and ("gap", start, end, reason, None), in the file's order, all its bytes.

    What shares a gzip member begins where the member does; the last of it has the member's bytes, the others none.
    """
    data = _Bytes(file, size)
    packed = data.get(0, 3) == MAGIC or data.find(b"WARC/1.", 0) > data.find(MAGIC, 0)
    yield from (_packed if packed else _plain)(data)


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """Write a record for each row of pages to archives in the shared folder; their (path, records, bytes), a row each.

    The payload is the html in UTF-8, null as empty. Of rows with equal payloads of ``least`` bytes or more, that with the
    smallest id is a response and the others are revisits of it; rows that share this smallest id are all responses, and
    where all ids of a group are null, so are all its rows. A null id among others is a revisit. An empty table gives no
    archive. Other columns of pages take no part.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = pages.select(F.col(id_col).alias("id"), payload.alias("payload")).filter(F.octet_length("payload") >= least)
    firsts = large.groupBy(F.sha2("payload", 256).alias("of")).agg(F.min("id").alias("first"), F.count("*").alias("n")).filter((F.col("n") > 1) & F.col("first").isNotNull())
    firsts = written(firsts.select("of", "first"), "repeated-payloads")
    marked = lambda r, f: r.join(f, F.col("digest") == F.col("of"), "left").select("id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))
    if firsts.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        rows = marked(rows, F.broadcast(firsts))  # so no payload is shuffled
    else:
        size = F.octet_length("payload")
        none = rows.filter(size < least).withColumn("first", F.lit(None).cast(firsts.schema["first"].dataType))
        rows = none.unionByName(marked(rows.filter(size >= least), firsts))
    folder = new_path(pages.sparkSession, "warc")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        out, done = None, []
        for batch in batches:
            for i in range(batch.num_rows):  # row by row, as payloads are large
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, n, size = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                n += 1
                size += out.write(m := member(record(r["id"], r["url"], r["payload"], r["digest"], r["first"], r["first"] is not None))) or len(m)
                if size >= ROTATE:
                    out.close()
                    done.append((f"{folder}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", n, size))
        paths, ns, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(ns, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])
        tidy()

    return written(rows.mapInArrow(save, "path string, records long, bytes long"), "warc-list")


READ = "path string, start long, end long, gap string, page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read(archives: DataFrame) -> DataFrame:
    """Records and gaps of archives (a column path), an archive a task. A gap has its reason in ``gap`` and no record's
    columns. A record has its full payload's digest and size; the payload itself is null for a revisit."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in READ.split(", "))])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = open_fs(path)
                held, size = [], 0
                with fs.open_input_file(name) as file:
                    for kind, start, end, head, block in salvage(file, file.size()):
                        if kind == "gap":
                            held.append({"path": path, "start": start, "end": end, "gap": head})
                        else:
                            http, _, payload = block.partition(b"\r\n\r\n")
                            revisit = head.get("warc-type") == "revisit"
                            length = next((x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"0")
                            digest = head.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                            held.append({"path": path, "start": start, "end": end, "page_id": head.get("warc-page-id"), "url": head.get("warc-target-uri"), "record_type": head.get("warc-type"), "refers_to": head.get("warc-refers-to-page-id"), "payload_digest": digest, "payload_bytes": int(length) if revisit else len(payload), "payload": None if revisit else payload})
                        size += max(end - start, len(block or b""))
                        if len(held) >= 2_000 or size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)
        tidy()

    n = archives.count()
    return archives.select("path").repartition(max(1, n)).mapInArrow(load, READ)
