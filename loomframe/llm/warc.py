"""WARC records in ZIP archives: written by tasks, read back by range without extracting anything.

An archive holds ``archive/data.warc.gz`` and ``indexes/index.cdxj``, both stored, each record a gzip member of its own.
The reader takes the end record, ZIP64 records where there are any, and the central directory from the archive's tail,
finds the stored members, cuts the index into spans, and tasks read each span's bytes alone.

Cases: a null payload is the empty payload; rows of equal payload of at least ``min_revisit_bytes`` bytes have one
response, the row of the largest id (of rows with that same id, one), and the others are revisits of it; null ids are
smaller than any. Repeated rows are records of their own. Members that aren't stored are an error; records of other writers
are read with what they say of themselves. An empty table gives no archive and an empty result. Only the
named columns are read, so that others can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
URN = "urn:loomframe:page:"
#: Bytes of a member that one task reads at once.
SPAN_BYTES = 16 << 20
#: Fixed value: what a revisit record names as its profile.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, record_id string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


# --- writing


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, sha1, revisit and refers_to (null: a response). Who revisits whom is settled on digests and ids
    alone; payloads meet the marks of their digests, of which those with a thousandth of all rows are sent to every task.
    Only of rows that repeat the id of a response with its payload one has to be chosen; these rows are numbered and written
    first, so that the order in which rows come is never relied on."""
    text = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), text.alias("payload")).withColumn("sha1", F.sha1("payload"))
    light = materialize(rows.select("page_id", "sha1", F.length("payload").alias("n")), "digests")
    by_id = light.where(F.col("n") >= min_revisit_bytes).groupBy("sha1", "page_id").agg(F.count("*").alias("rows"))
    order = F.coalesce("page_id", F.lit(-(1 << 63)))
    heads = by_id.groupBy("sha1").agg(F.max(F.struct(order.alias("o"), "page_id", "rows")).alias("head"), F.sum("rows").alias("copies")).where("copies > 1")
    heads = materialize(heads.select("sha1", "copies", F.col("head.page_id").alias("head_id"), (F.col("head.rows") > 1).alias("contested"), F.lit(True).alias("has_head")), "heads")
    hot = F.col("copies") * 1000 > light.count()
    marked = _by_digest(rows, heads, hot)
    is_head = F.col("page_id").eqNullSafe(F.col("head_id"))
    revisit = F.coalesce("has_head", F.lit(False)) & ~is_head
    names = ["page_id", "url", "payload", "sha1", "revisit", "refers_to"]
    chosen = F.coalesce("contested", F.lit(False)) & is_head
    plain = marked.where(~chosen).withColumn("revisit", revisit).withColumn("refers_to", F.when(F.col("revisit"), F.col("head_id"))).select(names)
    if heads.where("contested").isEmpty():
        return plain
    again = materialize(marked.where(chosen).select("page_id", "url", "payload", "sha1", F.monotonically_increasing_id().alias("uid")), "contested")
    first = materialize(again.groupBy("sha1").agg(F.min("uid").alias("first")).join(heads.select("sha1", "copies"), "sha1"), "first-rows")
    repeats = _by_digest(again, first, hot).withColumn("revisit", F.col("uid") != F.col("first")).withColumn("refers_to", F.when(F.col("revisit"), F.col("page_id")))
    return plain.union(repeats.select(names))


def _by_digest(rows: DataFrame, marks: DataFrame, hot: Column) -> DataFrame:
    """Rows with the marks of their digest, where there are any. Digests that many rows have, fewer than a thousand of them,
    go to every task, and the rows of the others are joined by a shuffle in which none has more rows than a thousandth."""
    mine = rows.join(F.broadcast(marks.where(hot).select(F.col("sha1").alias("hot_sha1"))), F.col("sha1") == F.col("hot_sha1"), "left")
    common = mine.where("hot_sha1 is not null").drop("hot_sha1").join(F.broadcast(marks.where(hot)), "sha1", "left")
    return common.union(mine.where("hot_sha1 is null").drop("hot_sha1").join(marks.where(~hot), "sha1", "left"))


def write_archives(marked: DataFrame, folder: str, date: datetime | None = None) -> DataFrame:
    """One archive for each task; the manifest of what was written. A repeated task writes another name, and only the
    names of tasks that ended are in the manifest. Records have one date, that of the writing unless one is given."""
    when = (date or datetime.now(timezone.utc)).astimezone(timezone.utc)
    stamp, compact = when.strftime("%Y-%m-%dT%H:%M:%SZ"), when.strftime("%Y%m%d%H%M%S")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        path = f"{folder.rstrip('/')}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.wacz"
        store, name = opened(path)
        store.create_dir(name.rpartition("/")[0], recursive=True)
        index: list[str] = []
        with store.open_output_stream(name) as raw, zipfile.ZipFile(_Stream(raw), "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as out:
                at = 0
                for batch in _chain(first, batches):
                    for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "sha1", "revisit", "refers_to")), strict=True):
                        block = record(*(x.as_py() for x in row), stamp)
                        out.write(block)
                        key = "".join(c if c.isprintable() and c != " " else "_" for c in (row[1].as_py() or "-")) or "-"
                        index.append(f"{key} {compact} " + json.dumps({"offset": at, "length": len(block), "filename": DATA.rpartition("/")[2]}))
                        at += len(block)
            with z.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as out:
                out.write("".join(x + "\n" for x in index).encode())
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(index)], pa.int64()), pa.array([at], pa.int64())], ["path", "records", "bytes"])

    return materialize(marked.mapInArrow(run, MANIFEST), "warc-manifest")


class _Stream(io.RawIOBase):
    """A file that is only written forwards."""

    def __init__(self, raw):
        self.raw, self.at = raw, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.raw.write(data)
        self.at += len(data)
        return len(data)


def _chain(first, rest):
    yield first
    yield from rest


def record(page_id, url, payload: bytes, sha1: str, revisit: bool, refers_to, stamp: str = "1970-01-01T00:00:00Z") -> bytes:
    """A record as a gzip member; stamp: its date."""
    name = lambda x: f"<{URN}{'null' if x is None else x}>"
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {stamp}",
        f"WARC-Target-URI: {target}" if url is not None else "",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        f"WARC-Payload-Length: {len(payload)}",
        f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: {name(refers_to)}" if revisit else "",
        "Content-Type: application/http; msgtype=response",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if revisit else http + payload
    text = "\r\n".join([x for x in head if x] + [f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(text) + c.flush()


# --- reading


def directory(f) -> dict[str, tuple[int, int, int]]:
    """(method, first byte, length) of each member of an archive, from its central directory."""
    f.seek(0, 2)
    size = f.tell()
    tail_at = max(0, size - 65_557 - 20)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        if end < 20 or tail[end - 20 : end - 16] != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        (at,) = struct.unpack_from("<Q", tail, end - 12)
        f.seek(at)
        count, length, start = struct.unpack_from("<QQQ", f.read(56), 32)
    f.seek(start)
    central, members, at = f.read(length), {}, 0
    for _ in range(count):
        if central[at : at + 4] != b"PK\1\2":
            raise ValueError("a broken central directory")
        method, packed, full, n, extra, comment, offset = struct.unpack("<10xH8xIIHHH8xI", central[at : at + 46])
        name = central[at + 46 : at + 46 + n].decode("utf-8", "replace")
        offset, packed = _wide(central[at + 46 + n : at + 46 + n + extra], full, packed, offset)
        at += 46 + n + extra + comment
        f.seek(offset)
        local = f.read(30)
        if local[:4] != b"PK\3\4":
            raise ValueError("a broken member")
        members[name] = (method, offset + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
    return members


def _wide(extra: bytes, full: int, packed: int, offset: int) -> tuple[int, int]:
    """Offset and stored length, from the ZIP64 field where the short ones overflow."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            full = next(wide) if full == 0xFFFFFFFF else full
            packed = next(wide) if packed == 0xFFFFFFFF else packed
            offset = next(wide) if offset == 0xFFFFFFFF else offset
        at += 4 + n
    return offset, packed


def spans(f, span_bytes: int = SPAN_BYTES) -> Iterator[tuple[int, int, list[int]]]:
    """(first byte, length, lengths of the records) of runs of whole records in the stored members; a member without an
    index is one run, whose records' lengths are not known beforehand."""
    members = directory(f)
    for name, (method, _, _) in members.items():
        if name.startswith(("archive/", "indexes/")) and not name.endswith("/") and method != 0:
            raise ValueError(f"the member {name} is not stored, so that its records can't be read by range")
    entries: dict[str, list[tuple[int, int]]] = {}
    if INDEX in members:
        _, at, size = members[INDEX]
        f.seek(at)
        for line in f.read(size).decode().splitlines():
            if "{" in line:
                entry = json.loads(line[line.index("{") :])
                entries.setdefault(entry.get("filename", DATA.rpartition("/")[2]), []).append((int(entry["offset"]), int(entry["length"])))
    for name, (_, start, length) in members.items():
        if not name.startswith("archive/") or name.endswith("/"):
            continue
        known = sorted(set(entries.get(name.rpartition("/")[2], [])))
        # an index that leaves out a stretch tells nothing of the records there
        ends = [0, *(o + n for o, n in known)]
        if not known or ends[-1] != length or any(o != e for (o, _), e in zip(known, ends, strict=False)):
            if length:
                yield start, length, []
            continue
        begin, sizes = 0, []
        for offset, size in known:
            if sizes and offset + size - begin > span_bytes:
                yield start + begin, sum(sizes), sizes
                begin, sizes = offset, []
            sizes.append(size)
        yield start + begin, sum(sizes), sizes


def list_spans(manifest: DataFrame, span_bytes: int = SPAN_BYTES) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = opened(path)
                with store.open_input_file(name) as f:
                    found = list(spans(f, span_bytes))
                columns = [pa.array([path] * len(found), pa.string()), pa.array([s for s, *_ in found], pa.int64()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([x for *_, x in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["path", "start", "length", "records"])

    return manifest.mapInArrow(run, "path string, start long, length long, records array<long>")


def read_records(ranges: DataFrame) -> DataFrame:
    """The records of byte ranges. The payload of a response is checked against its digest; a revisit's is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "record_id"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path, start, length, sizes in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "length", "records")), strict=True):
                store, name = opened(path)
                with store.open_input_file(name) as f:
                    f.seek(start)
                    for block in indexed(f, sizes) if sizes else members_of(f, length):
                        rows.append(parsed(block))
                        held += len(block)
                        if len(rows) == 500 or held > SPAN_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return ranges.mapInArrow(run, RECORDS)


def indexed(f, sizes: list[int]) -> Iterator[bytes]:
    """The records at a file's place, cut where the index says; the file is read about SPAN_BYTES at a time."""
    at = 0
    while at < len(sizes):
        stop, total = at + 1, sizes[at]
        while stop < len(sizes) and total + sizes[stop] <= SPAN_BYTES:
            total += sizes[stop]
            stop += 1
        data, begin = memoryview(f.read(total)), 0
        for n in sizes[at:stop]:
            yield zlib.decompress(data[begin : begin + n], 31)
            begin += n
        at = stop


def members_of(f, length: int, step: int = 1 << 14) -> Iterator[bytes]:
    """The records of a stretch whose index is not known, one gzip member after another, read a little at a time."""
    d, parts, data = zlib.decompressobj(31), [], b""
    while length or data:
        if not data:
            data = f.read(min(step, length))
            if not data:
                raise ValueError("a stretch of records ends early")
            length -= len(data)
        parts.append(d.decompress(data))
        data = d.unused_data
        if d.eof:
            yield b"".join(parts)
            d, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("a stretch of records ends within one")


def parsed(block: bytes) -> tuple:
    """page_id, url, type, payload's length and digest, refers_to, payload and the record's id. Records of other writers have
    ids of their own, and no page_id; what a header doesn't say is null, or computed from the payload where there is one."""
    head, _, rest = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    body = rest[: int(fields["content-length"])]
    kind, said, own = fields["warc-type"], fields.get("warc-payload-digest", ""), f"<{URN}"
    digest = said.removeprefix("sha1:") if said.startswith("sha1:") else None
    number = lambda x: int(x[len(own) : -1]) if x and x.startswith(own) and x[len(own) : -1].lstrip("-").isdigit() else None
    payload = None
    if kind in ("response", "resource"):
        payload = body.partition(b"\r\n\r\n")[2] if kind == "response" and fields.get("content-type", "").startswith("application/http") else body
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest is not None and found != digest:
            raise ValueError(f"a payload of {fields['warc-record-id']} differs from its digest")
        digest = found
    n = len(payload) if payload is not None else int(fields["warc-payload-length"]) if "warc-payload-length" in fields else None
    return number(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, n, digest, number(fields.get("warc-refers-to")), payload, fields.get("warc-record-id")


def archive_and_read(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read every record back."""
    spark = pages.sparkSession
    manifest = write_archives(mark_revisits(pages, min_revisit_bytes=min_revisit_bytes), scratch_path(spark, "warc"))
    archives, size = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    ranges = list_spans(manifest.repartition(max(1, min(archives, 10_000))))
    # an exchange of a row for each span deals the spans of all archives to tasks
    return read_records(ranges.repartition(max(1, min(-(-size // SPAN_BYTES) + archives, 100_000))))
