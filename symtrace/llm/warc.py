"""WARC records in ZIP archives: a writer, and a reader by ranges.

Each task packs its records, each its own gzip member, into one stored member ``archive/data.warc.gz``
of a ZIP archive in the shared folder, with a stored index ``indexes/index.cdxj`` of their offsets.
The reader never unpacks an archive: it reads the end of the file, the ZIP64 locator and directory where
there are any, and the central directory; finds the stored members through their local headers; reads
the index; and then reads and checks records by their ranges, spread over tasks.

A record is a revisit if a record with the same payload of at least ``least`` bytes and a smaller
page_id exists; a revisit has the digest, the length and the first record's id, no payload.

Defined cases: null html is an empty payload; a null page_id ranks last and reads back as null; of
repeated rows one is the response; null urls have no target; line ends in urls are percent-encoded in
the record; an empty table gives no archive and an empty result; extra columns are ignored. An archive
that a lost task leaves behind is under a name that nothing refers to.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symtrace.llm.common import Scratch, attach, lean

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RANGE = 4 << 20  #: bytes of records that are read at once
RECORD = "record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long"

# ------------------------------------------------------------------ ZIP, stored members only


def _extra64(*values: int) -> bytes:
    return struct.pack(f"<HH{len(values)}Q", 1, 8 * len(values), *values)


class ZipWriter:
    """Stored members, all sizes and offsets in ZIP64 fields, as archives may pass 4 GB."""

    def __init__(self, out):
        self.out, self.at, self.entries = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """A member whose size and sum aren't known yet; they follow its data, so nothing is held back or sought."""
        raw, extra = name.encode(), _extra64(0, 0)
        self.own = [raw, 0, 0, self.at]
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x808, 0, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra)) + raw + extra)

    def add(self, data: bytes) -> int:
        """Writes a part of the member; its offset within the member."""
        at = self.own[2]
        self.own[1], self.own[2] = zlib.crc32(data, self.own[1]), at + len(data)
        self._put(data)
        return at

    def end(self) -> None:
        _, crc, size, _ = self.own
        self._put(struct.pack("<IIQQ", 0x08074B50, crc, size, size))
        self.entries.append(tuple(self.own))

    def member(self, name: str, parts: list[bytes]) -> None:
        self.begin(name)
        for p in parts:
            self.add(p)
        self.end()

    def close(self) -> None:
        began = self.at
        for raw, crc, size, offset in self.entries:
            extra = _extra64(size, size, offset)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x808, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + raw + extra)
        size, end = self.at - began, self.at
        n = len(self.entries)
        self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, began))
        self._put(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


def _at(f, offset: int, n: int) -> bytes:
    f.seek(offset)
    return f.read(n)


def directory(f, size: int) -> dict[str, tuple[int, int]]:
    """Offset of the data and size of every member, from the central directory."""
    tail_at = max(0, size - 22 - 65535)
    tail = _at(f, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP archive")
    _, _, _, _, n, length, start, _ = struct.unpack("<IHHHHIIH", tail[end : end + 22])
    if n == 0xFFFF or 0xFFFFFFFF in (length, start):
        mark, _, at64, _ = struct.unpack("<IIQI", _at(f, tail_at + end - 20, 20))
        if mark != 0x07064B50:
            raise ValueError("no ZIP64 locator")
        mark, _, _, _, _, _, _, n, length, start = struct.unpack("<IQHHIIQQQQ", _at(f, at64, 56))
        if mark != 0x06064B50:
            raise ValueError("no ZIP64 directory")
    raw, at, found = _at(f, start, length), 0, {}
    for _ in range(n):
        mark, _, _, _, how, _, _, _, packed, plain, names, extras, comments, _, _, _, offset = struct.unpack("<IHHHHHHIIIHHHHHII", raw[at : at + 46])
        if mark != 0x02014B50:
            raise ValueError("broken central directory")
        name = raw[at + 46 : at + 46 + names].decode()
        extra = raw[at + 46 + names : at + 46 + names + extras]
        at += 46 + names + extras + comments
        while len(extra) >= 4:
            kind, m = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide = list(struct.unpack(f"<{m // 8}Q", extra[4 : 4 + m // 8 * 8]))
                plain, packed, offset = (wide.pop(0) if v == 0xFFFFFFFF and wide else v for v in (plain, packed, offset))
            extra = extra[4 + m :]
        if how:
            raise ValueError(f"{name} is not stored")
        head = struct.unpack("<IHHHHHIIIHH", _at(f, offset, 30))
        found[name] = (offset + 30 + head[9] + head[10], plain)
    return found


# ------------------------------------------------------------------ WARC


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def name_of(page_id, place) -> str:
    """A record's id: the page's, and its place, which tells repeated and missing ids apart."""
    return f"<urn:page:{'' if page_id is None else page_id}:{place}>"


def record(page_id, place, url, payload: bytes, refers_to, first, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name_of(page_id, place)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: {name_of(refers_to, first)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(file: str, date: str) -> bytes:
    """The record that opens a file; the index doesn't list it."""
    block = b"format: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{file}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"WARC-Filename: {file}.warc.gz", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _zipped(raw: bytes) -> bytes:
    made = zlib.compressobj(6, wbits=31)
    return made.compress(raw) + made.flush()


def parse(raw: bytes) -> dict:
    """A record's fields; the payload's digest and length are checked where the record has the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    own = lambda k: int(i) if (i := fields.get(k, "<urn:page::>")[10:-1].split(":")[0]) else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != n or digest_of(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    url = fields.get("WARC-Target-URI")
    if url is not None:
        url = url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    return {"record_type": kind, "page_id": own("WARC-Record-ID"), "url": url, "payload_bytes": n, "payload_digest": digest, "refers_to": own("WARC-Refers-To"), "payload": payload if kind == "response" else None}


# ------------------------------------------------------------------ tables


def write_archives(work: Scratch, pages: DataFrame, least: int = 0) -> DataFrame:
    """(path, records, bytes): one archive for each task that has pages, in the run's shared folder."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = work.keep(p.withColumn("place", F.monotonically_increasing_id()).withColumn("key", F.sha1(F.col("html").cast("binary"))), "pages")
    long_ = p.where(F.octet_length("html") >= least)
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "place"))
    groups = long_.groupBy("key").agg(first.alias("first"), F.count("*").alias("m")).where("m > 1").select("key", "m", F.col("first.page_id").alias("refers_to"), F.col("first.place").alias("first"))
    # places of revisits are found without the texts, then meet them by place, which no key makes hot
    again = attach(long_.select("key", "place"), groups, ["key"], "m", max(1, p.count())).where("place <> first").select("place", "refers_to", "first", F.lit(True).alias("revisit"))
    again = work.keep(again, "again")  # written, so that its size is known and few revisits don't make the pages move
    rows = p.join(again, "place", "left").select("page_id", "place", "url", "html", "refers_to", "first", F.coalesce("revisit", F.lit(False)).alias("revisit"))
    folder, date = work.path("archives"), datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def pack(batches):
        # records go out as they are made; only the index waits for the end
        out, index, name = None, [], uuid.uuid4().hex
        for batch in batches:
            few = (batch.slice(i, 64) for i in range(0, batch.num_rows, 64))  # so that few payloads are Python objects at once
            for page_id, place, url, html, refers_to, first, revisit in (r for b in few for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "place", "url", "html", "refers_to", "first", "revisit")))):
                if out is None:
                    store, top = fs.FileSystem.from_uri(folder)
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(f"{top}/{name}.zip")
                    z = ZipWriter(out)
                    z.begin(DATA)
                    z.add(_zipped(info(name, date)))
                raw = _zipped(record(page_id, place, url, html.encode(), refers_to, first, revisit, date))
                index.append(json.dumps({"id": page_id, "offset": z.add(raw), "length": len(raw)}))
        if out is not None:
            z.end()
            z.member(INDEX, ["\n".join(index).encode()])
            z.close()
            out.close()
            yield pa.record_batch({"path": pa.array([f"{folder}/{name}.zip"]), "records": pa.array([len(index)], pa.int64()), "bytes": pa.array([z.at], pa.int64())})

    return work.keep(rows.mapInArrow(lean(pack), "path string, records long, bytes long"), "written")


def _opened(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives in ``path``: RECORD's columns, and the payload of responses if wanted."""

    def locate(batches):
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                with _opened(uri) as f:
                    members = directory(f, f.size())
                    start, size = members[INDEX]
                    base = members[DATA][0]
                    spans, run = [], []
                    for line in _at(f, start, size).decode().splitlines():
                        x = json.loads(line)
                        if not run or base + x["offset"] + x["length"] - run[0][0] > RANGE:
                            spans.append(run := [])
                        run.append((base + x["offset"], x["length"]))
                yield pa.record_batch({"path": pa.array([uri] * len(spans)), "offsets": pa.array([[a for a, _ in s] for s in spans], pa.list_(pa.int64())), "lengths": pa.array([[b for _, b in s] for s in spans], pa.list_(pa.int64()))})

    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * payloads
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def read(batches):
        for batch in batches:
            for uri, offsets, lengths in zip(*(batch.column(c).to_pylist() for c in ("path", "offsets", "lengths"))):
                with _opened(uri) as f:
                    raw = _at(f, offsets[0], offsets[-1] + lengths[-1] - offsets[0])
                got = [parse(zlib.decompress(raw[a - offsets[0] : a - offsets[0] + n], wbits=31)) for a, n in zip(offsets, lengths)]
                yield pa.record_batch({c: pa.array([g[c] for g in got], kinds.get(c, pa.string())) for c in names})

    ranges = archives.select("path").mapInArrow(locate, "path string, offsets array<long>, lengths array<long>")
    # ranges are small rows that stand for much work, so their tasks are counted by the archives' bytes
    size = archives.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] if "bytes" in archives.columns else 0
    tasks = max(1, size // RANGE, 0 if size else archives.sparkSession.sparkContext.defaultParallelism)
    return ranges.repartition(tasks).mapInArrow(lean(read), RECORD + ", payload binary" * payloads)


def round_trip(pages: DataFrame, least: int = 0, payloads: bool = False) -> DataFrame:
    """Writes the pages' archives and gives the records read back from them."""
    work = Scratch(pages.sparkSession, "warc")
    out = read_archives(write_archives(work, pages, least), payloads)
    work.drop("pages")
    return out
