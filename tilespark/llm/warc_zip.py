"""WARC records in ZIP packages: a writer and a range reader.

A package is a ZIP whose members are stored, not compressed: the WARC itself
(``archive/data.warc.gz``, one gzip member per record) and its index
(``indexes/index.cdxj``, offset and length of each record).  The reader takes
the end-of-central-directory record (and its ZIP64 form) from the file's tail,
reads the central directory, and from there only byte ranges: the index, then
each record.  Nothing is extracted, and a large package is shared by many
tasks, since index slices are dealt out before records are read.

Packages are reached through ``pyarrow.fs``, so their folder may be on any store
it knows (local or mounted, hdfs, s3, gs).  Package names are unique to a task
attempt and only packages in the stored manifest count, so a retried task adds
no record twice.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import fresh_dir, partitions, stored
from tilespark.session import ship_by_value

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads below this are never revisits.
LEAST_REVISIT = 100
PACKAGE_BYTES = 64 << 20
SLICE_RECORDS, SLICE_BYTES = 512, 8 << 20
DATE = "2000-01-01T00:00:00Z"

MANIFEST = "package string, records long, bytes long"
SLICE = "package string, offsets array<long>, lengths array<long>"
RECORD = ("record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
          "payload_bytes long, payload binary")


def open_store(uri: str):
    """(file system, path) of a folder or file."""
    from pyarrow import fs

    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def field(value: str) -> str:
    """A header value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if re.search(r"[\r\n]", value) else value


def record_bytes(name: str, kind: str, uri: str | None, refers_to: str | None, digest: str, size: int, payload: bytes) -> bytes:
    """One WARC record; a revisit keeps the HTTP header (with the full length) and drops the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", DATE)]
    head += [("WARC-Target-URI", field(uri))] if uri is not None else []
    head += [("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def digest_of(label: str, data: bytes) -> str | None:
    """The digest of ``data`` by a labelled one's algorithm and spelling (hex or base 32); null if not known here."""
    kind, _, value = label.partition(":")
    if kind.lower() not in ("md5", "sha1", "sha256", "sha512"):
        return None
    made = hashlib.new(kind.lower(), data)
    return made.hexdigest() if len(value) == 2 * made.digest_size else base64.b32encode(made.digest()).decode()


def parse_record(data: bytes) -> dict:
    """Fields of one uncompressed record; checks the length and digest of a payload where the record tells them.

    Records of any type are taken: a response's payload follows its HTTP head, a resource's is its block,
    the others (``warcinfo``, ``request``, ``metadata`` ...) have none.  A revisit has the size that its HTTP head
    tells.  What a record does not say is null.  ``payload_digest`` is bare for SHA-256, else with its label."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode(errors="replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[:int(fields["content-length"])]
    kind, digest, size, payload = fields.get("warc-type"), fields.get("warc-payload-digest"), None, None
    if kind == "resource":
        payload = block
    elif kind in ("response", "revisit") and block.startswith(b"HTTP/"):
        http, _, body = block.partition(b"\r\n\r\n")
        told = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
        size = int(told[1]) if told else None
        if kind == "response":
            payload = body
    elif kind == "response":  # of another protocol, without a head to cut off
        payload = block
    if payload is not None:
        known = digest and digest_of(digest, payload)
        whole = "warc-truncated" not in fields
        # a body sent in chunks has its digest, by some writers, without the chunks' marks
        coded = kind == "response" and re.search(rb"(?i)\r\n(transfer|content)-encoding:", block.partition(b"\r\n\r\n")[0])
        if whole and not coded and (size not in (None, len(payload)) or known and known.lower() != digest.partition(":")[2].lower()):
            raise ValueError(f"damaged payload in {fields.get('warc-record-id')}")
        size = len(payload)
    bare = lambda x: x and x.removeprefix("<urn:page:").removesuffix(">")
    return {"record_id": bare(fields.get("warc-record-id")), "record_type": kind, "target_uri": fields.get("warc-target-uri"),
            "refers_to": bare(fields.get("warc-refers-to")), "payload_digest": digest and digest.removeprefix("sha256:"), "payload_bytes": size,
            "payload": payload}


class PackageWriter:
    """Streams records into one package; needs neither seeking nor the size beforehand."""

    def __init__(self, folder: str):
        store, path = open_store(folder)
        name = f"pages-{uuid.uuid4().hex}.wacz"
        self.path, self.offset, self.index = f"{folder.rstrip('/')}/{name}", 0, []
        store.create_dir(path, recursive=True)
        self.out = store.open_output_stream(f"{path.rstrip('/')}/{name}")
        self.zip = zipfile.ZipFile(_Unseekable(self.out), "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(WARC_MEMBER, "w", force_zip64=True)

    def add(self, name: str, uri: str | None, record: bytes) -> None:
        packed = gzip.compress(record, 1, mtime=0)
        self.member.write(packed)
        self.index.append(f"{field(uri or '-').replace(' ', '%20')} {DATE} "
                          + json.dumps({"id": name, "offset": self.offset, "length": len(packed)}))
        self.offset += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(INDEX_MEMBER, "".join(x + "\n" for x in self.index))
        self.zip.close()
        self.out.close()
        return self.path, len(self.index), self.offset


class _Unseekable(io.RawIOBase):
    def __init__(self, out):
        self.out = out

    def writable(self):
        return True

    def write(self, data):
        self.out.write(bytes(data))
        return len(data)

    def flush(self):
        pass


def directory(f, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of the ZIP ``f``: name -> (offset of its local header, stored size, method)."""
    def at(pos: int, n: int) -> bytes:
        f.seek(pos)
        return f.read(n)

    tail_at = max(0, size - 65_557)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<10xHII", tail[end:end + 20])
    where = tail_at + end - 20
    if where >= 0 and (locator := at(where, 20))[:4] == b"PK\x06\x07":
        zip64 = at(struct.unpack("<8xQ", locator[:16])[0], 56)
        if zip64[:4] != b"PK\x06\x06":
            raise ValueError("broken ZIP64 end of central directory")
        count, length, start = struct.unpack("<32xQQQ", zip64)
    data, found, pos = at(start, length), {}, 0
    for _ in range(count):
        if data[pos:pos + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, plain, n_name, n_extra, n_note, local = struct.unpack("<10xH8xIIHHH8xI", data[pos:pos + 46])
        name = data[pos + 46:pos + 46 + n_name].decode()
        extra, wide = data[pos + 46 + n_name:pos + 46 + n_name + n_extra], b""
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            wide = extra[4:4 + n] if kind == 1 else wide
            extra = extra[4 + n:]
        # the ZIP64 field holds, in this order, only the values that did not fit
        for what in ("plain", "packed", "local"):
            if {"plain": plain, "packed": packed, "local": local}[what] == 0xFFFFFFFF:
                value, wide = struct.unpack("<Q", wide[:8])[0], wide[8:]
                plain, packed, local = (value if what == "plain" else plain, value if what == "packed" else packed,
                                        value if what == "local" else local)
        found[name] = (local, packed, method)
        pos += 46 + n_name + n_extra + n_note
    return found


def member_start(f, local: int) -> int:
    f.seek(local)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    return local + 30 + sum(struct.unpack("<26xHH", head))


def gzip_members(f, start: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of the gzip members in a byte range, for a WARC without an index."""
    at, begun, left, inflate = 0, 0, b"", zlib.decompressobj(31)
    f.seek(start)
    while at < size or left:
        data = left or f.read(min(1 << 20, size - at))
        at += 0 if left else len(data)
        inflate.decompress(data)
        left = inflate.unused_data
        if inflate.eof:
            over = at - len(left)
            yield begun, over - begun
            begun, inflate = over, zlib.decompressobj(31)
        elif not left and at >= size:
            raise ValueError("cut-off WARC member")


def plain_records(f, start: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of the records in a byte range that holds an uncompressed WARC."""
    at = 0
    while at < size:
        f.seek(start + at)
        head = b""
        while b"\r\n\r\n" not in head and len(head) < size - at:
            head += f.read(min(1 << 12, size - at - len(head)))
        head, end, _ = head.partition(b"\r\n\r\n")
        body = re.search(rb"\r\ncontent-length:[ \t]*(\d+)", head, re.IGNORECASE)
        length = len(head) + 4 + int(body[1]) + 4 if end and body else 0
        if not length or at + length > size:
            raise ValueError("cut-off WARC record")
        yield at, length
        at += length


def covered(f, start: int, size: int, listed: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The listed (offset, length) and the gzip members in the bytes between them that no entry lists."""
    at = 0
    for offset, length in [*sorted(set(listed)), (size, 0)]:
        if offset < at or offset + length > size:
            raise ValueError("index entries overlap or leave their member")
        if offset > at:
            yield from ((at + x, n) for x, n in gzip_members(f, start + at, offset - at))
        if length:
            yield offset, length
        at = offset + length


def index_slices(package: str) -> Iterator[tuple[list[int], list[int]]]:
    """Absolute offsets and lengths of a package's records, in slices of bounded size."""
    store, path = open_store(package)
    with store.open_input_file(path) as f:
        members = directory(f, f.size())
        for name in sorted(members):
            local, size, method = members[name]
            if not name.startswith("archive/") or name.endswith("/"):
                continue
            if not name.endswith((".warc.gz", ".warc")):
                raise ValueError(f"{name} in {package} is no WARC that can be read")
            if method:
                raise ValueError(f"{name} in {package} is not stored")
            base = member_start(f, local)
            entry = members.get(INDEX_MEMBER) if name == WARC_MEMBER else None
            if name.endswith(".warc"):
                spans = plain_records(f, base, size)
            elif entry and not entry[2]:
                f.seek(member_start(f, entry[0]))
                lines = (json.loads(line.split(b" ", 2)[2]) for line in io.BytesIO(f.read(entry[1])) if line.strip() and line[:1] != b"!")
                own = name.removeprefix("archive/")
                spans = covered(f, base, size, [(int(x["offset"]), int(x["length"])) for x in lines
                                                if x.get("filename", own).removeprefix("archive/") == own])
            else:
                spans = gzip_members(f, base, size)
            offsets, lengths = [], []
            for offset, length in spans:
                offsets.append(base + offset), lengths.append(length)
                if len(offsets) >= SLICE_RECORDS or sum(lengths[-1:]) + offsets[-1] - offsets[0] >= SLICE_BYTES:
                    yield offsets, lengths
                    offsets, lengths = [], []
            if offsets:
                yield offsets, lengths


def write_packages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record per row into ZIP packages under ``folder`` (default: a new one in
    the shared folder); returns the stored manifest (package, records, bytes).

    Null html is an empty payload, a null url has no target field.  Of equal
    payloads of at least ``LEAST_REVISIT`` bytes the row with the smallest id is a
    response and rows with other ids revisit it (a null id revisits too; without
    any id all are responses).  An empty table writes no package.  Payloads are
    shuffled once, on their digest; a hot digest is split by the adaptive skew join.
    """
    ship_by_value("tilespark.llm.warc_zip", "tilespark.llm.common")
    folder = folder or fresh_dir(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("key"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    firsts = (rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest")
              .agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    marked = (rows.join(firsts, "digest", "left")
              .withColumn("refers", F.when(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")),
                                           F.col("first").cast("string")))
              .select("id", "url", "digest", "size", "refers", F.when(F.col("refers").isNull(), F.col("payload")).alias("payload")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for b in batches:
            for i in range(0, b.num_rows, 256):
                for name, url, digest, size, refers, payload in zip(*(c.to_pylist() for c in b.slice(i, 256).columns)):
                    writer = writer or PackageWriter(folder)
                    kind = "response" if refers is None else "revisit"
                    writer.add(name or "", url, record_bytes(name or "", kind, url, refers, digest, size, payload or b""))
                    if writer.offset >= package_bytes:
                        done.append(writer.close())
                        writer = None
        if writer:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["package", "records", "bytes"])

    return stored(marked.mapInArrow(run, MANIFEST), "warc-manifest")


def read_packages(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the packages in column ``package``; ids are text.

    Index slices are dealt out over the cluster, then records are read by range.
    With ``payloads`` False the payload is checked but not returned.
    """
    ship_by_value("tilespark.llm.warc_zip", "tilespark.llm.common")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for package in b.column(0).to_pylist():
                for offsets, lengths in index_slices(package):
                    yield pa.RecordBatch.from_arrays([pa.array([package]), pa.array([offsets], pa.list_(pa.int64())),
                                                      pa.array([lengths], pa.list_(pa.int64()))], ["package", "offsets", "lengths"])

    names = RECORD.replace(",", "").split()[::2]
    types = [pa.string()] * 5 + [pa.int64(), pa.binary()]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                store, path = open_store(row["package"])
                found = []
                with store.open_input_file(path) as f:
                    for offset, length in zip(row["offsets"], row["lengths"]):
                        f.seek(offset)
                        data = f.read(length)
                        found.append(parse_record(data if data[:5] == b"WARC/" else gzip.decompress(data)))
                        if not payloads:
                            found[-1]["payload"] = None
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in zip(names, types)], names)

    n = partitions(packages.sparkSession)
    dealt = packages.select("package").repartition(n).mapInArrow(slices, SLICE).repartition(n)
    return dealt.mapInArrow(records, RECORD)
