"""WARC records in ZIP packages, read by range without extraction.

An archive is a ZIP file with stored members: gzip-compressed WARC records end to end
under ``archive/``, and a CDXJ index of their places under ``indexes/``. The reader
parses the end record, the ZIP64 records where there are any, and the central directory,
finds the stored members, reads the indexes (CDXJ or CDX, by their own file names), and
then reads records by byte range; nothing is unpacked or copied. So packages of other
writers can be read too. Files are reached through ``pyarrow.fs`` by URI: a shared folder
can be local, HDFS or an object store.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, new_path, release, ship, shuffle_width, with_held

RECORDS = "archive/data.warc.gz"
INDEX = "indexes/index.cdxj"
#: Bytes of compressed records after which an archive is closed.
ARCHIVE_BYTES = 32 << 20
#: Bytes that are read at once when many records are.
READ_BYTES = 4 << 20
#: The letters that name the columns of a CDX line that are read here: compressed size, place, file name.
_CDX = {"S": "length", "V": "offset", "g": "filename"}
_DATE, _STAMP = "1970-01-01T00:00:00Z", "19700101000000"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Member(NamedTuple):
    """A ZIP member as the central directory has it."""

    name: str
    method: int
    size: int
    stored_size: int
    header_at: int


class Record(NamedTuple):
    """A parsed WARC record; ``payload`` is empty for a revisit."""

    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def open_file(uri: str) -> tuple[BinaryIO, int]:
    """A file for range reads, and its size."""
    system, path = fs.FileSystem.from_uri(uri)
    f = system.open_input_file(path)
    return f, f.size()


def read_range(f, at: int, n: int) -> bytes:
    """``n`` bytes from ``at`` on; fewer are an error."""
    f.seek(at)
    out = f.read(n)
    if len(out) != n:
        raise ValueError(f"the file ends within {n} bytes from {at}")
    return bytes(out)


def members(f, size: int) -> list[Member]:
    """The central directory, by way of the ZIP64 records if the end record refers to them."""
    tail_at = max(0, size - 65557)
    tail = read_range(f, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06", 0, max(0, len(tail) - 18))  # the record has 22 bytes
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end)  # the signature may stand in a comment
    if end < 0:
        raise ValueError("no end record: not a ZIP file, or cut short")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF:
        sign, _, record_at, _ = struct.unpack("<4sIQI", read_range(f, tail_at + end - 20, 20))
        if sign != b"PK\x06\x07":
            raise ValueError("a ZIP64 file without a ZIP64 locator")
        record = read_range(f, record_at, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 locator points to no ZIP64 end record")
        count, length, at = struct.unpack_from("<QQQ", record, 32)
    return _central_directory(read_range(f, at, length), count)


def _central_directory(raw: bytes, count: int) -> list[Member]:
    out, i = [], 0
    for _ in range(count):
        if raw[i : i + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", raw, i + 8)
        stored, size, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, i + 20)
        header_at = struct.unpack_from("<I", raw, i + 42)[0]
        name = raw[i + 46 : i + 46 + n_name]
        extra = raw[i + 46 + n_name : i + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # the large ones of these three, in this order
                large = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                size = next(large) if size == 0xFFFFFFFF else size
                stored = next(large) if stored == 0xFFFFFFFF else stored
                header_at = next(large) if header_at == 0xFFFFFFFF else header_at
            extra = extra[4 + n :]
        out.append(Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, size, stored, header_at))
        i += 46 + n_name + n_extra + n_comment
    return out


def stored_at(f, member: Member) -> int:
    """Where a stored member's bytes begin; compressed members cannot be read by range."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    header = read_range(f, member.header_at, 30)
    if header[:4] != b"PK\x03\x04":
        raise ValueError(f"{member.name} has no local header")
    n_name, n_extra = struct.unpack_from("<HH", header, 26)
    return member.header_at + 30 + n_name + n_extra


def digest(payload: bytes) -> str:
    """The SHA-1 of a payload in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(key: str | None, url: str | None, payload: bytes, refers_to: str | None = None, name: str | None = None) -> bytes:
    """A gzip-compressed WARC record: a response, or a revisit of the record of ``refers_to``.

    A revisit keeps the HTTP header, with the payload's length, and no payload.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Target-URI: {_one_line(url or '')}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{name or digest(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _one_line(s: str) -> str:
    return "".join(c if c >= " " else "%%%02X" % ord(c) for c in s)


def record_id(key: str | None) -> str:
    return "<urn:page:null>" if key is None else f"<urn:page:key:{key}>"


def key_of(identifier: str) -> str | None:
    """The key in an identifier of :func:`record_id`; null for others' records."""
    return identifier[len("<urn:page:key:") : -1] if identifier.startswith("<urn:page:key:") else None


def parse_record(raw: bytes) -> Record:
    """A record from its compressed bytes; a response's payload must have its digest."""
    try:
        data = zlib.decompress(raw, 31)
    except zlib.error as e:
        raise ValueError(f"a record is damaged: {e}") from e
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = _headers(head)
    if not {"warc-type", "warc-record-id", "content-length"} <= headers.keys():
        raise ValueError("a record lacks a header that every record has")
    body = rest[: int(headers["content-length"])]
    if headers["warc-type"] not in ("response", "revisit") or not headers.get("content-type", "").startswith("application/http"):
        return Record(headers, {}, body)
    http, _, payload = body.partition(b"\r\n\r\n")
    kind, _, name = headers.get("warc-payload-digest", "").partition(":")
    if headers["warc-type"] == "response" and kind == "sha1" and name != digest(payload):
        raise ValueError(f"{headers['warc-record-id']}: the payload does not have its digest")
    return Record(headers, _headers(http), payload)


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def surt(url: str) -> str:
    """A URL with its host's labels reversed, as indexes are sorted by; what is no URL stays, without spaces."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").split(".")
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        parts, host, port = None, [""], ""
    if host == [""]:
        return quote(url, safe="/:?&=%@+,;~()")
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(f"{','.join(reversed(host))}{port}){rest}".lower(), safe="/:?&=%@+,;~()")


class Packed(NamedTuple):
    """A record on its way into a package."""

    raw: bytes
    url: str
    digest: str
    kind: str


def package(records: list[Packed]) -> bytes:
    """A ZIP file of the records and of their CDXJ index, both stored."""
    lines, at, name = [], 0, RECORDS.rpartition("/")[2]
    for r in records:
        fields = {"url": r.url, "mime": "text/html" if r.kind == "response" else "warc/revisit", "status": "200", "digest": f"sha1:{r.digest}", "length": str(len(r.raw)), "offset": str(at), "filename": name}
        lines.append(f"{surt(r.url)} {_STAMP} {json.dumps(fields)}\n")
        at += len(r.raw)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(RECORDS, b"".join(r.raw for r in records))
        z.writestr(INDEX, "".join(sorted(lines)))
    return out.getvalue()


def index_places(raw: bytes) -> list[tuple[str, int, int]]:
    """``(file name, offset, length)`` of every line of a CDXJ or CDX index, by file and offset."""
    out, columns = [], None
    try:
        for line in raw.decode("utf-8").splitlines():
            if line.lstrip().upper().startswith("CDX "):
                columns = line.split()[1:]
            elif not line.strip() or line.startswith("!"):
                continue
            elif columns is not None:
                fields = dict(zip((_CDX.get(c, c) for c in columns), line.split()))
                out.append((fields["filename"], int(fields["offset"]), int(fields["length"])))
            else:
                fields = json.loads(line.split(" ", 2)[2])
                out.append((fields["filename"], int(fields["offset"]), int(fields["length"])))
    except (KeyError, IndexError, TypeError, ValueError) as e:
        raise ValueError(f"an index line has no file name, offset and length: {e!r}") from e
    return sorted(set(out))


def places_of(f, size: int) -> list[tuple[int, int]]:
    """Where a package's records begin in the file, and their lengths, ascending."""
    found = members(f, size)
    archives = {m.name.rpartition("/")[2]: m for m in found if m.name.startswith("archive/") and m.name.endswith((".warc.gz", ".warc"))}
    indexes = [m for m in found if m.name.startswith("indexes/") and m.name.removesuffix(".gz").endswith((".cdx", ".cdxj"))]
    if not archives or not indexes:
        raise ValueError("the package has no records under archive/, or no index under indexes/")
    base, out = {name: stored_at(f, m) for name, m in archives.items()}, []
    for m in indexes:
        raw = read_range(f, stored_at(f, m), m.stored_size)
        for name, at, n in index_places(gzip.decompress(raw) if m.name.endswith(".gz") else raw):
            name = name.rpartition("/")[2]
            if name not in base or at < 0 or n < 0 or at + n > archives[name].stored_size:
                raise ValueError(f"the index has a record that is not there: {name}, {at}, {n}")
            out.append((base[name] + at, n))
    return sorted(set(out))


def _record_at(raw: bytes) -> Record:
    return parse_record(raw if raw[:2] == b"\x1f\x8b" else gzip.compress(raw, 1))


def read_archive(uri: str) -> Iterator[Record]:
    """The records that an archive's indexes list, by place, read by range in runs of some MB."""
    f, size = open_file(uri)
    with f:
        places = places_of(f, size)
        i = 0
        while i < len(places):
            j, start = i, places[i][0]
            while j < len(places) and (j == i or sum(places[j]) - start <= READ_BYTES):
                j += 1
            raw = read_range(f, start, max(sum(p) for p in places[i:j]) - start)
            for at, n in places[i:j]:
                yield _record_at(raw[at - start : at - start + n])
            i = j


def read_one(uri: str, nth: int) -> Record:
    """One record by its place: the directory, the index and the record's own bytes are read."""
    f, size = open_file(uri)
    with f:
        return _record_at(read_range(f, *places_of(f, size)[nth]))


def write_archives(
    pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per row; returns the stored manifest ``uri, n_records, n_bytes``.

    Of rows with equal payloads of at least ``min_bytes`` bytes those with the largest key
    are responses (one, unless a row is repeated) and the others revisit it; null keys
    never are the largest. Smaller payloads are all responses. Null html is an empty
    payload. Archives are written under names of their own and listed in the manifest,
    so a task that runs twice leaves a file that nobody reads, never a wrong one.
    """
    spark = pages.sparkSession
    ship(spark)
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"), F.sha1(F.encode(body, "UTF-8")).alias("sha")
    )
    groups = materialize(
        rows.where(F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes)
        .groupBy("sha")
        .agg(F.max("key").alias("largest"), F.count("*").alias("n"))
        .where("n > 1 and largest is not null")
        .select("sha", "largest"),
        "payload-groups",
    )
    # only payloads that may be repeated are shuffled to their group; a bitmap finds them
    names = groups.select(F.xxhash64("sha").alias("name"))
    marked = with_held(rows.withColumn("name", F.xxhash64("sha")), names, "name", "held")
    lone = marked.where("not held").withColumn("largest", F.lit(None).cast(groups.schema["largest"].dataType))
    joined = marked.where("held").join(groups.hint("merge"), "sha", "left").unionByName(lone)
    other = F.col("largest").isNotNull() & ~F.col("key").eqNullSafe(F.col("largest"))
    records = joined.select(F.col("key").cast("string").alias("key"), "url", "html", "sha", F.when(other, F.col("largest").cast("string")).alias("refers_to"))
    folder = new_path(spark, "warc")

    @lean
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        records, size = [], 0

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.wacz"
            raw = package(records)
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(raw)
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"]), pa.array([len(records)], pa.int64()), pa.array([len(raw)], pa.int64())],
                names=["uri", "n_records", "n_bytes"],
            )

        for b in batches:
            for k, u, h, sha, r in zip(*(b.column(i) for i in range(5))):
                payload = (h.as_py() or "").encode("utf-8", "surrogatepass")
                name = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                raw = build_record(k.as_py(), u.as_py(), payload, r.as_py(), name)
                records.append(Packed(raw, u.as_py() or "", name, "response" if r.as_py() is None else "revisit"))
                size += len(raw)
                if size >= archive_bytes:
                    yield close()
                    records, size = [], 0
        if records:
            yield close()

    out = materialize(records.mapInArrow(write, "uri string, n_records long, n_bytes long"), "archives")
    release(groups)
    return out


def read_archives(manifest: DataFrame, key_type: str = "bigint") -> DataFrame:
    """A row per response or revisit of the archives listed.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id``. A
    revisit's payload length is that of its HTTP header, its digest that of its record;
    both are null where a record of another writer does not give them.
    """
    ship(manifest.sparkSession)

    @lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows = []
                for r in read_archive(uri):
                    h = r.headers
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    length = r.http.get("content-length", "")
                    rows.append((
                        key_of(h["warc-record-id"]),
                        len(r.payload) if h["warc-type"] == "response" else int(length) if length.isdigit() else None,
                        h["warc-payload-digest"].rpartition(":")[2] if "warc-payload-digest" in h else None,
                        h["warc-type"],
                        key_of(h["warc-refers-to"]) if "warc-refers-to" in h else None,
                        h.get("warc-target-uri"),
                        h["warc-record-id"],
                    ))
                columns = list(zip(*rows)) or [()] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), *[pa.string()] * 5))],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id"],
                )

    dealt = manifest.select("uri").repartition(shuffle_width(manifest.sparkSession))
    out = dealt.mapInArrow(
        read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, record_id string"
    )
    return out.withColumn("page_id", F.col("page_id").cast(key_type)).withColumn("refers_to", F.col("refers_to").cast(key_type))


def round_trip(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the pages as archives, read these back: a row per page.

    Repeated rows each give a row; null keys come back null; an empty table gives an
    empty result. Columns other than key, url and html are not read.
    """
    manifest = write_archives(pages, key=key, url=url, html=html, min_bytes=min_bytes)
    return read_archives(manifest, pages.schema[key].dataType.simpleString())
