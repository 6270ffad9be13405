"""WARC records in ZIP-packaged archives: written by tasks, found by central directory and index, read by range.

An archive is a ZIP file with stored members: WARC files below ``archive/`` (one gzip member for each record) and indexes
below ``indexes/`` (one line for each record with its file, offset and length).  The reader parses the end record, the
ZIP64 records where there are any, and the central directory; locates these members; splits the index into ranges of
bounded size; and reads and unzips only those ranges.  A WARC file that no index names is read from its beginning, a
record at a time.  Nothing is extracted to disk.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import store

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Where members of these kinds lie, and how their names end (fixed values of the format).
DATA_IN, DATA_ENDS, INDEX_IN, INDEX_ENDS = "archive/", (".warc.gz", ".warc"), "indexes/", (".cdxj", ".cdxj.gz", ".cdx.gz")
#: Bytes of compressed records that one range holds (more if a single record does).
RANGE_BYTES = 4 << 20
#: Bytes that are read at a time where there is no index, and payload bytes after which a batch is closed.
STEP, HELD = 1 << 20, 16 << 20
#: So many digests of repeated payloads may be broadcast; more are joined by shuffle.
BROADCAST_DIGESTS = 500_000
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- ZIP --------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int  # offset of the local header


def members(read, size: int) -> list[Member]:
    """The central directory of a ZIP file of ``size`` bytes; ``read(n, offset)`` reads a range."""
    tail_at = max(0, size - 65_557)
    tail = read(size - tail_at, tail_at)
    at = len(tail)
    while True:
        at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("not a ZIP file: it has no end record")
        if len(tail) - at >= 22 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] <= len(tail):
            break
    _, _, _, count, length, start, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
    end = tail_at + at
    if 0xFFFF in (count,) or 0xFFFFFFFF in (length, start):
        locator = read(20, end - 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("the ZIP64 locator is missing")
        record = read(56, struct.unpack_from("<Q", locator, 8)[0])
        if record[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end record is missing")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, at, found = read(length, start), 0, []
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, full, n, extra, comment = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n].decode("utf-8", "replace")
        fields = directory[at + 46 + n : at + 46 + n + extra]
        while len(fields) >= 4:
            kind, width = struct.unpack_from("<HH", fields)
            if kind == 1:  # 64-bit values stand here in this order, only for those that are all ones above
                values = iter(struct.unpack_from(f"<{width // 8}Q", fields, 4))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            fields = fields[4 + width :]
        found.append(Member(name, method, full, packed, header))
        at += 46 + n + extra + comment
    return found


def stored_at(read, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed by ZIP, so ranges of it cannot be read")
    return packed_at(read, member)


def packed_at(read, member: Member) -> int:
    """Where a member's bytes begin, be they stored or compressed."""
    head = read(30, member.header)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"{member.name} has no local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


# --- records ----------------------------------------------------------------------------------------------------------


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """A response, or a revisit that leaves the payload out and keeps its HTTP header."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if ord(c) > 31 and ord(c) != 127 else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _digest(said: str | None) -> str | None:
    """A SHA-1 digest, written in base 32 or hexadecimal, as lower-case hexadecimal; None for others."""
    kind, _, value = (said or "").strip().partition(":")
    if kind.lower() != "sha1":
        return None
    return value.lower() if re.fullmatch("[0-9a-fA-F]{40}", value) else base64.b32decode(value.upper()).hex()


def parse(data: bytes, payload: bool = True) -> dict:
    """The fields of one record, digest and length of the whole payload included; the payload itself if asked for.

    A record of HTTP has the message's body as payload, any other its whole block.  A digest that the record states is
    checked if it is SHA-1, unless the payload is left out (as in revisits); without one a revisit's digest is null.
    """
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = memoryview(data)[end + 4 : end + 4 + int(fields["content-length"])]
    if fields.get("content-type", "").lower().startswith("application/http"):
        cut = data.find(b"\r\n\r\n", end + 4, end + 4 + len(block))
        cut = len(block) if cut < 0 else cut - end
        http, body = bytes(block[:cut]), block[cut:]
    else:
        http, body = b"", block
    kind, said = fields["warc-type"], _digest(fields.get("warc-payload-digest"))
    if kind == "revisit":
        stated = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        length, digest, body = int(stated[1]) if stated else None, said, None
    else:
        length, digest = len(body), hashlib.sha1(body).hexdigest()
        if said is not None and digest != said:
            raise ValueError(f"the payload of {fields.get('warc-record-id')} is damaged")
    return {
        "page_id": _page(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page(fields.get("warc-refers-to")),
        "payload": bytes(body) if payload and body is not None else None,
    }


# --- operators --------------------------------------------------------------------------------------------------------


class _Write:
    def __init__(self, base: str):
        self.base = base

    def __call__(self, batches) -> Iterator:
        import pyarrow as pa

        fs, folder = store.filesystem(self.base)
        name, out, index, at = f"pages-{uuid.uuid4().hex}.wacz", None, [], 0
        for batch in batches:
            for part in range(0, batch.num_rows, 64):
                for row in batch.slice(part, 64).to_pylist():
                    if out is None:
                        fs.create_dir(folder, recursive=True)
                        file = fs.open_output_stream(f"{folder}/{name}")
                        pack = zipfile.ZipFile(file, "w", zipfile.ZIP_STORED, allowZip64=True)
                        out = pack.open(DATA, "w", force_zip64=True)
                    coder = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    data = coder.compress(record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"])) + coder.flush()
                    out.write(data)
                    line = {"url": row["url"], "digest": f"sha1:{row['digest']}", "offset": at, "length": len(data), "filename": "data.warc.gz"}
                    index.append(f"{row['page_id']} {DATE} {json.dumps(line)}\n")
                    at += len(data)
        if out is None:
            return
        out.close()
        with pack.open(INDEX, "w", force_zip64=True) as f:
            f.write("".join(index).encode("utf-8", "surrogatepass"))
        pack.close()
        file.close()
        yield pa.RecordBatch.from_pydict({"archive": [f"{self.base}/{name}"], "records": pa.array([len(index)], pa.int64()), "bytes": pa.array([at], pa.int64())})


def write(pages: DataFrame, base: str, least: int = 1000) -> DataFrame:
    """Write a record for each row of ``pages(page_id, url, html)`` below ``base``; returns the archives.

    The payload is the html in UTF-8; null counts as empty.  Of rows with equal payloads of at least ``least`` bytes,
    those with the largest page_id are responses and the others, null page_ids included, revisit them; if all have null
    page_ids, all are responses.  Null URLs are left out of the header; control characters in URLs are escaped.  Other
    columns are ignored; an empty table gives no archives.  Pages are not shuffled unless very many payloads repeat.
    Archives of failed attempts are not in the returned table and so never read.
    """
    spark = pages.sparkSession
    store.bounded_batches(spark)
    rows = store.only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    keyed = rows.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"))
    repeated = keyed.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("chosen"), F.count("*").alias("n"))
    refers = F.when(F.coalesce(F.col("page_id") < F.col("chosen"), F.col("chosen").isNotNull()), F.col("chosen"))
    with Scratch(spark, "warc") as tmp:
        repeated = tmp.save(repeated.where("n > 1").drop("n"), "digests")
        right = F.broadcast(repeated) if repeated.count() <= BROADCAST_DIGESTS else repeated
        marked = keyed.join(right, ["digest", "size"], "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
        return tmp.result(marked.mapInArrow(_Write(base), "archive string, records long, bytes long"))


def _lines(read, member: Member) -> Iterator[bytes]:
    """The lines of an index, stored or compressed, unzipped where its name says so; a step of it is in memory at a time."""
    at = packed_at(read, member)
    end, rest = at + member.packed, b""
    inflate = {0: None, 8: zlib.decompressobj(-15)}[member.method]
    unzip = zlib.decompressobj(31) if member.name.endswith(".gz") else None
    while at < end:
        data = read(min(STEP, end - at), at)
        at += len(data)
        data = inflate.decompress(data) if inflate else data
        while unzip and data:
            rest += unzip.decompress(data)
            data = unzip.unused_data
            if unzip.eof:  # the next gzip member of the same file
                unzip = zlib.decompressobj(31)
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    yield rest


def spans(read, size: int) -> Iterator[tuple[int, list[int]]]:
    """Ranges of one archive: where each begins and the lengths of its records; a single negative length stands for a
    WARC file without an index, of so many bytes.
    """
    parts = members(read, size)
    data = {m.name: m for m in parts if m.name.startswith(DATA_IN) and m.name.endswith(DATA_ENDS)}
    found: dict[str, list[tuple[int, int]]] = {}
    for index in parts:
        if index.name.startswith(INDEX_IN) and index.name.endswith(INDEX_ENDS):
            for line in _lines(read, index):
                at = line.find(b"{")
                if at >= 0:
                    said = json.loads(line[at:].decode("utf-8", "surrogatepass"))
                    if "offset" in said and "length" in said:  # others, as of headers, tell of no record
                        only = next(iter(data)).removeprefix(DATA_IN) if len(data) == 1 else ""
                        found.setdefault(said.get("filename", only).removeprefix(DATA_IN), []).append((int(said["offset"]), int(said["length"])))
    if missing := found.keys() - {name.removeprefix(DATA_IN) for name in data}:
        raise ValueError(f"an index names {sorted(missing)[0]!r}, which is not in the archive")
    for name, member in data.items():
        base, group = stored_at(read, member), []
        known = found.get(name.removeprefix(DATA_IN))
        if known is None:
            if not name.endswith(".gz"):
                raise ValueError(f"{name} is not zipped by record and no index names it")
            yield base, [-member.size]
            continue
        for at, length in sorted(set(known)):
            if group and (at + length - group[0][0] > RANGE_BYTES or at != sum(group[-1])):
                yield base + group[0][0], [n for _, n in group]
                group = []
            group.append((at, length))
        yield base + group[0][0], [n for _, n in group]


def _ranges(batches) -> Iterator:
    """Each archive's index as ranges of neighbouring records."""
    import pyarrow as pa

    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, place = store.filesystem(path)
            with fs.open_input_file(place) as f:
                out = list(spans(f.read_at, f.size()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(out), pa.string()), pa.array([at for at, _ in out], pa.int64()), pa.array([n for _, n in out], pa.list_(pa.int64()))],
                names=["archive", "start", "lengths"],
            )


def _unzipped(read, start: int, lengths: list[int]) -> Iterator[bytes]:
    """The records of a range, one at a time."""
    if lengths[0] >= 0:
        data, at = read(sum(lengths), start), 0
        for n in lengths:
            some = data[at : at + n]
            yield zlib.decompress(some, 31) if some[:2] == b"\x1f\x8b" else some
            at += n
        return
    at, end, rest, unzip, out = start, start - lengths[0], b"", zlib.decompressobj(31), []
    while at < end or rest:
        if not rest:
            rest = read(min(STEP, end - at), at)
            at += len(rest)
        out.append(unzip.decompress(rest))
        rest = unzip.unused_data
        if unzip.eof:
            yield b"".join(out)
            unzip, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the last record is not whole")


class _Records:
    def __init__(self, payload: bool):
        self.payload = payload

    def __call__(self, batches) -> Iterator:
        import pyarrow as pa

        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
        kinds |= {"payload": pa.binary()} if self.payload else {}

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in kinds.items()], names=list(kinds))

        for batch in batches:
            for row in batch.to_pylist():
                fs, place = store.filesystem(row["archive"])
                found, held = [], 0
                with fs.open_input_file(place) as f:
                    for data in _unzipped(f.read_at, row["start"], row["lengths"]):
                        found.append(parse(data, self.payload))
                        held += len(found[-1]["payload"] or b"")
                        if held > HELD or len(found) == 10_000:
                            yield rows(found)
                            found, held = [], 0
                yield rows(found)


def read(archives: DataFrame, payload: bool = False, tmp: Scratch | None = None) -> DataFrame:
    """The records of ``archives(archive)``: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if
    asked for, the payload (null for revisits).  Digests of responses are computed anew and checked.

    Archives of others are read too: any WARC files and indexes in their places, records of any type, without digests or
    with others; a page_id is told from record ids that :func:`write` gave, else null.  An archive that lists a record
    nobody can find raises.  The table of ranges goes to ``tmp``; without one it stays in the shared folder, as the
    returned plan reads it.
    """
    tmp = store.scratch(tmp, archives.sparkSession, "warc-ranges")
    places = archives.select("archive")
    ranges = tmp.save(places.repartition(max(1, places.count())).mapInArrow(_ranges, "archive string, start long, lengths array<long>"), "ranges")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    return ranges.repartition(max(1, min(ranges.count(), 10_000))).mapInArrow(_Records(payload), schema)
