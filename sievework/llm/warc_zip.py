"""Web archives packaged as ZIP: directories parsed, stored members located, records read by byte ranges.

A package is a ZIP file with WARC members under archive/ (each record a gzip member of its own), CDXJ indexes under
indexes/ and a description. The reader never extracts a package: it reads the end record (and the ZIP64 end record where a
field is full), the central directory, the local header of each member, the index, and then only the bytes of the
records, neighbouring records in one read. Archive members have to be stored, for only then a record's place in the
member is a place in the file; a compressed one is an error. Indexes may be stored or deflated, and lines of theirs that name no archive member are skipped.
The bytes of a member that no index line covers are searched for records once, gzip members or plain ones by their Content-Length. One task locates the records of one package; the records are
then spread by place, so a large package doesn't make a large task.

The writer makes one package for each `rows_per_package` rows of a partition, always with ZIP64 fields; it writes aside and
renames, and only the packages named in its manifest, a table written once, are read.

Defined results: page_id, url and html come back as they went in, nulls and empty texts included, for every row (repeated
rows are records each), however long; page ids are whole numbers. Columns besides the three aren't stored. An empty table gives no package and an empty result.
"""

from __future__ import annotations

import gzip
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.shared import fresh, open_fs, written

PLACE = "path string, at long, size long"
#: Bytes of neighbouring records that are read at once.
SPAN = 1 << 20
#: Bytes of records that a task fetches, about.
TASK_BYTES = 3 << 20
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF


def record(kind: str, headers: dict[str, str], body: bytes) -> bytes:
    """One WARC record as a gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n", compresslevel=4, mtime=0)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and body of a record, gzipped or plain."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers.get("content-length", len(rest)))]


def zip_package(members: list[tuple[str, bytes]]) -> bytes:
    """A ZIP file of stored members in which sizes and places are ZIP64 fields."""
    out, central = bytearray(), bytearray()
    for name, body in members:
        raw, at, crc, n = name.encode(), len(out), zlib.crc32(body), len(body)
        out += struct.pack("<4sHHHHHLLLHH", b"PK\x03\x04", 45, 0x800, 0, 0, 0x21, crc, _FULL32, _FULL32, len(raw), 20)
        out += raw + struct.pack("<HHQQ", 1, 16, n, n) + body
        central += struct.pack("<4sHHHHHHLLLHHHHHLL", b"PK\x01\x02", 45, 45, 0x800, 0, 0, 0x21, crc, _FULL32, _FULL32, len(raw), 28, 0, 0, 0, 0, _FULL32)
        central += raw + struct.pack("<HHQQQ", 1, 24, n, n, at)
    start = len(out)
    out += central
    end = len(out)
    out += struct.pack("<4sQHHLLQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, len(members), len(members), len(central), start)
    out += struct.pack("<4sLQL", b"PK\x06\x07", 0, end, 1)
    return bytes(out + struct.pack("<4sHHHHLLH", b"PK\x05\x06", 0, 0, _FULL16, _FULL16, _FULL32, _FULL32, 0))


class Package:
    """A ZIP file that is read by ranges: `members` maps a name to (method, place of its data, compressed size, size)."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file = file
        size = file.size()
        tail_at = max(0, size - 22 - _FULL16)
        tail = self.read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and len(tail) - at >= 22 and struct.unpack_from("<H", tail, at + 20)[0] != len(tail) - at - 22:
            at = tail.rfind(b"PK\x05\x06", 0, at)  # a signature inside the comment
        if at < 0 or len(tail) - at < 22:
            raise ValueError("no end of central directory: not a ZIP file")
        count, length, start = struct.unpack_from("<HLL", tail, at + 10)
        if count == _FULL16 or length == _FULL32 or start == _FULL32:
            where = tail_at + at - 20
            sign, _, end, _ = struct.unpack("<4sLQL", self.read(where, 20)) if where >= 0 else (b"", 0, 0, 0)
            if sign == b"PK\x06\x07":
                found = struct.unpack("<4sQHHLLQQQQ", self.read(end, 56))
                if found[0] != b"PK\x06\x06":
                    raise ValueError("no ZIP64 end of central directory where its locator points")
                count, length, start = found[7:]
        self.members: dict[str, tuple[int, int, int, int]] = {}
        directory, at = self.read(start, length), 0
        for _ in range(count):
            sign, _, _, flags, method, _, _, _, packed, plain, n, extra, note, _, _, _, place = struct.unpack_from("<4sHHHHHHLLLHHHHHLL", directory, at)
            if sign != b"PK\x01\x02":
                raise ValueError("the central directory is broken")
            name = directory[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            fields, k = directory[at + 46 + n : at + 46 + n + extra], 0
            while k + 4 <= len(fields):
                tag, width = struct.unpack_from("<HH", fields, k)
                if tag == 1:
                    values = iter(struct.unpack_from(f"<{width // 8}Q", fields, k + 4))
                    plain = next(values) if plain == _FULL32 else plain
                    packed = next(values) if packed == _FULL32 else packed
                    place = next(values) if place == _FULL32 else place
                k += 4 + width
            self.members[name] = (method, place, packed, plain)
            at += 46 + n + extra + note

    def read(self, at: int, size: int) -> bytes:
        """The bytes of a range."""
        got = self.file.read_at(size, at) if size else b""
        if len(got) != size:
            raise ValueError(f"the file ends before byte {at + size}")
        return got

    def data_at(self, name: str) -> int:
        """Where a member's data begin: its local header has lengths of its own."""
        head = self.read(self.members[name][1], 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        return self.members[name][1] + 30 + sum(struct.unpack_from("<HH", head, 26))

    def content(self, name: str) -> bytes:
        """A member's content, stored or deflated."""
        method, _, packed, _ = self.members[name]
        raw = self.read(self.data_at(name), packed)
        if method == 8:
            return zlib.decompress(raw, -15)
        if method:
            raise ValueError(f"{name} is compressed by method {method}")
        return raw

    def records(self) -> Iterator[tuple[int, int]]:
        """(place in the file, size) of every record."""
        archives = {n: self.data_at(n) for n in self.members if n.startswith("archive/") and not n.endswith("/")}
        for name in archives:
            if self.members[name][0]:
                raise ValueError(f"{name} isn't stored, so its records have no place in the file")
        indexed: dict[str, list[tuple[int, int]]] = {name: [] for name in archives}
        for name in sorted(self.members):
            if not name.startswith("indexes/") or name.endswith("/"):
                continue
            raw = self.content(name)
            for line in (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode("utf-8").splitlines():
                brace = line.find("{")
                if line.startswith("!") or brace < 0:
                    continue
                entry = json.loads(line[brace:])
                named = entry.get("filename", "")
                member = named if named in archives else "archive/" + named
                if member in archives:
                    indexed[member].append((int(entry["offset"]), int(entry["length"])))
                    yield archives[member] + indexed[member][-1][0], indexed[member][-1][1]
        for name in sorted(archives):
            done, size = 0, self.members[name][2]
            for begin, length in [*sorted(indexed[name]), (size, 0)]:
                if begin > done:
                    yield from self._search(archives[name] + done, begin - done)
                done = max(done, begin + length)

    def _search(self, at: int, size: int) -> Iterator[tuple[int, int]]:
        """The records of a range without an index: gzip members, and plain records with line breaks between."""
        begin = 0
        while begin < size:
            head = self.read(at + begin, min(4, size - begin))
            blank = len(head) - len(head.lstrip(b"\r\n"))
            if blank:
                begin += blank
            elif head[:2] == b"\x1f\x8b":
                for end in self._gzip_ends(at, begin, size):
                    yield at + begin, end - begin
                    begin = end
            else:
                end = begin + self._plain_size(at + begin, size - begin)
                yield at + begin, end - begin
                begin = end

    def _gzip_ends(self, at: int, done: int, size: int) -> Iterator[int]:
        """Where each of the gzip members in a row ends, in reads of a bounded size."""
        inflate, buffer = None, b""
        while done < size or buffer:
            if not buffer:
                buffer = self.read(at + done, min(SPAN, size - done))
                done += len(buffer)
            if inflate is None and buffer[:1] != b"\x1f":
                return
            inflate = inflate or zlib.decompressobj(31)
            inflate.decompress(buffer)
            buffer = inflate.unused_data if inflate.eof else b""
            if inflate.eof:
                yield done - len(buffer)
                inflate = None
        if inflate is not None:
            raise ValueError(f"a gzip member is cut off at byte {at + size}")

    def _plain_size(self, at: int, size: int) -> int:
        """Size of the uncompressed record that begins at a place, by its Content-Length."""
        held = 4096
        while b"\r\n\r\n" not in (head := self.read(at, min(held, size))):
            if not head.startswith(b"WARC/") or held >= size:
                raise ValueError(f"no record at byte {at}")
            held *= 4
        headers, _ = parse_record(head)
        length = head.index(b"\r\n\r\n") + 4 + int(headers.get("content-length", size))
        if length > size:
            raise ValueError(f"the record at byte {at} is cut off or has no length")
        return length


def _package(rows: list[tuple[int | None, str | None, str | None]]) -> bytes:
    archive, index = bytearray(), []
    for key, url, html in rows:
        body = (html or "").encode("utf-8")
        row = json.dumps({"page_id": key, "url": url, "null": html is None})
        headers = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, row)}>", "WARC-Date": "2020-01-01T00:00:00Z", "Content-Type": "application/http; msgtype=response", "X-Row": row}
        if url and url.isprintable():
            headers["WARC-Target-URI"] = url
        raw = record("response", headers, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + body)
        entry = {"url": url, "filename": "data.warc.gz", "offset": len(archive), "length": len(raw), "status": 200}
        index.append(f"{json.dumps(url)} 20200101000000 {json.dumps(entry)}")
        archive += raw
    about = json.dumps({"profile": "data-package", "resources": [{"path": "archive/data.warc.gz", "bytes": len(archive)}]})
    return zip_package([("archive/data.warc.gz", bytes(archive)), ("indexes/index.cdxj", "\n".join(index).encode("utf-8")), ("datapackage.json", about.encode())])


def write_packages(pages: DataFrame, *, rows_per_package: int = 2000, package_bytes: int = 32 << 20) -> DataFrame:
    """Packages in the shared folder; gives their manifest (path, n_rows). A package is closed at so many rows or characters of html; a longer page has one to itself."""
    uri = fresh(pages.sparkSession, "warc-packages")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = open_fs(uri)
        where.create_dir(folder, recursive=True)
        held: list = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            size = 0
            name = uuid.uuid4().hex
            with where.open_output_stream(f"{folder}/.{name}") as out:
                out.write(_package(held))
            where.move(f"{folder}/.{name}", f"{folder}/{name}.wacz")
            n = len(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([f"{uri}/{name}.wacz"]), pa.array([n], pa.int64())], names=["path", "n_rows"])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for row in zip(*(batch.column(c).slice(i, 256).to_pylist() for c in range(3))):
                    held.append(row)
                    size += len(row[2] or "")
                    if len(held) == rows_per_package or size >= package_bytes:
                        yield flush()
        if held:
            yield flush()

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return written(rows.mapInArrow(write, "path string, n_rows long"), "warc-manifest")


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            where, name = open_fs(path)
            with where.open_input_file(name) as file:
                places = list(Package(file).records())
            at, size = zip(*places) if places else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(size, pa.int64())], names=["path", "at", "size"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by path and place; neighbours within a span are one read."""
    for batch in batches:
        paths, ats, sizes = (batch.column(c).to_pylist() for c in range(3))
        i = 0
        while i < len(paths):
            j, end = i + 1, ats[i] + sizes[i]
            while j < len(paths) and paths[j] == paths[i] and ats[j] + sizes[j] - ats[i] <= SPAN and ats[j] <= end + 4096:
                end = max(end, ats[j] + sizes[j])
                j += 1
            where, name = open_fs(paths[i])
            with where.open_input_file(name) as file:
                raw = file.read_at(end - ats[i], ats[i])
            rows = []
            for k in range(i, j):
                headers, body = parse_record(raw[ats[k] - ats[i] : ats[k] - ats[i] + sizes[k]])
                if headers.get("warc-type") != "response":
                    continue
                row = json.loads(headers["x-row"]) if "x-row" in headers else {"page_id": None, "url": headers.get("warc-target-uri"), "null": False}
                html = body.partition(b"\r\n\r\n")[2] if body.startswith(b"HTTP/") else body
                rows.append((row["page_id"], row["url"], None if row["null"] else html.decode("utf-8", "replace")))
            key, url, html = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(url, pa.string()), pa.array(html, pa.string())], names=["page_id", "url", "html"])
            i = j


def read_packages(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(page_id, url, html) of every response record of the packages whose paths the manifest's `path` has."""
    packages = manifest.select("path").where("path is not null").repartition("path")
    places = written(packages.mapInArrow(_locate, PLACE), "warc-places")
    # As many tasks as the records' bytes need, for Spark only sees the bytes of the places.
    total = places.agg(F.sum("size").alias("n")).first()["n"] or 0
    tasks = max(1, -(-total // TASK_BYTES))
    spread = places.repartition(tasks, "path", F.floor(F.col("at") / SPAN)).sortWithinPartitions("path", "at")
    return spread.mapInArrow(_fetch, "page_id long, url string, html string")
