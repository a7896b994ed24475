"""WARC in Zstandard: archives with an own dictionary, one frame a record.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself
perhaps a Zstandard frame; each frame after it decodes to one WARC record. The reader
takes one archive a task at a time, streams it frame by frame, and validates each record:
version line, header syntax, the mandatory fields, that Content-Length is the length of the
block and is followed by two line ends and nothing else, and the block digest if there is one. A
record that fails is returned with ``valid`` false and the reason; a broken frame or a cut
archive ends its archive with one such row, as no later frame can be found.

Edge cases: an empty file and one that ends after the dictionary hold no records; a record without
Content-Length is invalid; a null page body is written as an empty block with the header
``X-Null: true`` and read back as null, an empty one as empty; null ids and addresses leave out their header; repeated
rows are records of their own; extra columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm._text import scratch, table

DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
MANDATORY = ("warc-record-id", "content-length", "warc-date", "warc-type")
SCHEMA = "archive STRING, position BIGINT, page_id BIGINT, url STRING, warc_type STRING, html STRING, content_length BIGINT, valid BOOLEAN, problem STRING"
OUT = pa.schema([("archive", pa.string()), ("position", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("warc_type", pa.string()), ("html", pa.string()), ("content_length", pa.int64()), ("valid", pa.bool_()), ("problem", pa.string())])
_READ, _PIECE = 1 << 20, 1 << 14


class Broken(Exception):
    """The archive cannot be read on."""


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}") if not uri.startswith("file:/") or uri.startswith("file://") else pyarrow.fs.FileSystem.from_uri("file://" + uri[5:])


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """One page as a WARC resource record."""
    body = (html or "").encode("utf-8", "surrogatepass")
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if html is None:
        head.append("X-Null: true")
    head += ["Content-Type: text/html; charset=utf-8", "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode(), f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, str | None]:
    """The headers in lower case, the block, and what is wrong with the record, if anything."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap:
        return {}, b"", "no end of headers"
    if not lines[0].startswith("WARC/1."):
        return {}, b"", "not a WARC version"
    headers: dict[str, str] = {}
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and headers:  # a folded line goes on with the last field
            headers[next(reversed(headers))] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            return headers, b"", f"bad header line {line[:60]!r}"
        headers[name.lower()] = value.strip()
    for name in MANDATORY:
        if name not in headers:
            return headers, b"", f"no {name}"
    if not headers["content-length"].isdecimal():
        return headers, b"", "bad content-length"
    n = int(headers["content-length"])
    body, tail = rest[:n], rest[n:]
    if len(body) < n:
        return headers, body, f"block of {len(body)} bytes, not {n}"
    if tail != b"\r\n\r\n":
        return headers, body, "record doesn't end after its block"
    scheme, _, digest = headers.get("warc-block-digest", "").partition(":")
    if scheme == "sha1" and digest not in (base64.b32encode(hashlib.sha1(body).digest()).decode(), hashlib.sha1(body).hexdigest()):
        return headers, body, "block digest differs"
    return headers, body, None


class Frames:
    """The decoded frames of one archive, one after the other."""

    def __init__(self, stream) -> None:
        self.stream, self.buffer, self.at, self.position = stream, b"", 0, 0

    def _more(self, n: int) -> bytes:
        """The next n bytes, or what is left of them."""
        while len(self.buffer) - self.at < n:
            got = self.stream.read(max(_READ, n))
            if not got:
                break
            self.buffer, self.at = self.buffer[self.at :] + got, 0
        return self.buffer[self.at : self.at + n]

    def _skip(self, n: int) -> None:
        self.at += n
        self.position += n

    def _dictionary(self) -> zstandard.ZstdCompressionDict | None:
        start = self._more(8)
        if len(start) < 8 or struct.unpack("<I", start[:4])[0] != DICTIONARY_MAGIC:
            return None
        n = struct.unpack("<I", start[4:])[0]
        body = self._more(8 + n)[8:]
        if len(body) < n:
            raise Broken("the dictionary is cut off")
        self._skip(8 + n)
        if body[:4] == struct.pack("<I", ZSTD_MAGIC):
            try:
                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            except zstandard.ZstdError as e:
                raise Broken(f"the dictionary can't be read: {e}") from e
        return zstandard.ZstdCompressionDict(body)

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        dictionary = self._dictionary()
        reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
        while magic := self._more(8):
            if len(magic) >= 8 and 0x184D2A50 <= struct.unpack("<I", magic[:4])[0] <= 0x184D2A5F:
                n = 8 + struct.unpack("<I", magic[4:])[0]
                if len(self._more(n)) < n:
                    raise Broken("a skippable frame is cut off")
                self._skip(n)
                continue
            at, frame, out = self.position, reader.decompressobj(), []
            try:
                while not frame.eof:
                    piece = self._more(1) and self.buffer[self.at : self.at + _PIECE]
                    if not piece:
                        raise Broken("the last frame is cut off")
                    out.append(frame.decompress(piece))
                    left = len(frame.unused_data) if frame.eof else 0
                    self._skip(len(piece) - left)
            except zstandard.ZstdError as e:
                raise Broken(f"a frame can't be read: {e}") from e
            yield at, b"".join(out)


def rows_of(stream, name: str) -> Iterator[tuple]:
    frames = Frames(stream)
    try:
        for at, data in frames:
            headers, body, problem = parse(data)
            page, n = headers.get("x-page-id"), headers.get("content-length", "")
            html = None
            if problem is None and headers.get("x-null") != "true":
                try:
                    html = body.decode("utf-8")
                except UnicodeDecodeError:
                    problem = "block isn't UTF-8"
            yield name, at, int(page) if page and page.lstrip("-").isdecimal() else None, headers.get("warc-target-uri"), headers.get("warc-type"), html, int(n) if n.isdecimal() else None, problem is None, problem
    except Broken as e:
        yield name, frames.position, None, None, None, None, None, False, str(e)


def train_dictionary(pages: DataFrame, sample: int = 400, size: int = 64 << 10) -> bytes:
    """A dictionary from at most ``sample`` pages, the first by a hash of their id; empty if they are too few.

    Only pages with a hash below a bound that about twice as many pass are compared, so that tasks send few.
    """
    known = pages.where("html IS NOT NULL")
    place = F.xxhash64("page_id", "url")
    share = F.pmod(place, F.lit(1 << 30)) / float(1 << 30)
    few = known.where(share <= 2.0 * sample / max(1, known.count())).select("page_id", "url", "html")
    rows = few.orderBy(share, place).limit(sample).collect()
    records = [record(*r) for r in rows]
    try:
        return zstandard.train_dictionary(size, records, level=3).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, folder: str, dictionary: bytes, level: int = 3) -> DataFrame:
    """Writes an archive for each partition of pages; (archive, records). A file gets its name when it is whole."""
    source = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, place = _open(folder)
        fs.create_dir(place, recursive=True)
        target = f"{place}/part-{context.partitionId():06d}.warc.zst"
        temporary = f"{target}.{context.taskAttemptId()}.tmp"
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        writer, n = zstandard.ZstdCompressor(level=level, dict_data=known), 0
        with fs.open_output_stream(temporary, compression=None) as out:
            if dictionary:
                packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
                out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
            for b in batches:
                for row in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html"))):
                    out.write(writer.compress(record(*row)))
                    n += 1
        fs.move(temporary, target)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/part-{context.partitionId():06d}.warc.zst"]), pa.array([n], pa.int64())], names=["archive", "records"])

    return source.mapInArrow(run, "archive STRING, records BIGINT")


def read_archives(spark: SparkSession, archives: list[str] | DataFrame) -> DataFrame:
    """All records of the archives, an archive a task; memory holds one record and a read-ahead."""
    names = list(archives) if isinstance(archives, list) else None
    if names is not None:
        archives = spark.range(0, len(names), 1, max(1, len(names))).withColumnRenamed("id", "archive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b["archive"].to_pylist():
                name = name if names is None else names[name]
                fs, path = _open(name)
                with fs.open_input_stream(path, compression=None) as stream:
                    held, size = [], 0
                    for row in rows_of(stream, name):
                        held.append(row)
                        size += len(row[5] or "") + 200
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), OUT)], schema=OUT)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), OUT)], schema=OUT)

    return archives.select("archive").mapInArrow(run, SCHEMA)


def op2_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages after a round trip: archived in the shared folder, and read from there."""
    pages = table(spark, sf_dir, "pages")
    folder = scratch(spark, "warc")
    written = write_archives(pages, folder, train_dictionary(pages)).collect()
    found = read_archives(spark, sorted(r["archive"] for r in written))
    return found.select("page_id", "url", "html", "content_length", "valid", F.sha2("html", 256).alias("html_sha256"))


OP2_SQL = """
SELECT page_id, url, html, CAST(strlen(html) AS BIGINT) AS content_length, TRUE AS valid, sha256(html) AS html_sha256 FROM pages
"""
