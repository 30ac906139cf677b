"""WARC archives of pages, compressed with a Zstandard dictionary that was built from the records themselves.

An archive begins with a skippable frame (magic number 0x184D2A5D) that holds the dictionary; each record is a Zstandard
frame of its own behind it, so that one can be read by its offset. Pages whose payload another page has too are written
as revisits without it.

A task packs the pages that it reads into archives and hands over one row for each, which Spark's text writer puts into
a file as it is, followed by an empty skippable frame that every reader passes over. So archives go to whatever store
the path names, and only those of finished tasks are there. Reading takes one archive at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.session import ship_code
from netloom.sources.archives import end_names
from netloom.storage import Store

#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Records whose heads, of so many bytes at most, train a dictionary of at most so many bytes.
SAMPLE_RECORDS, SAMPLE_HEAD, DICTIONARY_BYTES = 1_000, 16_384, 65_536
#: A table of repeated payloads up to this size goes to all tasks; of a larger one, the payloads that at least one row in
#: so many has, which are no more than that.
COPIES_BYTES, COPIES_SHARE = 32 << 20, 50_000

# Fixed values of the formats.
SKIP_DICTIONARY = (0x184D2A5D).to_bytes(4, "little")
SKIP_NOTHING = (0x184D2A50).to_bytes(4, "little") + bytes(4)
FRAME = (0xFD2FB528).to_bytes(4, "little")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "archive string, offset bigint, length bigint, record_type string, record_id string, page_id string, uri string, payload_bytes bigint, payload_digest string, refers_to string"


def base32_sha1(hexadecimal: str) -> str:
    """A SHA-1 as archives write it."""
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


@dataclass(frozen=True)
class Page:
    """A page to be written; ``refers_to`` is the id of the page that has its payload already, and then it needs none."""

    page_id: str | None
    url: str | None
    sha1: str
    size: int
    payload: bytes | None
    revisit: bool
    refers_to: str | None


def _urn(page_id: str | None, sha1: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id is None}:{page_id}:{sha1}')}"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"".join([b"WARC/1.1\r\n", head.encode(), b"\r\n", block, b"\r\n\r\n"])


def info_record(date: str) -> bytes:
    """The record that an archive begins with."""
    block = b"software: netloom\r\nformat: WARC File Format 1.1\r\n"
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, date)}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], block)


def page_record(page: Page, date: str) -> bytes:
    """A response, or a revisit whose block is the response's head alone."""
    urn, digest = _urn(page.page_id, page.sha1), base32_sha1(page.sha1)
    uri = urn if page.url is None else quote(page.url, safe="!#$%&'()*+,/:;=?@[]~")
    fields = [("WARC-Type", "revisit" if page.revisit else "response"), ("WARC-Record-ID", f"<{urn}>"), ("WARC-Date", date), ("WARC-Target-URI", uri)]
    if page.page_id is not None:
        fields.append(("Page-Id", quote(page.page_id)))
    if page.revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{_urn(page.refers_to, page.sha1)}>")]
        if page.refers_to is not None:
            fields.append(("Refers-To-Page-Id", quote(page.refers_to)))
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page.size}\r\n\r\n".encode()
    block = head if page.revisit else head + (page.payload or b"")
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(hashlib.sha1(block).hexdigest())}"), ("Content-Type", "application/http; msgtype=response")]
    return _record(fields, block)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes | None:
    """A dictionary from records; None where they are too few or too short for one."""
    import zstandard

    size = min(size, sum(map(len, samples)) // 8)
    if len(samples) < 8 or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # no part occurs in several of them
        return None


class Packer:
    """Collects the frames of an archive."""

    def __init__(self, dictionary: bytes | None, date: str, level: int) -> None:
        import zstandard

        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level=level)
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True).compress
        self.lead = b""
        if dictionary:
            packed = min(dictionary, zstandard.ZstdCompressor(level=19).compress(dictionary), key=len)
            self.lead = SKIP_DICTIONARY + len(packed).to_bytes(4, "little") + packed
        self.lead += self.compress(info_record(date))
        self.date = date
        self.begin()

    def begin(self) -> None:
        self.frames, self.size = [self.lead], len(self.lead)

    def add(self, page: Page) -> None:
        self.frames.append(self.compress(page_record(page, self.date)))
        self.size += len(self.frames[-1])

    def end(self) -> bytes:
        """The archive; another one begins."""
        out = b"".join(self.frames)
        self.begin()
        return out


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, from the lengths in its headers."""
    magic = bytes(data[at : at + 4])
    if magic[1:] == SKIP_NOTHING[1:4] and magic[0] & 0xF0 == 0x50:
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    elif magic == FRAME:
        flags = data[at + 4]
        single = flags >> 5 & 1
        size = (1 if single else 0, 2, 4, 8)[flags >> 6]
        end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + size
        last = False
        while not last:
            if end + 3 > len(data):
                raise ValueError("a frame is cut off")
            block = int.from_bytes(data[end : end + 3], "little")
            last = bool(block & 1)
            end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        end += 4 * (flags >> 2 & 1)
    else:
        raise ValueError(f"no frame begins at byte {at}")
    if end > len(data):
        raise ValueError("a frame is cut off")
    return end


def frames_of(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each record of an archive; its dictionary is found where it leads."""
    import zstandard

    view, at, reader = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        end = frame_end(view, at)
        if bytes(view[at : at + 4]) == SKIP_DICTIONARY and at == 0:
            held = bytes(view[at + 8 : end])
            if held[:4] == FRAME:
                held = reader.decompressobj().decompress(held)
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
        elif bytes(view[at : at + 4]) == FRAME:
            yield at, end - at, reader.decompressobj().decompress(view[at:end])
        at = end


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def parse_record(record: bytes) -> tuple:
    """(type, id, page_id, uri, payload_bytes, digest, refers_to, payload) of a record; what it does not have is None.

    A response's payload must have the digest that its head states.
    """
    head, _, rest = record.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a record")
    fields = _fields(head)
    kind, block = fields.get("warc-type"), rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None
    size = None
    if kind == "response":
        size = len(payload)
        if digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
            raise ValueError(f"the payload of {fields.get('warc-record-id')} has another digest than its record states")
    elif kind == "revisit":
        size, payload = int(_fields(http)["content-length"]), None
    else:
        payload = None
    plain = [None if (v := fields.get(k)) is None else unquote(v) for k in ("page-id", "refers-to-page-id")]
    return kind, (fields.get("warc-record-id") or "").strip("<>") or None, plain[0], fields.get("warc-target-uri"), size, digest, plain[1], payload


def with_first_copies(pages: DataFrame, page_id: str, payload: str, min_bytes: int, store: Store) -> DataFrame:
    """``pages`` with ``revisit``, whether a row's payload is that of a smaller id, and ``refers_to``, that id.

    A payload is told by its SHA-256. The smallest id of each repeated payload is found by a partial aggregation; a
    frequent payload takes no task of its own, as its id goes to where the rows are.
    """
    rows = pages.withColumn("key", F.unhex(F.sha2(payload, 256)))
    copies = rows.where(F.octet_length(payload) >= min_bytes).groupBy("key").agg(F.min(page_id).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = store.put(copies.withColumn("copied", F.lit(True)))
    size = copies.agg(F.sum(F.coalesce(F.octet_length(F.col("keep").cast("string")), F.lit(0)) + 64)).head()[0] or 0
    if size <= COPIES_BYTES:
        rows = rows.join(F.broadcast(copies.drop("n")), "key", "left")
    else:
        least = pages.select(F.lit(1)).count() / COPIES_SHARE
        often, rest = copies.where(F.col("n") >= least).drop("n"), copies.where(F.col("n") < least)
        rows = rows.join(F.broadcast(often), "key", "left")
        # Rows that have found their copy go anywhere.
        free = F.when(F.col("copied"), F.unhex(F.sha2(F.coalesce(F.col(page_id).cast("string"), F.lit("")), 256))).otherwise(F.col("key"))
        rest = rest.select(F.col("key").alias("free"), F.col("keep").alias("keep2"), F.col("copied").alias("copied2"))
        rows = rows.withColumn("free", free).join(rest, "free", "left")
        rows = rows.withColumns({"keep": F.when(F.col("copied"), F.col("keep")).otherwise(F.col("keep2")), "copied": F.coalesce("copied", "copied2")})
    revisit = F.coalesce(F.col("copied"), F.lit(False)) & ~F.col(page_id).eqNullSafe(F.col("keep"))
    return rows.withColumn("revisit", revisit).withColumn("refers_to", F.when(F.col("revisit"), F.col("keep")))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> None:
    """Write a record for each row of ``pages`` into ``*.warc.zst`` files of the new folder ``path``.

    The payload is the column in UTF-8; null counts as empty. Of rows with equal payloads of at least ``min_bytes``
    bytes, those with the smallest id are responses and the others revisits of it; null ids come after all others, and
    rows that repeat the smallest id are all responses. Ids may be of any type that casts to text; records keep them
    beside their own, which follows from id and payload, so rows that are the same in both share it. A null ``url`` gives
    a record its own id as address. Other columns are not read, and an empty table leaves an empty folder.

    The dictionary comes from the first ``SAMPLE_HEAD`` bytes of at most ``SAMPLE_RECORDS`` responses, those whose
    payloads have the smallest SHA-256; all records are compressed with it. Tables that are too small for one get
    archives without.
    """
    spark = pages.sparkSession
    ship_code(spark)
    store = Store(spark)
    rows = pages.select(F.col(f"`{page_id}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = with_first_copies(rows, "id", "payload", min_bytes, store)
    sample = rows.where("not revisit").orderBy("key").limit(SAMPLE_RECORDS).select(F.substring("payload", 1, SAMPLE_HEAD).alias("head"))
    dictionary = train_dictionary([bytes(r.head) for r in sample.collect()])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, some = Packer(dictionary, date, level), False
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packer.add(Page(*row))
                some = True
                if packer.size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([packer.end()], pa.binary())], ["archive"])
                    some = False
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([packer.end()], pa.binary())], ["archive"])

    held = rows.select(F.col("id").cast("string").alias("id"), "url", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"), F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "revisit", F.col("refers_to").cast("string").alias("refers_to"))
    archives = held.mapInArrow(pack, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("maxRecordsPerFile", 1).option("lineSep", SKIP_NOTHING.decode("latin-1")).text(path)
    end_names(spark, path, ".warc.zst")
    store.clear()


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives in a folder: where it is, its type, ids, address, payload's size and digest.

    With ``payloads`` the payload of responses comes last. Digests are checked as records are read; a file that is cut
    off or no archive is an error. A task holds one archive, and hands on one record at a time. A folder without
    archives gives no rows.
    """
    ship_code(spark)
    schema = READ_SCHEMA + (", payload binary" if payloads else "")
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [part.split()[0] for part in schema.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for offset, length, record in frames_of(data.as_py()):
                    kind, record_id, page_id, uri, n, digest, refers_to, payload = parse_record(record)
                    rows.append((name.as_py(), offset, length, kind, record_id, page_id, uri, n, digest, refers_to, *([payload] if payloads else [])))
                    size += len(record) if payloads else 400
                    if size > 4 << 20:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return files.select("path", "content").mapInArrow(run, schema)


def index_of(records: DataFrame) -> DataFrame:
    """(page_id, record_type, payload_bytes, payload_digest, refers_to) of the responses and revisits that were read."""
    return records.where("record_type in ('response', 'revisit')").select("page_id", "record_type", "payload_bytes", "payload_digest", "refers_to")
