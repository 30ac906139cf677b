"""Files inside zip archives, read and written by tasks.

Reading is a Spark data source: a partition is an archive and a stretch of its entries, so that a large archive is read
by many tasks. A task looks up the archive's directory, which stands at its end, and reads its own entries alone. Spark
lists the archives; tasks open them through the filesystems that pyarrow has (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from netloom.session import ship_code

SCHEMA = "archive string, entry string, content binary"
#: Compressed bytes of an archive that one more task is worth; bytes of entries that a task hands on together.
BYTES_PER_TASK, BATCH_BYTES = 32 << 20, 4 << 20
#: Bytes of an archive that a task reads ahead, and entries of an archive that is written; the plain format counts to 65,535.
AHEAD, ENTRIES = 1 << 20, 60_000


class EntryPartition(InputPartition):
    """The stretch ``turn`` of the entries of an archive in ``turns`` stretches."""

    def __init__(self, archive: str, turn: int, turns: int) -> None:
        self.archive, self.turn, self.turns = archive, turn, turns


def open_file(path: str) -> pa.NativeFile:
    """A file that can be read from any place of it."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


class EntryReader(DataSourceReader):
    """Reads the entries with an ending."""

    def __init__(self, archives: Sequence[tuple[str, int]], suffix: str) -> None:
        self.archives, self.suffix = archives, suffix

    def partitions(self) -> list[EntryPartition]:
        return [EntryPartition(path, turn, turns) for path, turns in self.archives for turn in range(turns)]

    def read(self, partition: EntryPartition) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        with open_file(partition.archive) as file, zipfile.ZipFile(io.BufferedReader(file, AHEAD)) as z:
            names = [x for x in z.infolist() if not x.is_dir() and x.filename.endswith(self.suffix)]
            for entry in names[len(names) * partition.turn // partition.turns : len(names) * (partition.turn + 1) // partition.turns]:
                rows.append((partition.archive, entry.filename, z.read(entry)))
                size += entry.file_size
                if size > BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str, str, bytes]]) -> pa.RecordBatch:
    archive, entry, content = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(archive), pa.array(entry), pa.array(content, pa.binary())], ["archive", "entry", "content"])


class ZipEntries(DataSource):
    """The format ``zip_entries``; its options name the archives, with the tasks for each, and the ending of entries."""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> EntryReader:
        lines = [x.rpartition("\t") for x in self.options.get("archives", "").split("\n") if x]
        return EntryReader([(path, int(turns)) for path, _, turns in lines], self.options.get("suffix", ""))


def zip_entries(spark: SparkSession, path: str, suffix: str = "", bytes_per_task: int = BYTES_PER_TASK) -> DataFrame:
    """(archive, entry, content) of each file with an ending in the ``*.zip`` archives of a folder, or in one archive.

    The driver learns the archives' names and lengths and nothing of what is in them. A damaged archive is an error.
    """
    ship_code(spark)
    spark.dataSource.register(ZipEntries)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "length").collect()
    archives = "\n".join(f"{r.path}\t{max(1, -(-r.length // bytes_per_task))}" for r in sorted(files))
    return spark.read.format("zip_entries").option("archives", archives).option("suffix", suffix).load()


def _entry(name: str, data: bytes, offset: int) -> tuple[bytes, bytes]:
    """An entry at a place of an archive, compressed where that makes it shorter, and its line in the directory."""
    deflate = zlib.compressobj(wbits=-15)
    short = deflate.compress(data) + deflate.flush() if len(data) > 32 else data
    method, body = (zipfile.ZIP_DEFLATED, short) if len(short) < len(data) else (zipfile.ZIP_STORED, data)
    called = name.encode()
    # Version 2.0, names in UTF-8, the first day that the format knows.
    known = struct.pack("<5H3L2H", 20, 0x800, method, 0, 33, zlib.crc32(data), len(body), len(data), len(called), 0)
    return b"".join((b"PK\3\4", known, called, body)), b"".join((b"PK\1\2\x14\0", known, struct.pack("<3H2L", 0, 0, 0, 0, offset), called))


def write_zips(files: DataFrame, path: str, name: str = "entry", content: str = "content", archive_bytes: int = BYTES_PER_TASK) -> None:
    """Write (name, content) rows into ``*.zip`` archives of the new folder ``path``, as each task has them.

    A task packs archives of about ``archive_bytes`` of content and hands each over as one row, which Spark's text writer
    puts into a file; the archive's comment is the end of the line that the writer adds. Null content counts as empty.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, listed, size = bytearray(), [], 0

        def end() -> pa.RecordBatch:
            directory = b"".join(listed)
            closing = struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, len(listed), len(listed), len(directory), len(held), 1)
            return pa.RecordBatch.from_arrays([pa.array([b"".join((held, directory, closing))], pa.binary())], ["archive"])

        for batch in batches:
            for entry, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                local, central = _entry(entry, data or b"", len(held))
                held += local
                listed.append(central)
                size += len(data or b"")
                if size >= archive_bytes or len(listed) >= ENTRIES:
                    yield end()
                    held, listed, size = bytearray(), [], 0
        if listed:
            yield end()

    ship_code(files.sparkSession)
    rows = files.selectExpr(f"cast(`{name}` as string)", f"cast(`{content}` as binary)").mapInArrow(pack, "archive binary")
    rows.selectExpr("cast(archive as string) as value").write.option("maxRecordsPerFile", 1).text(path)
    end_names(files.sparkSession, path, ".zip")


def end_names(spark: SparkSession, path: str, ending: str) -> None:
    """Give the files that a writer left in a folder another ending."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-"):
            files.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name.rpartition(".")[0] + ending))
