"""Reading: files or octets to the ``sections`` relation.

Two ways in. ``read_sections`` starts from Spark's own ``binaryFile`` source (or any DataFrame with a binary column), so
that every store Spark reads will do, and scans in Arrow batches. The data source ``grib2`` opens files by seeking, one
partition for each file, and never reads the data sections unless asked; it takes ``spark.read.format("grib2")``.

Sections: path, pos (place in the file, from 0), msg, num, offset, size, template_num, payload (with the section's
header), error. ``mode`` is ``FAILFAST`` (what is wrong raises) or ``PERMISSIVE`` (the sections before it stay, and a row
with ``num`` null says what is wrong).
"""

from __future__ import annotations

import gzip
import io
import lzma
from collections.abc import Iterator
from fnmatch import fnmatchcase
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import ParseError
from .scan import PAYLOADS, message_ranges, scan

SCHEMA = "path string, pos int, msg int, num short, offset long, size long, template_num int, payload binary, error string"
ARROW = pa.schema([("path", pa.string()), ("pos", pa.int32()), ("msg", pa.int32()), ("num", pa.int16()), ("offset", pa.int64()), ("size", pa.int64()), ("template_num", pa.int32()), ("payload", pa.binary()), ("error", pa.string())])
ROWS, OCTETS = 4096, 32 << 20


def inflate(path: str, data: bytes) -> bytes:
    """Octets of a file that may be packed with gzip or xz."""
    if path.endswith(".gz") or data[:2] == b"\x1f\x8b":
        return gzip.decompress(data)
    return lzma.decompress(data) if path.endswith(".xz") or data[:6] == b"\xfd7zXZ\0" else data


def rows_of(path: str, file, size: int, payload: str, mode: str, at: int = 0, msg: int = 0) -> Iterator[tuple]:
    pos = 0
    try:
        for s in scan(file, size, payload, at, msg):
            yield path, pos, s.msg, s.num, s.offset, s.size, s.template_num, s.payload, None
            pos += 1
    except ParseError as e:
        if mode == "FAILFAST":
            raise
        yield path, pos, None, None, None, None, None, None, str(e)


def scan_binary(files: DataFrame, payload: str = "meta", mode: str = "FAILFAST") -> DataFrame:
    """``sections`` of a DataFrame (path, content); null or empty content has none."""
    return scan_files(files.select("path", "content"), payload, mode)


#: What a submessage is made of, as ``relations.submessages`` has it, and where its bitmap and data are.
SUBS = "path string, msg int, sub int, " + "".join(f"s{k} int, " for k in range(9)) + "".join(f"p{k} binary, " for k in range(8)) + "s6_offset long, s6_size long, s7_offset long, s7_size long"
SUBS_ARROW = pa.schema(
    [("path", pa.string()), ("msg", pa.int32()), ("sub", pa.int32()), *[(f"s{k}", pa.int32()) for k in range(9)], *[(f"p{k}", pa.binary()) for k in range(8)], *[(c, pa.int64()) for c in ("s6_offset", "s6_size", "s7_offset", "s7_size")]]
)


def submessages_of(rows: Iterator[tuple]) -> Iterator[tuple]:
    """A row for each Section 7 of a file's sections, in their order: what comes before it carries forward within its message."""
    now, held = None, None
    for path, pos, msg, num, offset, size, _, payload, _ in rows:
        if num is None:
            continue
        if msg != now:
            now, places, payloads, sub, bitmap = msg, [None] * 7, [None] * 7, 0, (None, None)
        if held:
            yield (*held[0], pos if num == 8 and msg == held[0][1] else 0, *held[1])
            held = None
        if num < 7:
            places[num], payloads[num] = pos, payload
            if num == 6:
                bitmap = (offset, size)
        elif num == 7:
            held = (path, msg, sub, *places, pos), (*payloads, payload, *bitmap, offset, size)
            sub += 1
    if held:
        yield (*held[0], 0, *held[1])


def packed_rows(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded rows and octets."""
    held, octets = [], 0
    for r in rows:
        held.append(r)
        octets += sum(len(x) for x in r if isinstance(x, bytes))
        if len(held) >= ROWS or octets >= OCTETS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, octets = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def opened(path: str):
    """A seekable file by its path as Spark names it, and its size; packed ones are unpacked."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, place = fs.FileSystem.from_uri(quote(path, safe="/:@[]")) if "://" in path else (fs.LocalFileSystem(), path)
    file = system.open_input_file(place)
    head = file.read(6)
    file.seek(0)
    if path.endswith((".gz", ".xz")) or head[:2] == b"\x1f\x8b" or head == b"\xfd7zXZ\0":
        data = inflate(path, file.read())
        file.close()
        return io.BytesIO(data), len(data)
    return file, file.size()


def each_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, object, int]]:
    """(path, file, size) of rows (path, content) or, to be opened and read by seeking, (path)."""
    for b in batches:
        contents = b.column("content") if "content" in b.schema.names else [None] * b.num_rows
        for path, content in zip(b.column("path").to_pylist(), contents, strict=True):
            if "content" in b.schema.names:
                data = inflate(path or "", content.as_py() or b"")
                yield path, io.BytesIO(data), len(data)
            else:
                file, size = opened(path)
                with file:
                    yield path, file, size


def scan_files(files: DataFrame, payload: str = "meta", mode: str = "FAILFAST") -> DataFrame:
    """``sections`` of files (path, content), or (path) to be opened."""
    if payload not in PAYLOADS:
        raise ValueError(f"payload must be one of {PAYLOADS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, file, size in each_file(batches):
            yield from packed_rows(rows_of(path, file, size, payload, mode), ARROW)

    return files.mapInArrow(run, SCHEMA)


def scan_submessages(files: DataFrame, payload: str = "meta", mode: str = "FAILFAST") -> DataFrame:
    """Submessages with their octets (``SUBS``), put together by the task that reads the file: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, file, size in each_file(batches):
            yield from packed_rows(submessages_of(rows_of(path, file, size, payload, mode)), SUBS_ARROW)

    return files.mapInArrow(run, SUBS)


def with_data(subs: DataFrame) -> DataFrame:
    """Submessages of opened files that survived a filter, with the octets of Sections 6 and 7 read by their places (A10)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            now, file = None, None
            for i in range(b.num_rows):
                r = b.slice(i, 1)
                row = r.to_pylist()[0]
                if row["path"] != now:
                    if file:
                        file.close()
                    now, file = row["path"], opened(row["path"])[0]
                for k in (6, 7):
                    data = None
                    if row[f"s{k}_offset"] is not None:
                        file.seek(row[f"s{k}_offset"])
                        data = file.read(row[f"s{k}_size"])
                    r = r.set_column(r.schema.get_field_index(f"p{k}"), f"p{k}", pa.array([data], pa.binary()))
                yield r
            if file:
                file.close()

    return subs.mapInArrow(run, subs.schema)


def read_sections(spark: SparkSession, paths: str | list[str], payload: str = "meta", mode: str = "FAILFAST") -> DataFrame:
    return scan_binary(spark.read.format("binaryFile").load(paths), payload, mode)


class GribFiles(DataSource):
    """``spark.read.format("grib2").option("payload", "none|meta|all").option("mode", ...).load(path)``.

    With ``.option("split", octets)`` files are cut between messages into runs of about that size, one task each; ``pos``
    then counts within a run, and ``numbered`` makes it count within the file again.
    """

    @classmethod
    def name(cls) -> str:
        return "grib2"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GribReader(dict(self.options))


def matches(path: list[str], pattern: list[str]) -> bool:
    """Whether the names of a path are those of a pattern, one by one."""
    return len(path) == len(pattern) and all(map(fnmatchcase, path, pattern))


class GribReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload, self.mode, self.split = options.get("payload", "meta"), options.get("mode", "FAILFAST"), int(options.get("split", 0))

    @staticmethod
    def opened(path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = self.opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound and any(c in path for c in "*?["):  # a pattern: what lies below the last plain folder
            parts = path.split("/")
            plain = next(i for i, p in enumerate(parts) if any(c in p for c in "*?["))
            below = system.get_file_info(fs.FileSelector("/".join(parts[:plain]) or "/", recursive=True, allow_not_found=True))
            found = sorted((f for f in below if f.is_file and matches(f.path.split("/"), parts)), key=lambda f: f.path)
            if not found:
                raise FileNotFoundError(self.path)
        elif info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        else:
            found = [info] if info.is_file else sorted((f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file), key=lambda f: f.path)
        out = []
        for f in found:
            if self.split and f.size > self.split and not f.path.endswith((".gz", ".xz")):
                with system.open_input_file(f.path) as file:
                    out += [InputPartition((f.path, end, start, msg)) for start, end, msg in message_ranges(file, f.size, self.split)]
            else:
                out.append(InputPartition((f.path, f.size, 0, 0)))
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, size, at, msg = partition.value
        system, _ = self.opened(self.path)
        with system.open_input_file(path) as file:
            head = file.read(6)
            file.seek(0)
            if path.endswith((".gz", ".xz")) or head[:2] == b"\x1f\x8b" or head == b"\xfd7zXZ\0":
                data = inflate(path, file.read())
                yield from packed_rows(rows_of(path, io.BytesIO(data), len(data), self.payload, self.mode), ARROW)
            else:
                yield from packed_rows(rows_of(path, file, size, self.payload, self.mode, at, msg), ARROW)


def numbered(sections: DataFrame) -> DataFrame:
    """``pos`` of sections that were read in runs: their order within the file."""
    return sections.withColumn("pos", (F.row_number().over(Window.partitionBy("path").orderBy("offset")) - 1).cast("int"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GribFiles)


def with_payload(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Octets of sections read again by place (A10), for rows that survived a filter: (path, offset, size) into ``files`` (path, content)."""
    return rows.drop("payload").join(files.select("path", "content"), "path").withColumn("payload", F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.col("size").cast("int"))).drop("content")
