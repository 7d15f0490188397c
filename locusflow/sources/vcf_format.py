"""VCF as a Spark data source: spark.read.format("vcf"), split by bytes, bgzip files as well.

A bgzip file is a row of gzip members of at most 64 KB that say how long they are. Each partition
looks for the first member that begins in its range of bytes, so that one compressed file goes to
many tasks, without reading the file beforehand. A line belongs to the range that its first byte
lies in; one that begins just at a range's end belongs to that range. Plain files are split by
bytes as well; other gzip files have one partition.

Columns are those of SCHEMA, or of them what spark.read.schema(...) asks for: calls aren't cut up
unless they are read. part and nth are the number of a partition, in the order of files by
name and of bytes, and a record's number within it. Header lines and blank ones are left out.

Files are opened with pyarrow.fs: local paths, and what it has URIs for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..shipping import ship_package

SCHEMA = "part int, nth long, chrom string, pos long, id string, ref string, alt string, qual double, filter string, info string, format string, calls array<string>"
KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
TYPES = {c.split()[0]: KINDS[c.split()[1]] for c in SCHEMA.split(", ")}
#: Where each column stands in a record.
FIELDS = {"chrom": 0, "pos": 1, "id": 2, "ref": 3, "alt": 4, "qual": 5, "filter": 6, "info": 7, "format": 8}
#: Bytes of a partition, and read at once; records of a batch.
SPLIT_BYTES, READ_BYTES, BATCH = 32 * 1024 * 1024, 1024 * 1024, 2_048
#: A member's first bytes when it has an extra field, and the longest that a member can be.
MAGIC, LONGEST = b"\x1f\x8b\x08\x04", 65_536


def member_size(data: bytes, at: int) -> int | None:
    """Bytes of the member that begins at a place, if its header says so."""
    if data[at : at + 4] != MAGIC or len(data) < at + 18:
        return None
    end = at + 12 + int.from_bytes(data[at + 10 : at + 12], "little")
    at += 12
    while at + 4 <= min(end, len(data)):
        length = int.from_bytes(data[at + 2 : at + 4], "little")
        if data[at : at + 2] == b"BC" and length == 2:
            return int.from_bytes(data[at + 4 : at + 6], "little") + 1
        at += 4 + length
    return None


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


@dataclass
class VcfPart(InputPartition):
    """The bytes of a file that one task reads the lines of."""

    number: int
    path: str
    kind: str
    start: int
    end: int


def _members(stream, part: VcfPart) -> Iterator[tuple[bytes, bool]]:
    """Text of the members from the range's first one on, and whether they begin in the range."""
    at = part.start
    stream.seek(at)
    held = stream.read(2 * LONGEST + 18)
    if at:
        skipped = held.find(MAGIC)
        while skipped >= 0:  # bytes that look like a header are one if the next member follows
            size = member_size(held, skipped)
            if size and (member_size(held, skipped + size) or len(held) <= skipped + size):
                break
            skipped = held.find(MAGIC, skipped + 1)
        if skipped < 0 or at + skipped >= part.end:
            return
        held, at = held[skipped:], at + skipped
    while held:
        size = member_size(held, 0)
        if size is None or size > len(held):
            more = stream.read(READ_BYTES)
            if not more:
                raise ValueError(f"{part.path} ends within a compressed block")
            held += more
            continue
        used = 0
        while size is not None and used + size <= len(held):
            yield zlib.decompress(held[used : used + size], 31), at < part.end
            used, at = used + size, at + size
            size = member_size(held, used)
        held = held[used:] or stream.read(READ_BYTES)


def _bytes(stream, part: VcfPart) -> Iterator[tuple[bytes, bool]]:
    stream.seek(part.start)
    at = part.start
    while data := stream.read(min(READ_BYTES, part.end - at) if at < part.end else READ_BYTES):
        yield data, at < part.end
        at += len(data)


def _unzipped(stream, part: VcfPart) -> Iterator[tuple[bytes, bool]]:
    machine = zlib.decompressobj(31)
    while data := stream.read(READ_BYTES):
        while data:
            yield machine.decompress(data), True
            data = machine.unused_data
            if machine.eof:
                machine = zlib.decompressobj(31)


def owned_lines(chunks: Iterator[tuple[bytes, bool]], first: bool) -> Iterator[list[bytes]]:
    """Lines that begin in the range: chunks are its bytes, then, marked so, those that follow it."""
    rest, skipping = b"", not first
    for data, inside in chunks:
        if skipping:
            end = data.find(b"\n")
            if end < 0:
                continue
            if not inside:
                return
            data, skipping = data[end + 1 :], False
        if inside:
            *lines, rest = (rest + data).split(b"\n")
            yield lines
            continue
        end = data.find(b"\n")
        if end >= 0:
            yield [rest + data[:end]]
            return
        rest += data
    if rest:
        yield [rest]


class VcfReader(DataSourceReader):
    def __init__(self, schema: StructType, options) -> None:
        self.columns = [f.name for f in schema.fields]
        unknown = [c for c in self.columns if c not in TYPES]
        if unknown:
            raise ValueError(f"a VCF file has no columns {unknown}")
        self.path, self.split_bytes = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> Sequence[InputPartition]:
        store, path = open_store(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.Directory:
            held = [x for x in store.get_file_info(fs.FileSelector(path)) if x.is_file and x.size and not x.base_name.startswith(("_", "."))]
            files = sorted(held, key=lambda x: x.path)
        elif info.type == fs.FileType.File:
            files = [info]
        else:
            raise FileNotFoundError(self.path)
        parts: list[VcfPart] = []
        for x in files:
            with store.open_input_file(x.path) as stream:
                head = stream.read(18)
            kind = "plain" if head[:2] != b"\x1f\x8b" else "bgzip" if member_size(head, 0) else "gzip"
            step = x.size if kind == "gzip" else self.split_bytes
            for start in range(0, x.size, max(1, step)):
                parts.append(VcfPart(len(parts), x.path, kind, start, min(start + step, x.size)))
        return parts

    def read(self, part: VcfPart) -> Iterator[pa.RecordBatch]:
        store = open_store(self.path)[0]
        with store.open_input_file(part.path) as stream:
            chunks = {"plain": _bytes, "bgzip": _members, "gzip": _unzipped}[part.kind](stream, part)
            nth, held = 0, []
            for lines in owned_lines(chunks, part.start == 0):
                held += [line for line in lines if line.strip() and not line.startswith(b"#")]
                while len(held) >= BATCH:
                    yield self._batch(part.number, nth, held[:BATCH])
                    nth, held = nth + BATCH, held[BATCH:]
            if held:
                yield self._batch(part.number, nth, held)

    def _batch(self, part: int, nth: int, lines: list[bytes]) -> pa.RecordBatch:
        n, wanted = len(lines), set(self.columns)
        most = -1 if "calls" in wanted else max((FIELDS[c] for c in wanted if c in FIELDS), default=-1) + 1
        cut = [line.rstrip().decode().split("\t", most) for line in lines] if most else []
        made = {"part": lambda: [part] * n, "nth": lambda: range(nth, nth + n), "calls": lambda: [f[9:] for f in cut], "pos": lambda: [int(f[1]) for f in cut]}
        made["qual"] = lambda: [None if f[5] == "." else float(f[5]) for f in cut]
        plain = lambda c: (lambda: [f[FIELDS[c]] if FIELDS[c] < len(f) else None for f in cut])
        return pa.RecordBatch.from_arrays([pa.array(made.get(c, plain(c) if c in FIELDS else None)(), TYPES[c]) for c in self.columns], self.columns)


class VcfDataSource(DataSource):
    """option splitBytes: compressed or plain bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "vcf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> VcfReader:
        return VcfReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make format("vcf") known to the session."""
    ship_package(spark)
    spark.dataSource.register(VcfDataSource)


#: The empty member that closes a bgzip file: a fixed value of the format.
CLOSING = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def member(text: bytes) -> bytes:
    """text, of less than 64 KB, as one compressed block."""
    machine = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = machine.compress(text) + machine.flush()
    size = len(data) + 25  # header of 18 bytes and end of 8, less one
    head = MAGIC + bytes(5) + b"\xff" + b"\x06\x00BC\x02\x00" + size.to_bytes(2, "little")
    return head + data + zlib.crc32(text).to_bytes(4, "little") + len(text).to_bytes(4, "little")


def write_bgzip(lines: DataFrame, path: str, block_bytes: int = 60_000) -> None:
    """Lines (value) as a folder of bgzip files, one a partition, in any folder that pyarrow can write."""
    if not 0 < block_bytes <= 65_000:
        raise ValueError("a block holds less than 64 KB")
    ship_package(lines.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(path)
        store.create_dir(folder)
        name = f"part-{TaskContext.get().partitionId():05d}.vcf.gz"
        held, n = b"", 0
        # an attempt that fails leaves nothing under the name; a second one replaces it
        with store.open_output_stream(f"{folder}/_{name}-{TaskContext.get().taskAttemptId()}", compression=None) as out:
            for batch in batches:
                for line in batch.column("value").to_pylist():
                    held, n = held + line.encode() + b"\n", n + 1
                    while len(held) >= block_bytes:
                        out.write(member(held[:block_bytes]))
                        held = held[block_bytes:]
            out.write((member(held) if held else b"") + CLOSING)
        store.move(f"{folder}/_{name}-{TaskContext.get().taskAttemptId()}", f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    lines.select("value").mapInArrow(write, "n long").agg(F.sum("n")).collect()
