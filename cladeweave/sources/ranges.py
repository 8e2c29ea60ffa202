"""Data sources that read sequence and tree files by byte ranges.

``spark.read.format("fasta_ranges")``, ``"tree_ranges"`` and ``"line_ranges"`` cut files of any size into ranges of ``range_bytes``; a record belongs to
the range that its first byte lies in, and a task reads on until its last record ends.  So rows do not depend on where files are cut, and each
has a place that stays: its file and its first byte.  ``"fasta_files"`` gives a row for each range with what is needed to judge a file.

Files are opened with Arrow's file systems (local, ``hdfs``, ``s3``, ``gs``); the driver lists them with one call and reads none.
``register`` makes the formats known to a session.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 << 20
CHUNK = 1 << 20
BATCH_RECORDS, BATCH_BYTES = 1000, 4 << 20


def _opened(path: str):
    from pyarrow import fs

    if re.match("^[a-z][a-z0-9+.-]*:/", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def list_files(path: str) -> list[tuple[str, int]]:
    """``(path, bytes)`` of the files at or below ``path``, in order; names that begin with ``_`` or ``.`` are left out."""
    from pyarrow import fs

    system, at = _opened(path)
    scheme = path[: path.index(":") + 1] + ("//" if "://" in path else "") if re.match("^[a-z][a-z0-9+.-]*:/", path) else ""
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f"{scheme}{x.path}", x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))


@dataclass
class FileRange(InputPartition):
    """Bytes ``begin`` to ``end`` of a file."""

    file: str
    begin: int
    end: int


def line_starts(file: str, begin: int, end: int, mark: bytes) -> Iterator[tuple[int, bytes]]:
    """``(first byte, text)`` of the records that begin in a range: from a line that starts with ``mark`` up to the next such line.

    With an empty ``mark`` every line is a record.  The text before the first mark of a file is no record.
    """
    system, at = _opened(file)
    with system.open_input_file(at) as source:
        source.seek(max(0, begin - 1))
        # The byte before the range tells whether a line starts with it; at the file's start one does.
        held, first = (b"\n" + source.read(CHUNK), begin - 1) if begin == 0 else (source.read(CHUNK), begin - 1)
        sought, opened, over = b"\n" + mark, None, False
        scanned = 0
        while True:
            place = held.find(sought, scanned)
            if place < 0:
                more = source.read(CHUNK)
                over = not more
                if over:
                    break
                if opened is None:
                    drop = max(0, len(held) - len(sought) + 1)
                    held, first = held[drop:], first + drop
                    if first + 1 >= end:
                        return
                    scanned = 0
                else:
                    scanned = max(opened, len(held) - len(sought) + 1)
                held += more
                continue
            if opened is not None:
                yield first + opened, held[opened:place]
            if first + place + 1 >= end:
                return
            held, first = held[place + 1 :], first + place + 1
            opened = scanned = 0
        if opened is not None and len(held) > opened:
            yield first + opened, held[opened:]


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[FileRange]:
        return [FileRange(f, lo, min(lo + self.bytes, size)) for f, size in list_files(self.path) for lo in range(0, max(size, 1), self.bytes)]

    def rows(self, part: FileRange) -> Iterator[tuple]:
        raise NotImplementedError

    columns: pa.Schema

    def read(self, part: FileRange) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in self.rows(part):
            held.append(row)
            size += sum(len(x) for x in row if isinstance(x, str))
            if len(held) >= BATCH_RECORDS or size >= BATCH_BYTES:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.columns, strict=True)], schema=self.columns)


class _FastaReader(_RangeReader):
    columns = pa.schema([("file", pa.string()), ("at", pa.int64()), ("name", pa.string()), ("seq", pa.string())])

    def rows(self, part: FileRange) -> Iterator[tuple]:
        for at, text in line_starts(part.file, part.begin, part.end, b">"):
            head, _, body = text.decode(errors="replace").partition("\n")
            yield part.file, at, head[1:].strip(), re.sub(r"\s+", "", body)


class FastaRanges(DataSource):
    """``file, at, name, seq``: a row for each record; ``at`` is its first byte."""

    @classmethod
    def name(cls) -> str:
        return "fasta_ranges"

    def schema(self) -> str:
        return "file string, at bigint, name string, seq string"

    def reader(self, schema) -> DataSourceReader:
        return _FastaReader(self.options)


class _FastaFileReader(_RangeReader):
    columns = pa.schema([("file", pa.string()), ("begin", pa.int64()), ("n_records", pa.int64()), ("stray", pa.bool_())])

    def rows(self, part: FileRange) -> Iterator[tuple]:
        n = sum(1 for _ in line_starts(part.file, part.begin, part.end, b">"))
        stray = False
        if part.begin == 0:  # text before the first record
            for _, line in line_starts(part.file, 0, part.end, b""):
                if line.strip():
                    stray = not line.startswith(b">")
                    break
        yield part.file, part.begin, n, stray


class FastaFiles(DataSource):
    """``file, begin, n_records, stray``: a row for each range; ``stray`` says that the file begins with text that is no record."""

    @classmethod
    def name(cls) -> str:
        return "fasta_files"

    def schema(self) -> str:
        return "file string, begin bigint, n_records bigint, stray boolean"

    def reader(self, schema) -> DataSourceReader:
        return _FastaFileReader(self.options)


class _TreeReader(_RangeReader):
    columns = pa.schema([("file", pa.string()), ("at", pa.int64()), ("newick", pa.string())])
    line = re.compile(r"(?i)^u?tree\s+[^=]+=\s*(?:\[[^\]]*\]\s*)*(\(.*)$")

    def rows(self, part: FileRange) -> Iterator[tuple]:
        for at, text in line_starts(part.file, part.begin, part.end, b""):
            value = text.decode(errors="replace").strip()
            found = self.line.match(value)
            if value.startswith("(") or found:
                yield part.file, at, found[1] if found else value


class TreeRanges(DataSource):
    """``file, at, newick``: a row for each line of a Newick or NEXUS file that is a tree."""

    @classmethod
    def name(cls) -> str:
        return "tree_ranges"

    def schema(self) -> str:
        return "file string, at bigint, newick string"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


class _LineReader(_RangeReader):
    columns = pa.schema([("file", pa.string()), ("at", pa.int64()), ("value", pa.string())])

    def rows(self, part: FileRange) -> Iterator[tuple]:
        for at, text in line_starts(part.file, part.begin, part.end, b""):
            yield part.file, at, text.decode(errors="replace").rstrip("\r\n")


class LineRanges(DataSource):
    """``file, at, value``: a row for each line; ``at`` is its first byte."""

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return "file string, at bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (FastaRanges, FastaFiles, TreeRanges, LineRanges):
        spark.dataSource.register(source)


def read_fasta_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file, at, marker, name, seq`` of all FASTA files at or below a path."""
    from cladeweave.functions import names

    register(spark)
    rows = spark.read.format("fasta_ranges").option("range_bytes", range_bytes).load(path)
    return rows.select("file", "at", names.strip_marker_prefix(F.col("file")).alias("marker"), "name", "seq")


def fasta_file_status(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file, n_records, status`` of every file: OK, EMPTY (no record and no text) or NOT_FASTA (text before the first record)."""
    register(spark)
    ranges = spark.read.format("fasta_files").option("range_bytes", range_bytes).load(path)
    per = ranges.groupBy("file").agg(F.sum("n_records").alias("n"), F.max("stray").alias("stray"))
    status = F.when(F.col("stray"), "NOT_FASTA").when(F.col("n") == 0, "EMPTY").otherwise("OK")
    return per.select("file", F.when(status == "OK", F.col("n")).otherwise(0).alias("n_records"), status.alias("status"))


def read_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file, at, value`` of all lines of text files at or below a path."""
    register(spark)
    return spark.read.format("line_ranges").option("range_bytes", range_bytes).load(path)


def read_tree_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``tree_id, newick`` of all tree files at or below a path; a tree is named by its file and first byte."""
    register(spark)
    rows = spark.read.format("tree_ranges").option("range_bytes", range_bytes).load(path)
    return rows.select(F.concat_ws(":", F.element_at(F.split("file", "/"), -1), F.col("at").cast("string")).alias("tree_id"), "newick")
