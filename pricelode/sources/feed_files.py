"""A folder of feeds in different dialects as one table: a Python data source.

Every file is read with its own delimiter, header and byte order mark, in one scan of the folder. Small files share a
partition up to ``PARTITION_BYTES``; a file is read by one task, in order and in batches, since its quoted cells may
hold line breaks. Listing and header checks never read more than the heads of files."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

DELIMITERS = (",", ";", "\t", "|", "~")
PARTITION_BYTES = 64 << 20
BATCH_ROWS = 4096
BATCH_CHARS = 4 << 20
HEAD_LINES = 5
#: The longest cell that is read; the csv module's own limit is 128 KiB.
CELL_CHARS = 2**31 - 1


def best_delimiter(head: list[str]) -> str:
    """The delimiter that the lines have most often outside quotes, and each equally often if possible."""
    bare = [re.sub(r'"[^"]*"', "", line) for line in head]
    counts = {d: [line.count(d) for line in bare] for d in DELIMITERS}
    best = max(DELIMITERS, key=lambda d: (bool(bare) and min(counts[d]) > 0 and len(set(counts[d])) == 1, sum(counts[d])))
    return best if sum(counts[best]) else ","


def _lines(store: pafs.FileSystem, path: str) -> io.TextIOWrapper:
    return io.TextIOWrapper(store.open_input_stream(path), encoding="utf-8-sig", errors="replace", newline="")


def _records(store: pafs.FileSystem, path: str, delimiter: str | None) -> Iterator[list[str]]:
    """Header and rows of a file; blank lines aren't rows."""
    if not delimiter:
        with _lines(store, path) as lines:
            delimiter = best_delimiter(list(islice((x for x in lines if x.strip()), HEAD_LINES)))
    csv.field_size_limit(CELL_CHARS)
    with _lines(store, path) as lines:
        yield from (row for row in csv.reader(lines, delimiter=delimiter) if row)


class Files(InputPartition):
    def __init__(self, paths: Sequence[str]) -> None:
        self.paths = tuple(paths)


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.uri = options["path"]
        self.pattern = options.get("pattern", "")
        self.delimiter = options.get("delimiter")
        self.required = json.loads(options.get("required", "[]"))
        self.columns = [f.name for f in schema.fields[2:]]
        self.names = schema.fieldNames()

    def _store(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.uri)

    def partitions(self) -> Sequence[InputPartition]:
        store, root = self._store()
        root = root.rstrip("/")
        place = store.get_file_info(root)
        if place.type == pafs.FileType.NotFound:
            return [Files([])]
        found = [place] if place.is_file else store.get_file_info(pafs.FileSelector(root, recursive=True))
        hidden = lambda path: any(x[:1] in ("_", ".") for x in path[len(root) :].split("/"))
        files = sorted((f.path, f.size or 0) for f in found if f.is_file and not hidden(f.path) and re.search(self.pattern, f.base_name))
        groups: list[list[str]] = [[]]
        held = 0
        for path, size in files:
            if groups[-1] and held + size > PARTITION_BYTES:
                groups.append([])
                held = 0
            groups[-1].append(path)
            held += size
        return [Files(g) for g in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        for path in partition.paths:
            records = _records(store, path, self.delimiter)
            header = next(records, [])
            at = {name: i for i, name in enumerate(header)}  # of equal names the last
            lacking = [c for c in self.required if c not in at]
            if lacking:
                raise ValueError(f"{path} lacks {', '.join(lacking)}")
            places = [at.get(c) for c in self.columns]
            first, chars, rows = 2, 0, []
            for row in records:
                rows.append([row[i] if i is not None and i < len(row) else "" for i in places])
                chars += sum(map(len, rows[-1]))
                if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield self._batch(path, first, rows)
                    first, chars, rows = first + len(rows), 0, []
            if rows:
                yield self._batch(path, first, rows)

    def _batch(self, path: str, first: int, rows: list[list[str]]) -> pa.RecordBatch:
        cells = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if self.columns else []
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(range(first, first + len(rows)), pa.int64()), *cells], self.names)


class FeedFiles(DataSource):
    """Options: ``path`` (a file, or a folder with all below it), ``columns`` (JSON list), ``required`` (JSON list: a file that lacks one
    fails the read), ``pattern`` (regular expression for file names), ``delimiter`` (for all files; else sniffed for each)."""

    @classmethod
    def name(cls) -> str:
        return "feed_files"

    def schema(self) -> StructType:
        columns = json.loads(self.options["columns"])
        return StructType([StructField("source_file", StringType()), StructField("line_number", LongType()), *(StructField(c, StringType()) for c in columns)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeedReader(dict(self.options), schema)


def read_folder(spark: SparkSession, path: str, columns: list[str], required: Sequence[str] = (), pattern: str = "", delimiter: str | None = None) -> DataFrame:
    """``source_file``, ``line_number`` (the first row is line 2; blank lines don't count) and ``columns`` as text of all files below a
    folder; what a file lacks is ''. Hidden files (``_``, ``.``) are left out; gzip by its ending; a missing or empty folder gives no rows."""
    spark.dataSource.register(FeedFiles)
    options = {"columns": json.dumps(columns), "required": json.dumps(list(required)), "pattern": pattern, **({"delimiter": delimiter} if delimiter else {})}
    return spark.read.format("feed_files").options(**options).load(path)
