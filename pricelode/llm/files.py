"""Binary files of tasks in the shared folder, over any store that Arrow can open."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and its place in it. Spark's names for stores differ in places:
    file:/x is file:///x, and s3a is s3."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    if path.startswith(("s3a://", "s3n://")):
        path = "s3://" + path.partition("://")[2]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_file(path: str, data: bytes) -> None:
    """The whole file or none: written beside its place, then renamed."""
    store, place = _at(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    draft = f"{place}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(draft, compression=None) as out:
        out.write(data)
    store.move(draft, place)


def open_file(path: str) -> bytes:
    store, place = _at(path)
    with store.open_input_file(place) as source:
        return source.read()


def read_tables(folder: str, columns: list[str]) -> list[pa.Table]:
    """The Parquet files of a folder; none if it isn't there."""
    store, place = _at(folder)
    found = store.get_file_info(fs.FileSelector(place, allow_not_found=True))
    return [pq.read_table(f.path, columns=columns, filesystem=store, partitioning=None) for f in found if f.base_name.endswith(".parquet")]


def read_range(path: str, offset: int, length: int) -> bytes:
    store, place = _at(path)
    with store.open_input_file(place) as source:
        return source.read_at(length, offset)


def local_path(path: str) -> str | None:
    """The path in this machine's file tree, where the store is one."""
    store, place = _at(path)
    return place if isinstance(store, fs.LocalFileSystem) else None
