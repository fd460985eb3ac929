"""A data source of NumPy archives: X_train, y_train, X_test and y_test of npz files, by ranges of rows.

The directory of each archive and the headers of its arrays are read once, at planning. Rows of a stored (not
compressed) array have fixed places, so a partition is a range of them of about ``RANGE`` bytes, read at its offset, a
few megabytes at a time; a compressed array is one partition, streamed. A read that fails opens the file again, ``TRIES``
times, and goes on from its row.
"""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of rows in a partition, and read at a time; attempts to read.
RANGE, CHUNK, TRIES = 16 << 20, 4 << 20, 3
SCHEMA = "file string, part string, row bigint, features array<double>, label bigint"
_ARROW = pa.schema([("file", pa.string()), ("part", pa.string()), ("row", pa.int64()), ("features", pa.list_(pa.float64())), ("label", pa.int64())])


def opened(path: str):
    """A file of any store that pyarrow knows, for reading at random places."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner)


@dataclass
class Member:
    """An array in an archive: where its values begin (-1 where they are compressed), its shape and type."""

    name: str
    offset: int
    shape: tuple[int, ...]
    dtype: str

    @property
    def row_bytes(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64)) * np.dtype(self.dtype).itemsize


def members(handle, archive: zipfile.ZipFile) -> dict[str, Member]:
    """The arrays of an archive by name; those in Fortran order or of objects are refused."""
    out = {}
    for info in archive.infolist():
        if not info.filename.endswith(".npy"):
            continue
        with archive.open(info) as f:
            version = np.lib.format.read_magic(f)
            shape, fortran, dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
            header = f.tell()
        if (fortran and len(shape) > 1) or dtype.hasobject:
            raise ValueError(f"{info.filename} cannot be read by rows")
        handle.seek(info.header_offset)
        names = struct.unpack("<HH", handle.read(30)[26:30])
        begin = info.header_offset + 30 + sum(names) + header
        out[info.filename[:-4]] = Member(info.filename, begin if info.compress_type == zipfile.ZIP_STORED else -1, shape, dtype.str)
    return out


@dataclass
class Rows(InputPartition):
    """Rows first to last (exclusive) of the arrays x and y of a part of an archive."""

    path: str
    part: str
    x: Member
    y: Member
    first: int
    last: int


class _Stream:
    """Values of a member from a row on, in order."""

    def __init__(self, path: str, member: Member, first: int) -> None:
        self.member, self.handle = member, opened(path)
        if member.offset >= 0:
            self.file = self.handle
            self.file.seek(member.offset + first * member.row_bytes)
            return
        self.file = zipfile.ZipFile(self.handle).open(member.name)
        version = np.lib.format.read_magic(self.file)
        (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(self.file)
        self._skip(first * member.row_bytes)

    def _skip(self, n: int) -> None:
        while n:
            got = len(self.file.read(min(n, CHUNK)))
            if not got:
                raise OSError(f"{self.member.name} ends too soon")
            n -= got

    def rows(self, n: int) -> np.ndarray:
        size, parts = n * self.member.row_bytes, []
        while size:
            part = self.file.read(size)
            if not part:
                raise OSError(f"{self.member.name} ends too soon")
            parts.append(part)
            size -= len(part)
        return np.frombuffer(b"".join(parts), self.member.dtype).reshape(n, -1)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = options["paths"].split("\n")
        self.range = int(options.get("range", RANGE))

    def partitions(self) -> list[Rows]:
        out = []
        for path in self.paths:
            with opened(path) as handle, zipfile.ZipFile(handle) as archive:
                held = members(handle, archive)
            for part in ("train", "test"):
                x, y = held.get(f"X_{part}"), held.get(f"y_{part}")
                if x is None:
                    continue
                if y is None or y.shape[0] != x.shape[0]:
                    raise ValueError(f"{path}: X_{part} and y_{part} differ in length")
                step = max(1, self.range // max(1, x.row_bytes)) if x.offset >= 0 and y.offset >= 0 else max(1, x.shape[0])
                out += [Rows(path, part, x, y, a, min(a + step, x.shape[0])) for a in range(0, x.shape[0], step)]
        return out or [Rows("", "", Member("", 0, (0,), "<f8"), Member("", 0, (0,), "<f8"), 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        at, tries = partition.first, 0
        step = max(1, CHUNK // max(1, partition.x.row_bytes))
        x = y = None
        while at < partition.last:
            n = min(step, partition.last - at)
            try:
                if x is None:
                    x, y = (_Stream(partition.path, m, at) for m in (partition.x, partition.y))
                features, labels = x.rows(n).astype(float), y.rows(n)[:, 0]
            except OSError:
                tries += 1
                if tries >= TRIES:
                    raise
                x = y = None
                continue
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * features.shape[1]), pa.array(features.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array([partition.part] * n), pa.array(np.arange(at, at + n)), flat, pa.array(labels.astype(np.int64))], schema=_ARROW)
            at, tries = at + n, 0


class ArraySource(DataSource):
    """Format ``npz_rows``; option paths: files, a line each; range: bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "npz_rows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))
