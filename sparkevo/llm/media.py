"""Media columns: payloads kept as 8-bit images in archives, read through a data source of byte ranges.

Writing: tasks turn payloads into grey PNG images (lossless, compressed) and append them to ZIP archives in a
folder all executors share. An archive has about ``ARCHIVE`` bytes, or up to ``MOST_ARCHIVE`` where the input's files
would else fill more than ``ARCHIVES`` of them; one archive is held in memory. An archive is named by its partition and number and
appears by a rename when it is complete, so a task that runs again puts the same archive in the same place.

Reading: the data source ``sparkevo_media`` plans partitions from the folder's list of files alone, as byte
ranges of archives: parts of one archive, or, where these would be more than ``PARTITIONS``, whole archives in a row
up to the size that keeps to that number. A task reads the directory at the end of its archive, takes the members that begin in its
range, reads them through one handle in runs of about ``BATCH`` bytes and streams their payloads as Arrow batches. A
member that fails is read again by itself at its offset, through a new file handle, up to ``retries`` times, and so is
the directory; what fails then still fails the task, with the archive and offset in the error.

Archives go through pyarrow's file systems, so the folder may be on any store that has one. Defined cases: a
null text is the empty payload, padded like any other; a null doc_id is kept as null; equal rows are members each.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import common

#: Payloads are padded with PAD to a multiple of WIDTH, the pixels of an image's row.
WIDTH, PAD = 576, b"\xff"
ARCHIVE, MEMBERS = 32 << 20, 30_000
MOST_ARCHIVE, ARCHIVES = 128 << 20, 1 << 20
RANGE, RETRIES, BATCH = 16 << 20, 3, 4 << 20
#: Partitions of a read that are planned for; more bytes make each of them larger.
PARTITIONS = 100_000
_PNG = b"\x89PNG\r\n\x1a\n"


def to_png(payload: bytes) -> bytes:
    """A grey 8-bit image, WIDTH pixels wide, whose samples are the payload."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each row begins with filter type 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 3)) + chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that to_png made; every chunk's checksum is tested."""
    if image[:8] != _PNG:
        raise OSError("no PNG image")
    at, body, width, height = 8, [], 0, 0
    while at < len(image):
        (size,) = struct.unpack_from(">I", image, at)
        kind, own = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(kind + own):
            raise OSError("broken PNG chunk")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", own)
        elif kind == b"IDAT":
            body.append(own)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise OSError("filtered rows")
    return rows[:, 1:].tobytes()


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), folder


def _write(folder: str, archive: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = _filesystem(folder)
        held, members, number = None, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal held, members, number
            zipped.close()
            name = f"{root}/part-{context.partitionId():07d}-{number:05d}.zip"
            trial = f"{root}/.{context.taskAttemptId()}-{number}.tmp"
            with store.open_output_stream(trial) as out:
                out.write(held.getvalue())
            store.move(trial, name)
            row = pa.RecordBatch.from_pydict({"members": [members], "size": [held.tell()]}, schema=pa.schema([("members", pa.int64()), ("size", pa.int64())]))
            held, members, number = None, 0, number + 1
            return row

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if held is None:
                    held = io.BytesIO()
                    zipped = zipfile.ZipFile(held, "w", zipfile.ZIP_STORED)
                payload = (text or "").encode()
                payload += PAD * (-len(payload) % WIDTH or (0 if payload else WIDTH))
                zipped.writestr(zipfile.ZipInfo(f"{'null' if doc is None else doc}/{members}.png", (2020, 1, 1, 0, 0, 0)), to_png(payload))
                members += 1
                if held.tell() >= archive or members >= MEMBERS:
                    yield close()
        if held is not None:
            yield close()

    return run


def archive_bytes(size: int | None) -> int:
    """Bytes of an archive for an input of size bytes."""
    return min(MOST_ARCHIVE, max(ARCHIVE, -(-(size or 0) // ARCHIVES)))


def write_media(docs: DataFrame, folder: str, archive: int | None = None) -> tuple[int, int]:
    """Store the text of every row of docs (doc_id, text) in archives under folder: members and bytes written."""
    common.prepare(docs.sparkSession)
    archive = archive or archive_bytes(common.file_bytes(docs))
    store, root = _filesystem(folder)
    store.create_dir(root)
    done = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_write(folder, archive), "members bigint, size bigint")
    n, size = done.groupBy().sum("members", "size").first()
    return n or 0, size or 0


class _Ranges(InputPartition):
    """(archive, first byte, end, size of the archive) of each range of a partition."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]) -> None:
        self.ranges = ranges


def plan_ranges(files: list[tuple[str, int]], size: int, most: int = PARTITIONS) -> list[list[tuple[str, int, int, int]]]:
    """Ranges of size bytes of files (path, bytes), one a partition; if these are more than most, whole files in a row, in larger partitions."""
    ranges = [(p, a, min(a + size, n), n) for p, n in files for a in range(0, n, size)]
    if len(ranges) <= most:
        return [[r] for r in ranges]
    share, held, out = -(-sum(n for _, n in files) // most), 0, []
    for p, n in files:
        if not n:
            continue
        if n > share:
            out += [[(p, a, min(a + share, n), n)] for a in range(0, n, share)]
            held = share  # the next file begins a partition
        elif not out or held + n > share:
            out.append([(p, 0, n, n)])
            held = n
        else:
            out[-1].append((p, 0, n, n))
            held += n
    return out


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("payload", pa.binary())])


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.range = int(options.get("rangebytes", RANGE))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self) -> list[InputPartition]:
        store, root = _filesystem(self.folder)
        found = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".zip"))
        return [_Ranges(r) for r in plan_ranges(found, self.range)] or [_Ranges([])]

    def _again(self, what: str, read):
        """read(), tried anew where it fails."""
        for left in range(self.retries, -1, -1):
            try:
                return read()
            except (OSError, EOFError, ValueError, struct.error, zipfile.BadZipFile, zlib.error) as e:
                if not left:
                    raise OSError(f"{what}: {e}") from e

    def _directory(self, store: fs.FileSystem, path: str) -> list[zipfile.ZipInfo]:
        def read():
            with store.open_input_file(path) as f:
                zipped = zipfile.ZipFile(f)
                members = sorted(zipped.infolist(), key=lambda m: m.header_offset)
            end = max((m.header_offset + 30 + len(m.filename.encode()) + len(m.extra) + m.compress_size for m in members), default=0)
            if not 0 <= zipped.start_dir - end <= 24:  # a shortened directory would lose members silently
                raise OSError("does not follow the members")
            return members

        return self._again(f"{path}: directory", read)

    @staticmethod
    def _image(raw: bytes, m: zipfile.ZipInfo) -> bytes:
        """The stored bytes of a member from those that begin with its header."""
        begin = 30 + sum(struct.unpack_from("<HH", raw, 26))
        image = raw[begin : begin + m.file_size]
        if raw[:4] != b"PK\x03\x04" or len(image) != m.file_size or zlib.crc32(image) != m.CRC:
            raise OSError("member is damaged")
        return image

    def _member(self, store: fs.FileSystem, path: str, m: zipfile.ZipInfo) -> bytes:
        """A member by itself, tried anew from its offset where reading or its checksum fails."""

        def read():
            with store.open_input_file(path) as f:
                f.seek(m.header_offset)
                head = f.read(30)
                return self._image(head + f.read(sum(struct.unpack_from("<HH", head, 26)) + m.file_size), m)

        return self._again(f"{path}: member at {m.header_offset}", read)

    def _members(self, store: fs.FileSystem, path: str, members: list[zipfile.ZipInfo], size: int) -> Iterator[tuple[zipfile.ZipInfo, bytes]]:
        """Members with their bytes, read in runs through one handle."""
        ends = [m.header_offset for m in members[1:]] + [min(size, members[-1].header_offset + 30 + 2**17 + members[-1].file_size)] if members else []
        f, at = None, 0
        try:
            while at < len(members):
                begin, to = members[at].header_offset, at + 1
                while to < len(members) and ends[to] - begin <= BATCH:
                    to += 1
                try:
                    f = f or store.open_input_file(path)
                    f.seek(begin)
                    run = f.read(ends[to - 1] - begin)
                except OSError:  # the members of this run are read by themselves
                    f, run = None, b""
                for m in members[at:to]:
                    try:
                        image = self._image(run[m.header_offset - begin : m.header_offset - begin + 30 + 2**17 + m.file_size], m)
                    except (OSError, struct.error):
                        image = self._member(store, path, m)
                    yield m, image
                at = to
        finally:
            if f is not None:
                f.close()

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = _filesystem(self.folder)
        rows, held = [], 0
        for path, begin, end, size in partition.ranges:
            members = [m for m in self._directory(store, path) if begin <= m.header_offset < end]
            for m, image in self._members(store, path, members, size):
                doc = m.filename.split("/")[0]
                rows.append((None if doc == "null" else int(doc), path, m.header_offset, image, from_png(image)))
                held += len(image) + len(rows[-1][4])
                if held >= BATCH:
                    yield pa.RecordBatch.from_pydict(dict(zip(_SCHEMA.names, map(list, zip(*rows)))), schema=_SCHEMA)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(_SCHEMA.names, map(list, zip(*rows)))), schema=_SCHEMA)


class MediaSource(DataSource):
    """spark.read.format("sparkevo_media").load(folder): doc_id, archive, offset, media and payload of each member."""

    @classmethod
    def name(cls) -> str:
        return "sparkevo_media"

    def schema(self) -> str:
        return "doc_id bigint, archive string, offset bigint, media binary, payload binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_media(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("sparkevo_media").options(**options).load(folder)


def feature(payload: bytes) -> str:
    """Eight-bin histogram of samples and a 64-bit sketch of brightness by place, in hex."""
    samples = np.frombuffer(payload, np.uint8)
    bins = np.bincount(samples >> 5, minlength=8) * 255 // len(samples)
    blocks = np.add.reduceat(samples.astype(np.int64), np.arange(64) * len(samples) // 64)
    sizes = np.diff(np.append(np.arange(64) * len(samples) // 64, len(samples)))
    bright = np.packbits(blocks * len(samples) > int(samples.sum(dtype=np.int64)) * sizes)
    return bins.astype(np.uint8).tobytes().hex() + bright.tobytes().hex()


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for media, payload in zip(batch.column("media").to_pylist(), batch.column("payload").to_pylist()):
            values = (len(payload.rstrip(PAD)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload))
            for c, v in zip(out, values):
                out[c].append(v)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | out)


def measure(media: DataFrame) -> DataFrame:
    """Lengths, digests and the feature of every member; 255 never occurs in UTF-8, so padding is told from text."""
    return media.select("doc_id", "media", "payload").mapInArrow(
        _measure, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    )
