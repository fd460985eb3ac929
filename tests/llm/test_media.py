import hashlib
import io
import os
import zipfile
import zlib
from collections import Counter

import pytest

from sparkevo.llm import media
from sparkevo.llm import queries as q
from sparkevo.llm.common import scratch


def want(docs):
    out = Counter()
    for d in docs:
        raw = (d["text"] or "").encode()
        padded = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        image = media.to_png(padded)
        out[d["doc_id"], len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]), len(image), hashlib.sha256(image).hexdigest()] += 1
    return out


def got(df):
    return Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in df.collect())


def test_documents(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = q.op3_media_columns(spark, sf)
    assert got(found) == want(docs)
    by_text = {}
    for r in found.collect():
        assert len(r.feature) == 32 and by_text.setdefault(r.payload_sha256, r.feature) == r.feature


def test_odd_ranges_and_retries(spark, odd_docs, no_docs):
    folder = scratch(spark, "media")
    n, _ = media.write_media(odd_docs, folder, archive=2000)
    assert n == odd_docs.count()
    read = media.read_media(spark, folder, rangebytes=300)
    assert read.rdd.getNumPartitions() > 5
    assert got(media.measure(read)) == want([r.asDict() for r in odd_docs.collect()])
    empty = scratch(spark, "media")
    media.write_media(no_docs, empty)
    assert media.read_media(spark, empty).count() == 0


def plain_feature(payload):
    """The feature column by its definition: shares of eight ranges of samples, and which of 64 parts are brighter than all."""
    n = len(payload)
    bins = [sum(k << 5 <= b < k + 1 << 5 for b in payload) * 255 // n for k in range(8)]
    edges = [i * n // 64 for i in range(65)]
    bright = [sum(payload[a:b]) * n > sum(payload) * (b - a) for a, b in zip(edges, edges[1:])]
    return bytes(bins).hex() + "".join(f"{sum(x << 7 - i for i, x in enumerate(bright[k : k + 8])):02x}" for k in range(0, 64, 8))


def plain_samples(image):
    """Samples of a grey image without filters, read by hand."""
    assert image[:8] == b"\x89PNG\r\n\x1a\n" and image[12:16] == b"IHDR"
    width, height, depth, colour = *(int.from_bytes(image[a : a + 4], "big") for a in (16, 20)), image[24], image[25]
    assert (depth, colour) == (8, 0)
    at = image.index(b"IDAT")
    raw = zlib.decompress(image[at + 4 : at + 4 + int.from_bytes(image[at - 4 : at], "big")])
    return b"".join(raw[r * (width + 1) + 1 : (r + 1) * (width + 1)] for r in range(height))


def test_features_and_images_by_hand(spark, odd_docs):
    folder = scratch(spark, "media")
    media.write_media(odd_docs, folder)
    for r in media.read_media(spark, folder).collect():
        assert plain_samples(bytes(r.media)) == bytes(r.payload)
        if len(r.payload) < 20_000:
            assert media.feature(bytes(r.payload)) == plain_feature(bytes(r.payload))


@pytest.fixture
def archive(tmp_path):
    path = os.path.join(tmp_path, "a.zip")
    images = [media.to_png(bytes([k]) * 576 * (k + 1)) for k in range(5)]
    with zipfile.ZipFile(path, "w") as z:
        for k, image in enumerate(images):
            z.writestr(f"{k}/{k}.png", image)
    return path, images


class Flaky:
    """A store that fails some opens, or hands on damaged bytes for some, and counts them."""

    def __init__(self, fail=(), damage=()):
        self.fail, self.damage, self.calls = fail, damage, 0

    def open_input_file(self, path):
        self.calls += 1
        if self.calls in self.fail:
            raise OSError("lost")
        with open(path, "rb") as f:
            raw = bytearray(f.read())
        if self.calls in self.damage:
            raw[len(raw) // 2 : len(raw) // 2 + 40] = b"\0" * 40
            raw[-10:] = b"\0" * 10
        return io.BytesIO(bytes(raw))


@pytest.mark.parametrize("fail, damage, calls", [((), (), 2), ((1, 3), (), 8), ((), (1, 2), 4), ((2,), (3,), 8)])
def test_members_and_directory_are_read_again(archive, fail, damage, calls):
    path, images = archive
    reader, store = media._Reader({"path": os.path.dirname(path)}), Flaky(fail, damage)
    members = reader._directory(store, path)
    got = list(reader._members(store, path, members, os.path.getsize(path)))
    assert [image for _, image in got] == images
    assert store.calls <= calls  # one handle for the directory, one for all members, further ones for retries only


def test_lasting_damage_is_an_error(archive):
    path, _ = archive
    reader = media._Reader({"path": os.path.dirname(path), "retries": "1"})
    members = reader._directory(Flaky(), path)
    with pytest.raises(OSError, match="member at"):
        list(reader._members(Flaky(damage=range(99)), path, members, os.path.getsize(path)))
    with pytest.raises(OSError, match="directory"):
        reader._directory(Flaky(damage=range(99)), path)


@pytest.mark.parametrize("sizes, size, most", [([40, 3, 0, 25], 10, 99), ([5] * 30, 2, 8), ([100, 1, 1, 1, 30, 1], 3, 6), ([], 5, 2), ([7], 7, 1)])
def test_ranges_cover_every_byte_once(sizes, size, most):
    files = [(f"a{k}", n) for k, n in enumerate(sizes)]
    found = media.plan_ranges(files, size, most)
    assert sorted((p, at) for part in found for p, a, b, n in part for at in range(a, b) if n == dict(files)[p]) == sorted((p, at) for p, n in files for at in range(n))
    assert len(found) <= max(most + len([n for n in sizes if n]), sum(-(-n // size) for n in sizes if sum(-(-m // size) for m in sizes) <= most))
    if sizes == [5] * 30:
        assert len(found) <= 8 * 2 and all(b - a == 5 for part in found for _, a, b, _ in part)  # whole archives


def test_partitions_of_several_archives(spark, odd_docs, monkeypatch):
    folder = scratch(spark, "media")
    media.write_media(odd_docs, folder, archive=2000)
    monkeypatch.setattr(media, "plan_ranges", lambda files, size: [[(p, 0, n, n) for p, n in files[k::2]] for k in range(2)])
    reader = media._Reader({"path": folder})
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert sum(b.num_rows for b in batches) == odd_docs.count()
    assert media.archive_bytes(None) == media.archive_bytes(10**11) == media.ARCHIVE < media.archive_bytes(10**14) <= media.MOST_ARCHIVE
