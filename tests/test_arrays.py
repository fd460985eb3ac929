"""Archives of arrays by ranges of rows."""

import numpy as np
import pytest

from sparkevo.sources import arrays, readers


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_rows_by_ranges(spark, tmp_path, save):
    r = np.random.default_rng(0)
    x, y = r.normal(size=(50, 3, 4)).astype("float32"), r.integers(0, 5, (50, 1)).astype("uint8")
    save(tmp_path / "a.npz", X_train=x, y_train=y, X_test=x[:7].astype("int16"), y_test=y[:7], other=[1])
    save(tmp_path / "b.npz", X_test=x[:3], y_test=y[:3, 0])
    found = readers.read_npz(spark, str(tmp_path), range_bytes=10 * 48)
    assert found.rdd.getNumPartitions() == ((5 + 1 + 1) if save is np.savez else 3)
    rows = found.collect()
    train = sorted((v for v in rows if v.part == "train"), key=lambda v: v.row)
    assert np.allclose([v.features for v in train], x.reshape(50, -1)) and [v.label for v in train] == y[:, 0].tolist() and [v.row for v in train] == list(range(50))
    assert sorted(v.row for v in rows if v.part == "test") == [0, 0, 1, 1, 2, 2, 3, 4, 5, 6]


def test_reads_are_tried_again(tmp_path, monkeypatch):
    x = np.arange(400.0).reshape(100, 4)
    np.savez(tmp_path / "a.npz", X_train=x, y_train=np.arange(100))
    monkeypatch.setattr(arrays, "CHUNK", 10 * 32)
    reader = arrays._Reader({"paths": str(tmp_path / "a.npz"), "range": "1600"})
    parts, whole, calls = reader.partitions(), arrays._Stream.rows, []
    assert [(p.first, p.last) for p in parts] == [(0, 50), (50, 100)]

    def failing(self, n):
        calls.append(n)
        if len(calls) in (3, 8):
            raise OSError("lost")
        return whole(self, n)

    monkeypatch.setattr(arrays._Stream, "rows", failing)
    got = [row for p in parts for batch in reader.read(p) for row in batch.to_pylist()]
    assert [r["row"] for r in got] == list(range(100)) and [r["features"] for r in got] == x.tolist()
    monkeypatch.setattr(arrays._Stream, "rows", lambda self, n: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        list(reader.read(parts[0]))


def test_odd_archives(spark, tmp_path):
    np.savez(tmp_path / "a.npz", X_train=np.zeros((2, 2)), y_train=[1])
    with pytest.raises(Exception, match="differ in length"):
        readers.read_npz(spark, str(tmp_path / "a.npz")).count()
    np.savez(tmp_path / "b.npz", nothing=[1])
    assert readers.read_npz(spark, str(tmp_path / "b.npz")).count() == 0
