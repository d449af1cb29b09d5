"""Media columns: round trips, foreign archives, retries by offset, and edges."""

import hashlib
import io
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import media


def model(i, text):
    raw = (text or "").encode()
    size = max(64, -(-len(raw) // 64) * 64)
    payload = raw + bytes(size - len(raw))
    x = [b - 128 for b in payload]
    part = size // 8
    envelope = [sum(abs(v) for v in x[k * part : (k + 1) * part]) // part for k in range(8)]
    crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:]))
    return (i, len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), size + 56, f"{'-'.join(map(str, envelope))};{crossings};{max(map(abs, x))}")


def texts(seed=5, n=200):
    rng = random.Random(seed)
    rows = [(None, "no id"), (1, None), (2, ""), (3, "\0\0x\0"), (4, "é" * 32), (5, "x" * 64), (6, "x" * 65), (6, "x" * 65), (7, "日本語" * 3000)]
    return rows + [(i, "".join(rng.choice("abcé 日.\n") for _ in range(rng.randrange(400)))) for i in range(10, n)]


def test_texts_come_back(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, feature string").repartition(4)
    got = media.text_media(df).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r)
    assert sorted([tuple(r[:6]) + (r.feature,) for r in got], key=key) == sorted([model(*x) for x in rows], key=key)
    by = {}
    for r in got:
        by.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature, r.tail_crc32))
    assert all(len(v) == 1 for v in by.values())
    assert media.text_media(df.filter("false")).count() == 0


def test_ranges_take_each_member_once(spark, tmp_path):
    rows = [(i, "y" * (i * 7 % 900)) for i in range(300)]
    media.store(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path))
    for size in (200, 5000, 1 << 20):
        got = media.media(spark, str(tmp_path), rangeBytes=str(size), batchBytes="2000")
        assert sorted((int(r.member[:-4]), media.samples(bytes(r.payload))[0]) for r in got.collect()) == [(i, len(t)) for i, t in rows]
    assert media.media(spark, str(tmp_path), rangeBytes="200").rdd.getNumPartitions() > 20
    (tmp_path / "stray.zip").write_bytes(b"left by a failed attempt")
    assert media.media(spark, str(tmp_path)).count() == 300


def archive(path, members, kind=zipfile.ZIP_STORED):
    with zipfile.ZipFile(path, "w", kind) as z:
        for name, body in members:
            z.writestr(name, body)


def test_foreign_archives(spark, tmp_path):
    archive(tmp_path / "a.zip", [("x/", b""), ("x/1.png", b"one" * 900), ("x/1.png", b"again")], zipfile.ZIP_DEFLATED)
    archive(tmp_path / "b.zip", [("empty", b"")])
    archive(tmp_path / "none.zip", [])
    got = media.media(spark, str(tmp_path)).orderBy("archive", "offset").select("archive", "member", F.col("payload").cast("string"), "error").collect()
    assert [tuple(r) for r in got] == [("a.zip", "x/1.png", "one" * 900, None), ("a.zip", "x/1.png", "again", None), ("b.zip", "empty", "", None)]


def read_here(path, **options):
    reader = media.ArchiveReader({"path": str(path), **options})
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


def test_failed_members_are_asked_for_alone(tmp_path, monkeypatch):
    archive(tmp_path / "a.zip", [(f"m{k}", bytes([k]) * 50) for k in range(20)])
    plain, asked = media.ArchiveReader.request, []

    def flaky(self, files, path, at, length):
        asked.append((at, length))
        raw = plain(self, files, path, at, length)
        return raw[:1000] + b"?" * (len(raw) - 1000) if len(asked) == 1 else raw  # the first request is torn

    monkeypatch.setattr(media.ArchiveReader, "request", flaky)
    got = read_here(tmp_path)
    assert [(r["member"], bytes(r["payload"])) for r in got] == [(f"m{k}", bytes([k]) * 50) for k in range(20)]
    alone = [at for at, _ in asked[1:]]
    assert alone == sorted(set(alone)) and alone == [r["offset"] for r in got if r["offset"] + 80 > 1000]

    def down(self, files, path, at, length):
        asked.append((at, length))
        if len(asked) % 3:
            raise OSError("connection lost")
        return plain(self, files, path, at, length)

    monkeypatch.setattr(media.ArchiveReader, "request", down)
    asked.clear()
    assert len(read_here(tmp_path)) == 20 and len(asked) > 40


def test_damaged_member_is_named_or_kept_as_an_error(tmp_path):
    archive(tmp_path / "a.zip", [("good", b"g" * 100), ("bad", b"b" * 100), ("last", b"l" * 100)])
    raw = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "a.zip").write_bytes(raw.replace(b"bbbb", b"bxbb", 1))
    with pytest.raises(OSError, match="bad"):
        read_here(tmp_path)
    got = read_here(tmp_path, onError="keep")
    assert [(r["member"], r["payload"] is None, r["error"] is None) for r in got] == [("good", False, True), ("bad", True, False), ("last", False, True)]


def test_only_8_bit_mono_samples_are_taken():
    assert media.samples(media.wav(b"abc")) == (3, b"abc" + bytes(61))
    for broken in (b"", b"RIFF", media.wav(b"x")[:50], media.wav(b"x").replace(b"\x08\x00fact", b"\x10\x00fact")):
        with pytest.raises((ValueError, IndexError)):
            media.samples(broken)
    with zipfile.ZipFile(io.BytesIO(), "w") as z:
        z.writestr("x", media.wav(b"x"))


def test_writers_remove_what_failed(tmp_path):
    import pyarrow as pa

    def batches():
        yield pa.RecordBatch.from_pydict({"member": ["a"], "payload": pa.array([b"x"], pa.binary())})
        raise RuntimeError("the task fails")

    writer = media.ArchiveWriter({"path": str(tmp_path)})
    with pytest.raises(RuntimeError):
        writer.write(batches())
    assert not list(tmp_path.iterdir())
    done = writer.write(iter([pa.RecordBatch.from_pydict({"member": ["a"], "payload": pa.array([b"x"], pa.binary())})]))
    writer.abort([done, None])
    assert not list(tmp_path.iterdir())
