"""Media columns: payloads stored as members of archives, read back by a Spark data source.

`MediaArchives` is a data source over a folder of ZIP archives.  It reads whatever lies there, or, where the source itself has
written, what its manifests name, so that files of failed attempts never count.

Reading.  The driver looks at names and sizes of archives only and cuts them into byte ranges; a partition is some ranges of
about `rangeBytes`.  A task reads an archive's directory and takes the members that begin in its range, in the order of
their offsets.  Neighbouring members are read in one request of up to `batchBytes` and handed on as one Arrow batch.  A
member that does not come through, be it that the request failed or that its checksum is wrong, is asked for again by its own
offset, up to `retries` times, while the others stay as they are; after that the read fails, or with `onError=keep` the row
has a null payload and says why.  A lost executor costs its ranges again.

Writing.  Each task writes archives of up to `archiveBytes`, each member deflated by itself, under names of their own and the
commit writes a manifest of them.

Documents as media: a text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are the samples of an 8-bit mono
WAV file whose `fact` chunk tells how many of them are text.

Edge cases: a null text is stored as an empty one (64 zero samples); a row without an id is stored under the name `null` and
comes back without an id; rows that share an id are stored and come back each; an empty table writes an empty manifest and
gives no rows; a member longer than a batch is a batch of its own; other columns are not read.  Paths are opened by
Arrow's file systems, so the folder may be on any store that they know and that driver and executors share.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ._store import lean, shared_dir
from ._text import row_slices, text_buffer

#: Bytes of archives that a partition covers, of a request and batch, and of an archive.
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
ARCHIVE_BYTES = 256 << 20
BATCH_ROWS = 1024
RETRIES = 3
#: Of the archives' compression.
LEVEL = 2
#: Samples of a stored text come in whole frames of this many.
FRAME = 64
RATE = 8000
SEGMENTS = 8

_SCHEMA = "archive string, member string, offset long, payload binary, error string"
_STORED, _DEFLATED = zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED
_FAILS = (OSError, zipfile.BadZipFile, zlib.error, EOFError)


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


@dataclass
class Ranges(InputPartition):
    """(archive, first byte, end) of the member offsets that a task reads."""

    spans: list[tuple[str, int, int]]


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int]]


class MediaArchives(DataSource):
    """format("media_archives"): rows (archive, member, offset, payload, error); writes rows (member, payload)."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        if overwrite:
            raise ValueError("media_archives only appends")
        return ArchiveWriter(self.options)


def plan(archives: Iterable[tuple[str, int]], range_bytes: int) -> list[Ranges]:
    """Byte ranges over all archives: long ones are cut, short ones share a partition."""
    out, spans, size = [], [], 0
    for name, length in archives:
        for lo in range(0, length, range_bytes):
            hi = min(length, lo + range_bytes)
            if spans and size + hi - lo > range_bytes:
                out.append(Ranges(spans))
                spans, size = [], 0
            spans.append((name, lo, hi))
            size += hi - lo
    return out + [Ranges(spans)] * bool(spans)


def member_bytes(raw: bytes, at: int, info: zipfile.ZipInfo) -> bytes:
    """The payload of the member whose local header lies at raw[at:]; an error if its length or checksum is wrong."""
    if raw[at : at + 4] != b"PK\x03\x04" or len(raw) < at + 30:
        raise zipfile.BadZipFile(f"no member at offset {info.header_offset}")
    begin = at + 30 + sum(struct.unpack_from("<HH", raw, at + 26))
    body = raw[begin : begin + info.compress_size]
    if info.compress_type == _DEFLATED:
        body = zlib.decompress(body, -15)
    elif info.compress_type != _STORED:
        raise NotImplementedError(f"{info.filename}: compression {info.compress_type}")
    if len(body) != info.file_size or zlib.crc32(body) != info.CRC:
        raise zipfile.BadZipFile(f"checksum of the member at offset {info.header_offset}")
    return body


class _Whole(io.RawIOBase):
    """A store's file as the archive module expects one: seeking before its begin is an OSError."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size, self.at = file, file.size(), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        to = (0, self.at, self.size)[whence] + offset
        if to < 0:
            raise OSError("before the file's begin")
        self.at = to
        return to

    def readinto(self, into) -> int:
        got = self.file.read_at(len(into), self.at) if self.at < self.size else b""
        into[: len(got)] = got
        self.at += len(got)
        return len(got)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchBytes", BATCH_BYTES))
        self.retries = int(options.get("retries", RETRIES))
        self.keep = options.get("onError", "fail") == "keep"

    def partitions(self) -> list[Ranges]:
        files, root = _folder(self.path)
        found = [x for x in files.get_file_info(pafs.FileSelector(root)) if x.is_file]
        manifests = [x for x in found if x.base_name.startswith("_manifest-")]
        archives = [(x.base_name, x.size) for x in found if x.base_name.endswith(".zip")]
        if manifests:
            archives = []
            for x in manifests:
                with files.open_input_file(x.path) as f:
                    archives += [tuple(a) for a in json.loads(f.read())]
        return plan(sorted(archives), self.range_bytes) or [Ranges([])]

    def request(self, files: pafs.FileSystem, path: str, at: int, length: int) -> bytes:
        with files.open_input_file(path) as f:
            return f.read_at(length, at)

    def directory(self, files: pafs.FileSystem, path: str) -> tuple[list[zipfile.ZipInfo], int]:
        """All members in the order of their offsets, and where the last of them ends at most."""
        for turn in range(self.retries + 1):
            try:
                with files.open_input_file(path) as f, zipfile.ZipFile(io.BufferedReader(_Whole(f), 1 << 16)) as z:
                    return sorted((x for x in z.infolist() if not x.is_dir()), key=lambda x: x.header_offset), z.start_dir
            except _FAILS:
                if turn == self.retries:
                    raise
        raise AssertionError

    def again(self, files: pafs.FileSystem, path: str, info: zipfile.ZipInfo, end: int) -> tuple[bytes | None, str | None]:
        """One member, by its offset, and what was wrong if it never came."""
        why = ""
        for _ in range(self.retries):
            try:
                return member_bytes(self.request(files, path, info.header_offset, end - info.header_offset), 0, info), None
            except _FAILS as e:
                why = str(e)
        if not self.keep:
            raise OSError(f"{path}: {info.filename}: {why}")
        return None, why

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        files, root = _folder(self.path)
        for name, lo, hi in partition.spans:
            path = f"{root}/{name}"
            members, last = self.directory(files, path)
            begins = [x.header_offset for x in members] + [last]
            mine = [k for k, x in enumerate(members) if lo <= x.header_offset < hi]
            while mine:
                start = begins[mine[0]]
                n = 1
                while n < min(len(mine), BATCH_ROWS) and begins[mine[n] + 1] - start <= self.batch_bytes:
                    n += 1
                now, mine = mine[:n], mine[n:]
                try:
                    raw = self.request(files, path, start, begins[now[-1] + 1] - start)
                except OSError:
                    raw = b""
                rows = []
                for k in now:
                    try:
                        got = member_bytes(raw, begins[k] - start, members[k]), None
                    except _FAILS:
                        got = self.again(files, path, members[k], begins[k + 1])
                    rows.append((name, members[k].filename, begins[k], *got))
                columns = list(zip(*rows))
                kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["archive", "member", "offset", "payload", "error"])


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.archive_bytes = int(options.get("archiveBytes", ARCHIVE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _folder(self.path)
        files.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        sink = archive = None
        name = ""

        def close() -> None:
            archive.close()
            size = sink.tell()
            sink.close()
            done.append((name, size))

        try:
            for batch in iterator:
                for member, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if archive is None:
                        name = f"{uuid.uuid4().hex}.zip"
                        sink = files.open_output_stream(f"{root}/{name}")
                        archive = zipfile.ZipFile(sink, "w", _DEFLATED, compresslevel=LEVEL)
                    archive.writestr(zipfile.ZipInfo(member), payload.as_py(), _DEFLATED, LEVEL)
                    if sink.tell() >= self.archive_bytes:
                        close()
                        archive = None
            if archive is not None:
                close()
        except BaseException:
            self._remove([*done, (name, 0)])
            raise
        return Written(done)

    def _remove(self, archives: Iterable[tuple[str, int]]) -> None:
        files, root = _folder(self.path)
        for name, _ in archives:
            if name and files.get_file_info(f"{root}/{name}").is_file:
                files.delete_file(f"{root}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _folder(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([a for m in messages if m for a in m.archives]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                self._remove(m.archives)


def wav(text: bytes) -> bytes:
    """text as an 8-bit mono WAV file, padded with zeros to whole frames."""
    size = max(FRAME, -(-len(text) // FRAME) * FRAME)
    head = struct.pack("<4sI8sIHHIIHH4sII4sI", b"RIFF", 48 + size, b"WAVEfmt ", 16, 1, 1, RATE, RATE, 1, 8, b"fact", 4, len(text), b"data", size)
    return b"".join((head, text, bytes(size - len(text))))


def samples(media: bytes) -> tuple[int, bytes]:
    """(samples that are text, all samples) of an 8-bit mono WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, told, found = 12, None, None
    while at + 8 <= len(media) and found is None:
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt " and struct.unpack_from("<HH", media, at + 8) + struct.unpack_from("<H", media, at + 22) != (1, 1, 8):
            raise ValueError("not 8-bit mono samples")
        if kind == b"fact":
            told = struct.unpack_from("<I", media, at + 8)[0]
        if kind == b"data":
            found = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if found is None:
        raise ValueError("no samples")
    return len(found) if told is None else told, found


def feature(payload: bytes) -> str:
    """Mean distance from silence in each of eight equal segments, crossings of silence, and the peak."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    loud = np.abs(x)
    envelope = loud.reshape(SEGMENTS, -1).sum(axis=1) // (len(x) // SEGMENTS)
    return f"{'-'.join(map(str, envelope.tolist()))};{int((np.diff((x >= 0).astype(np.int8)) != 0).sum())};{int(loud.max())}"


@lean
def _encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, offsets = text_buffer(b.column(1))
        for lo, hi in row_slices(offsets + 64 * np.arange(len(offsets)), BATCH_BYTES):
            names = [f"{'null' if i is None else i}.wav" for i in b.column(0).slice(lo, hi - lo).to_pylist()]
            media = [wav(buf[offsets[k] : offsets[k + 1]].tobytes()) for k in range(lo, hi)]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(media, pa.binary())], names=["member", "payload"])


@lean
def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for member, media in zip(b.column(0).to_pylist(), b.column(1)):
            media = media.as_py()
            n, payload = samples(media)
            key = member.rpartition(".")[0]
            rows.append((None if key == "null" else int(key), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every row's text as a member of archives in the folder."""
    docs.sparkSession.dataSource.register(MediaArchives)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    rows.mapInArrow(_encode, "member string, payload binary").write.format("media_archives").mode("append").option("path", path).save()


def media(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The media column of a folder of archives: (archive, member, offset, payload, error)."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(path=path, **options).load()


def text_media(docs: DataFrame) -> DataFrame:
    """Store every text and describe what is read back: (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature)."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    store(docs, path)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media(spark, path).select("member", "payload").mapInArrow(_features, schema)
