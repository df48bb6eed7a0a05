"""Operator 8: media columns in archives, read back by a custom Spark data source.

Writing: a task stores its rows as members of one zip archive (stored, not deflated: members are compressed media already) in a
shared folder, under a name of its own until it is complete, so a task that runs again replaces its own archive.
Reading: the data source `mediaarchive` lists the archives of a folder and plans byte ranges over each. A range owns the members whose offset lies
in it, by the archive's central directory; they are streamed as Arrow batches of bounded payload. A member that can't be read is tried again from its own
offset, by a new handle, without reading its neighbours again; if it stays unreadable its row carries the error.

Texts are stored as 8-bit greyscale PNG of 64 samples a row: lossless, and smaller than the text. Null and empty texts are 64 zero bytes.
Equal texts have equal media. Repeated rows and null ids are members of their own (a member's name has a number and the id). Empty tables give no rows;
extra columns play no part.
"""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import common as C

WIDTH, LEVEL, RANGE, BATCH, TRIES = 64, 1, 16_000_000, 4_000_000, 3
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_LOCAL = struct.Struct("<4s5H3L2H")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">L", len(body)) + kind + body + struct.pack(">L", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    """The payload (a multiple of width) as a greyscale PNG, one byte a sample, unfiltered."""
    rows = len(payload) // width
    raw = np.zeros((rows, width + 1), np.uint8)
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, width)
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">LLBBBBB", width, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of a PNG as encode_png writes it; ValueError for anything else."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, width, rows, data = 8, 0, 0, []
    while at + 12 <= len(media):
        n, kind = struct.unpack(">L4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">L", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, rows, *form = struct.unpack(">LLBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("another pixel format")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(rows, width + 1)
    if raw[:, 0].any():
        raise ValueError("another filter")
    return raw[:, 1:].tobytes()


def pad(raw: bytes, width: int = WIDTH) -> bytes:
    return raw + bytes(max(width, -(-len(raw) // width) * width) - len(raw))


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _write(folder: str, id_col: str, text_col: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        context = TaskContext.get()
        name, n = f"{root}/part-{context.partitionId():06d}.zip", 0
        partial = f"{name}.{context.taskAttemptId()}"
        with system.open_output_stream(partial) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            for batch in batches:
                ids = batch.column(batch.schema.get_field_index(id_col)).cast(pa.string()).to_pylist()
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                for i, t in zip(ids, texts):
                    raw = (t or "").encode()
                    archive.writestr(zipfile.ZipInfo(f"{n}/{len(raw)}/{'' if i is None else i}"), encode_png(pad(raw)))
                    n += 1
        # an attempt before this one may have finished its archive: it holds the same members
        if n and system.get_file_info(name).type == pafs.FileType.NotFound:
            system.move(partial, name)
        else:
            system.delete_file(partial)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["members"])

    return write


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text") -> int:
    """Stores each row's text as a member of an archive in folder (a URI that all executors reach). Returns the number of members."""
    C.small_batches(docs.sparkSession)
    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    return docs.select(id_col, text).mapInArrow(_write(folder, id_col, text), "members long").agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range = int(options.get("rangebytes", RANGE))
        self.batch = int(options.get("batchbytes", BATCH))
        self.tries = int(options.get("tries", TRIES))

    def partitions(self) -> list[ByteRange]:
        system, root = _open(self.folder)
        files = [f for f in system.get_file_info(pafs.FileSelector(root, recursive=True)) if f.path.endswith(".zip")]
        return [ByteRange(f.path, a, min(a + self.range, f.size)) for f in sorted(files, key=lambda f: f.path) for a in range(0, f.size, self.range)]

    def _member(self, system: pafs.FileSystem, path: str, handle, info: zipfile.ZipInfo) -> bytes:
        handle.seek(info.header_offset)
        head = _LOCAL.unpack(handle.read(_LOCAL.size))
        if head[0] != b"PK\x03\x04":
            raise OSError("no member at its offset")
        handle.seek(info.header_offset + _LOCAL.size + head[-2] + head[-1])
        body = handle.read(info.compress_size)
        if zlib.crc32(body) != info.CRC:
            raise OSError("checksum differs")
        return body

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's way to read a source without partitions
            return
        system, _ = _open(self.folder)
        handle = system.open_input_file(partition.path)
        members = [m for m in zipfile.ZipFile(handle).infolist() if partition.start <= m.header_offset < partition.stop]
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            names = ["archive", "member", "offset", "media", "tries", "error"]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for m in members:
            body, error, k = None, None, 0
            for k in range(1, self.tries + 1):
                try:
                    body, error = self._member(system, partition.path, handle, m), None
                    break
                except (OSError, struct.error) as e:
                    error = str(e)
                    handle = system.open_input_file(partition.path)
            rows.append((partition.path, m.filename, m.header_offset, body, k, error))
            held += len(body or b"")
            if held >= self.batch:
                yield flush()
                rows, held = [], 0
        if rows:
            yield flush()


class MediaArchive(DataSource):
    """Format `mediaarchive`. Options: path (folder URI), rangebytes, batchbytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "mediaarchive"

    def schema(self) -> str:
        return "archive string, member string, offset long, media binary, tries int, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    """archive, member, offset, media, tries, error: a row for each member."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("mediaarchive").options(**options).load(folder)


def describe(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and their 8-bin histogram."""
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = n / max(1, n.sum())
    mean = float(p @ np.arange(256))
    deviation = float(np.sqrt(p @ (np.arange(256) - mean) ** 2))
    some = p[p > 0]
    return f"mean={mean:.3f};sd={deviation:.3f};entropy={-float(some @ np.log2(some)):.4f};bins={','.join(map(str, n.reshape(8, 32).sum(1)))}"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(batch.schema.get_field_index("member")).to_pylist()
        rows = []
        for name, media, error in zip(names, batch.column(batch.schema.get_field_index("media")), batch.column(batch.schema.get_field_index("error")).to_pylist()):
            if error:
                raise OSError(f"{name}: {error}")
            media = media.as_py()
            payload = decode_png(media)
            _, size, key = name.split("/", 2)
            rows.append((key or None, int(size), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), describe(payload)))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_features(docs: DataFrame, id_col: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Stores all texts as media in archives, reads them back and describes them: a row for each row of docs."""
    spark = docs.sparkSession
    folder = folder or C.new_path(spark, "media")
    write_archives(docs, folder, id_col, text)
    kind = docs.schema[id_col].dataType.simpleString()
    found = read_archives(spark, folder).select("member", "media", "error").mapInArrow(_features, "key string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.select(F.col("key").cast(kind).alias(id_col), *found.columns[1:])
