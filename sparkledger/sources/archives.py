"""Zip archives as a Python data source: members are partitions of a read, and tasks write archives.

Reading plans archives below a folder: one that is no larger than a partition is read whole by a task, a larger one is cut by its directory, several small members
to a partition. A member is either one row (its bytes) or, with `records`, a row for each element of the JSON array that it is, as text that Spark parses. Writing gives
every task archives of its own with fixed times, so the same members in the same order give the same bytes; an archive appears under its name when it is whole, and only
then. A task keeps the directory of the archive that it writes or reads, so an archive holds at most `MEMBERS` members and a task with more begins another.
"""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import raw
from .ledger import _open

#: Bytes (stored) of the members of a partition at least, unless it is the last; bytes of an Arrow batch.
PARTITION, BATCH = 16_000_000, 4_000_000
#: The most members of an archive that is written: what a directory without ZIP64 can number.
MEMBERS = 65_535
SCHEMA = "archive string, member string, content binary"
RECORDS = "archive string, member string, place long, record string"


@dataclass
class Members(InputPartition):
    """Members of an archive by their places in its directory; without `last`, to its end."""

    archive: str
    first: int
    last: int | None

    def __post_init__(self):
        super().__init__((self.first, self.last))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.member, self.records = options["path"], options.get("member", ""), options.get("records", "false") == "true"
        self.size = int(options.get("partitionbytes", PARTITION))

    def partitions(self) -> list[InputPartition]:
        system, root = _open(self.path)
        one = system.get_file_info(root)
        files = [one] if one.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(root, recursive=True))
        out: list[InputPartition] = []
        for f in sorted((f for f in files if f.path.endswith(".zip")), key=lambda f: f.path):
            if f.size <= self.size:
                out.append(Members(f.path, 0, None))
                continue
            first, last, size = 0, 0, 0
            for i, m in enumerate(zipfile.ZipFile(system.open_input_file(f.path)).infolist()):
                if not self._wanted(m):
                    continue
                last, size = i + 1, size + m.compress_size
                if size >= self.size:
                    out.append(Members(f.path, first, last))
                    first, size = last, 0
            if last > first:
                out.append(Members(f.path, first, last))
        return out

    def _wanted(self, m: zipfile.ZipInfo) -> bool:
        return not m.is_dir() and self.member in ("", m.filename)

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's way to read a source without partitions
            return
        system, _ = _open(self.path)
        archive = zipfile.ZipFile(system.open_input_file(partition.archive))
        kinds = [pa.string(), pa.string(), *([pa.int64(), pa.string()] if self.records else [pa.binary()])]
        names = ["archive", "member", *(["place", "record"] if self.records else ["content"])]
        rows, held = [], 0
        for m in filter(self._wanted, archive.infolist()[partition.first : partition.last]):
            for row in self._rows(archive, m):
                rows.append((partition.archive, m.filename, *row))
                held += len(row[-1]) + len(m.filename) + len(partition.archive)
                if held >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def _rows(self, archive: zipfile.ZipFile, m: zipfile.ZipInfo) -> Iterator[tuple]:
        if not self.records:
            yield (archive.read(m),)
            return
        with archive.open(m) as f:
            for i, record in enumerate(array_elements(f)):
                yield i, record


def array_elements(f, size: int = 1 << 20) -> Iterator[str]:
    """The elements of a JSON array in a file, as JSON text, with one element and a block held at a time."""
    import codecs

    decode, text, ended = codecs.getincrementaldecoder("utf-8-sig")(), "", False
    read = json.JSONDecoder().raw_decode
    started = False
    while True:
        text = text.lstrip()
        if not started and text:
            if text[0] != "[":
                raise ValueError("not a JSON array")
            started, text = True, text[1:]
            continue
        if started and text[:1] == "]":
            if (text[1:] + decode.decode(f.read(), True)).strip():
                raise ValueError("text behind the array")
            return
        if started and text:
            body = text[1:].lstrip() if text[0] == "," else text
            try:
                value, stop = read(body)
                # A number at the end of the block may go on in the next one, so what ends an element has to be seen.
                rest = body[stop:].lstrip()
                if rest[:1] in (",", "]"):
                    yield json.dumps(value, ensure_ascii=False)
                    text = rest
                    continue
                if rest and rest[0] not in ".eE+-0123456789":
                    raise ValueError("no comma between elements")
            except json.JSONDecodeError:
                if ended:
                    raise
        if ended:
            raise ValueError("the array doesn't end")
        block = f.read(max(size, len(text)))  # blocks grow with an element that doesn't fit, so it isn't parsed too often
        ended = not block
        text += decode.decode(block, ended)


@dataclass
class _Done(WriterCommitMessage):
    """The archives of a task: where they lie, and the names that they get."""

    archives: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.prefix, self.job = options["path"], options.get("prefix", "part"), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        context = TaskContext.get()
        task, done, rows = f"{context.partitionId():05d}", [], iter(iterator)
        for first in rows:
            place = f"{task}-{len(done):05d}" if done else task
            partial = f"{root}/.{self.job}-{place}-{context.taskAttemptId()}"
            with system.open_output_stream(partial) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                for row in chain([first], islice(rows, MEMBERS - 1)):
                    archive.writestr(zipfile.ZipInfo(row.path, (1980, 1, 1, 0, 0, 0)), bytes(row.content or b""), zipfile.ZIP_DEFLATED)
            done.append((partial, f"{root}/{self.prefix}-{place}.zip"))
        return _Done(done)

    def commit(self, messages: list) -> None:
        system, _ = _open(self.path)
        for partial, name in (x for m in messages if m is not None for x in m.archives):
            system.move(partial, name)

    def abort(self, messages: list) -> None:
        system, _ = _open(self.path)
        for partial, _ in (x for m in messages if m is not None for x in m.archives):
            if system.get_file_info(partial).type != pafs.FileType.NotFound:
                system.delete_file(partial)


class ZipArchive(DataSource):
    """Format `ziparchive`. Reads archive, member, content; with the option records, archive, member, place, record. Writes rows (path, content).

    Options: path (an archive, or a folder of them), member (only those of this name), records, partitionbytes; prefix (of archives that are written)."""

    @classmethod
    def name(cls) -> str:
        return "ziparchive"

    def schema(self) -> str:
        return RECORDS if self.options.get("records", "false") == "true" else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def read_members(spark: SparkSession, path: str, **options) -> DataFrame:
    """archive, member, content of the members of zip archives."""
    spark.dataSource.register(ZipArchive)
    return spark.read.format("ziparchive").options(path=path, **options).load()


def read_records(spark: SparkSession, path: str, schema: str, member: str = "", **options) -> DataFrame:
    """The elements of JSON arrays inside zip archives, as rows of a schema; a damaged element is an error."""
    spark.dataSource.register(ZipArchive)
    text = spark.read.format("ziparchive").options(path=path, member=member, records="true", **options).load()
    return text.select(F.from_json("record", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def build(spark: SparkSession, builder: str, path: str, member: str = "", **options) -> DataFrame:
    """The examples that a registered builder makes of raw records in zip archives, or in JSON files."""
    make, schema = raw.BUILDERS[builder]
    return make(read_records(spark, path, schema, member, **options) if path.endswith(".zip") or options.pop("zipped", False) else raw.read_array(spark, path, schema))


def write_members(files: DataFrame, folder: str, prefix: str = "part") -> None:
    """K7: path and content of files, put into archives: one for each partition that has rows, or as many as its members fill, in the order of the rows."""
    files.sparkSession.dataSource.register(ZipArchive)
    files.select("path", F.col("content").cast("binary").alias("content")).write.format("ziparchive").mode("append").options(path=folder, prefix=prefix).save()


def pack_outputs(files: DataFrame, folder: str, archives: int, prefix: str = "output") -> None:
    """The packable files of a listing (path, content), sorted by path, in so many archives, or in more where these would be over half full."""
    from .sinks import packable

    kept = packable(files)
    ranges = max(archives, -(-kept.count() // (MEMBERS // 2)))
    write_members(kept.repartitionByRange(ranges, "path").sortWithinPartitions("path"), folder, prefix)
