"""A log of runs whose appends are atomic and ordered (S5, S20, K1, K4, W1), as a Python data source with commit and abort.

Each append is a job that writes files of its own. They count only once the job's commit record exists, which carries the next commit number, so a job
that fails, or a task that is tried again, leaves what was there before. A row's place is the commit's number and the row's line in it, both stored: no
packing of files changes the order. Layout below the folder of runs:

    results.jsonl/<part>.jsonl              result lines (kind `result`)
    <run>/<kind>/<part>-<line>.json         the run's own copy of a result, or its status
    ledger-commits/<number>~<batch>~<job>.json

A part is named by job, partition and attempt; the record lists the parts whose attempts succeeded. Appends at the same time may take the same number; then
their jobs' names decide. An append with a batch name that was committed before changes nothing, so a batch that a stream repeats counts once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

COMMITS = "ledger-commits"
ROW = "exp_id string, line long, doc string"
#: How parts are named: job, partition, attempt.
PART = r"(([0-9a-f]{32})-\d{5}-\d+)"
#: The place of a row.
PLACE = "struct<commit:bigint,job:string,time:timestamp,path:string,block:bigint,line:bigint>"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    system, root = pafs.FileSystem.from_uri(uri)
    return system, root.rstrip("/")


def _put(system: pafs.FileSystem, path: str, text: str) -> None:
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(text.encode())


def _names(system: pafs.FileSystem, root: str) -> list[str]:
    """Names of commit records: numbers and batches, without reading them."""
    found = system.get_file_info(pafs.FileSelector(f"{root}/{COMMITS}", allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.endswith(".json"))


@dataclass
class _Done(WriterCommitMessage):
    part: str
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.kind, self.batch, self.copies = options["path"], options["kind"], options.get("batch", ""), options.get("copies", "true") == "true"
        self.job = uuid.uuid4().hex

    def _log(self, root: str, part: str) -> str:
        return f"{root}/results.jsonl/{part}.jsonl"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, root = _open(self.path)
        context = TaskContext.get()
        part, n, log = f"{self.job}-{context.partitionId():05d}-{context.taskAttemptId()}", 0, None
        for row in iterator:
            if self.kind == "result":
                if log is None:
                    system.create_dir(f"{root}/results.jsonl", recursive=True)
                    log = system.open_output_stream(self._log(root, part))
                log.write(f"{row.doc}\n".encode())
            if self.copies and row.exp_id is not None:
                _put(system, f"{root}/{quote(row.exp_id, safe='')}/{self.kind}/{part}-{row.line}.json", row.doc)
            n += 1
        if log is not None:
            log.close()
        return _Done(part, n)

    def commit(self, messages: list) -> None:
        system, root = _open(self.path)
        names = _names(system, root)
        if self.batch and any(x.split("~")[1] == quote(self.batch, safe="") for x in names):
            return self.abort(messages)
        done = [m for m in messages if m is not None and m.rows]
        number = int(names[-1].partition("~")[0]) + 1 if names else 1
        name = f"{root}/{COMMITS}/{number:012d}~{quote(self.batch, safe='')}~{self.job}.json"
        _put(system, f"{name}.partial", json.dumps({"commit": number, "parts": [m.part for m in done], "rows": sum(m.rows for m in done)}))
        system.move(f"{name}.partial", name)  # the record is there whole, or not at all
        return None

    def abort(self, messages: list) -> None:
        system, root = _open(self.path)
        for m in messages:
            if m is not None and system.get_file_info(self._log(root, m.part)).type != pafs.FileType.NotFound:
                system.delete_file(self._log(root, m.part))


class RunLedger(DataSource):
    """Format `runledger`, for appending rows (exp_id, line, doc). Options: path (folder URI), kind (result or status), batch, copies."""

    @classmethod
    def name(cls) -> str:
        return "runledger"

    def schema(self) -> str:
        return ROW

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("the ledger is only appended to")
        return _Writer(self.options)


def append(rows: DataFrame, folder: str, kind: str, order: tuple[Column | str, ...] = (), batch: str = "", copies: bool = True) -> None:
    """Adds rows in one commit; lines follow `order`, or the order that the rows have. copies: a file of its own for each run's row."""
    rows.sparkSession.dataSource.register(RunLedger)
    numbered = (rows.orderBy(*order) if order else rows).withColumn("line", F.monotonically_increasing_id())
    made = numbered.select(F.col("exp_id").cast("string").alias("exp_id"), "line", F.to_json(F.struct(*(f"`{c}`" for c in numbered.columns))).alias("doc"))
    made.write.format("runledger").mode("append").options(path=folder, kind=kind, batch=batch, copies=str(copies).lower()).save()


def parts(spark: SparkSession, folder: str, present: bool) -> DataFrame:
    """part, commit: the parts that count; none if there are no records."""
    if not present:
        return spark.createDataFrame([], "part string, commit long")
    return spark.read.schema("commit long, parts array<string>").json(f"{folder}/{COMMITS}/*.json").select(F.explode("parts").alias("part"), "commit")


def place(line: Column) -> Column:
    """The place of a row, to compare, but for its commit: job and line; for rows of plain files, the file's time, its path, the block and the row in it."""
    job = F.nullif(F.regexp_extract(F.col("_metadata.file_name"), PART, 2), F.lit(""))
    meta = lambda c: F.when(job.isNull(), F.col(f"_metadata.{c}"))
    return F.struct(
        F.lit(0).cast("long").alias("commit"), job.alias("job"), meta("file_modification_time").alias("time"), meta("file_path").alias("path"), meta("file_block_start").alias("block"),
        F.when(job.isNull(), F.monotonically_increasing_id()).otherwise(line).alias("line"),
    )
