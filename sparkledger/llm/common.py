"""Shared helpers of the corpus operators: shared storage, Arrow text buffers, vectorised hashing.

All hashing is a fixed function of content (no per-process seeds), so a task that is run again
after an executor is lost gives the same rows.
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_made: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, on one machine, a temporary one where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="ledger-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_all() -> None:
    for spark, path in _made:
        try:
            _remove(spark, path)
        except Exception:  # the session may have ended before; the folder is the cluster's to clear
            return


atexit.register(_remove_all)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, on storage that outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    gc.collect()
    spark._jvm.System.gc()  # lets the driver drop the shuffle files of plans that are done
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more: whatever was made from them is stored itself."""
    for t in tables:
        _remove(t.sparkSession, t._stored_at)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4_000_000) -> None:
    """Arrow batches of at most so many rows and bytes (a longer row is a batch by itself), so that Python workers hold little text at a time."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").removesuffix("b")
        if not now.isdigit() or int(now) > most or int(now) <= 0:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column as one array, and the n+1 offsets of its rows. Null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts a batch between rows into runs of about `limit` text bytes (a longer text is a run by itself)."""
    data, off = text_buffers(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Byte codes and the two multipliers of the rolling hashes: any fixed odd numbers do.
BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASES = {"byte": 0x5851F42D4C957F2D, "word": 0xD1342543DE82EF95}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (grown by doubling, kept per process)."""
    up, down = _powers.get(kind, (np.ones(1, U64), np.ones(1, U64)))
    base = _BASES[kind]
    inv = pow(base, -1, 1 << 64)
    while len(up) < n:
        m = len(up)
        up = np.concatenate([up, up * U64(pow(base, m, 1 << 64))])
        down = np.concatenate([down, down * U64(pow(inv, m, 1 << 64))])
    if len(up) <= 1 << 21:
        _powers[kind] = (up, down)
    return up, down


class Rolling:
    """Rabin-Karp hashes of any run of symbols in constant time each: prefix sums of s[i] * base**i modulo 2**64."""

    def __init__(self, symbols: np.ndarray, kind: str):
        n = len(symbols)
        up, self.down = powers(kind, n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(symbols * up[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(U64) * U64(0x9E3779B97F4A7C15))


SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the words ([^\\x20\\x09-\\x0D]+) in the bytes of several texts, and n+1 offsets of each text's words."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~SEPARATOR[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    stops = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, stops, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return Rolling(BYTE_CODE[data], "byte")(starts, stops)


def ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, one after the other, and for each the number of its range."""
    n = np.maximum(stops - starts, 0)
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + starts[which], which


def covered(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of n places lie in a range."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stops, -1)
    return np.cumsum(edge[:-1]) > 0


#: Plan nodes after which rows may come in another order or number of partitions when a plan runs again.
_UNSTABLE = re.compile(r"(?m)^[\s:+|-]*(?:\S*Join|Aggregate|Repartition\S*|Rebalance\S*|Sort|Window|GlobalLimit|LocalLimit|Sample|Distinct|Deduplicate|FlatMapGroups\S*|CoGroup\S*|Intersect|Except)\b")


def aside(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str], Callable[[DataFrame], DataFrame]]:
    """docs with its columns that begin with an underscore under other names, so that no column of an operator clashes with them; the name that a
    column has there; and what selects and names the columns of docs again."""
    names: dict[str, str] = {}
    for c in docs.columns:
        new = c
        while new.startswith("_") or new != c and new.lower() in {x.lower() for x in [*docs.columns, *names.values()]}:
            new = "own" + new
        names[c] = new
    return docs.toDF(*names.values()), lambda c: names.get(c, c), lambda out: out.select(*(f"`{n}`" for n in names.values())).toDF(*names)


def with_row_key(docs: DataFrame, key: str) -> DataFrame:
    """A number for each row, so that repeated or null ids stay rows of their own.

    Several jobs number the same rows, also after executors are lost, so the layout of file partitions is kept from following the number of
    live cores, and anything but a scan with projections and filters is stored first."""
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    if _UNSTABLE.search(docs._jdf.queryExecution().optimizedPlan().toString()):
        docs = stored(docs, "rows")
    return docs.withColumn(key, F.monotonically_increasing_id())
