"""Operator 12: approximate nearest neighbours by inner product, over robust-pruned directed graphs.

Equal vectors are one node that carries its least ids, so a vector which a third of all rows share is one node too. Nodes are dealt to shards by a hash,
within bands of norms (powers of two), and every shard gets a graph: greedy searches propose neighbours, relaxed distance pruning keeps diverse links.
A coordinate more, the square root of M^2 - |x|^2 with the shard's largest norm M, turns the largest inner product into the least distance. Blocks of the
distinct query vectors meet every shard, one beam search each, and the best of all shards are ranked by the inner product in double precision.
Every row is indexed; a task holds one shard (about `shard` nodes) and one block of queries, whatever the size of the table.

Rows without an id, and rows whose vector is null, zero, of another length than the most frequent one, or holds null or non-finite entries, take no part.
Repeated rows are rows: each is a candidate of the other, and each is a query. Ties go to the smaller id. An empty table gives no rows. Extra columns are not read.
Recall against brute force (20 nearest) is in the README; tests hold it at 0.9 and more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import graph as G
from . import vectors as V

#: Nodes of a shard and beam width of a search; queries of a block, and blocks that one task of a shard searches.
SHARD, BEAM = 8192, 150
QUERIES, BLOCKS = 1024, 4


def _rows(df: DataFrame, id_col: str, col: str, dim: int, double: bool) -> DataFrame:
    """id, vec (bytes) and band (of the norm) of the rows that take part."""
    kind = "<f8" if double else "<f4"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = V.matrix(batch.column(1), dim)
            some = found.any(axis=1)
            at, found = at[some], found[some] + 0.0  # no negative zeros: equal vectors have equal bytes
            _, band = np.frexp(np.abs(found).max(axis=1))
            _, more = np.frexp(np.linalg.norm(np.ldexp(found, -band[:, None]), axis=1))
            raw = found.astype(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([v.tobytes() for v in raw], pa.binary()), pa.array((band + more).astype(np.int32))], names=["id", "vec", "band"])

    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), col).mapInArrow(read, "id long, vec binary, band int")


def _unit(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors with the coordinate more, as unit vectors; and the scale."""
    size = np.linalg.norm(found, axis=1)
    most = size.max()
    x = np.empty((len(found), found.shape[1] + 1), np.float32)
    x[:, :-1] = found / most
    x[:, -1] = np.sqrt(np.maximum(0, 1 - (size / most) ** 2))
    return x


def _graphs(nodes: DataFrame, dim: int, kind: str) -> DataFrame:
    """One row a shard: vectors, links, entry and the ids of the nodes, as bytes."""

    def build(key, part):
        part = part.sort_values("vec")
        found = np.frombuffer(b"".join(part.vec), kind).reshape(-1, dim).astype(float)
        found = np.ldexp(found, -int(part.band.iloc[0]))
        links, entry = G.build(_unit(found))
        ids = [np.asarray(i, np.int64) for i in part.ids]
        return type(part)(
            {"shard": [key[0]], "entry": [entry], "band": [part.band.iloc[0]], "vecs": [b"".join(part.vec)], "links": [links.tobytes()], "ids": [np.concatenate(ids).tobytes()], "counts": [np.array([len(i) for i in ids], np.int32).tobytes()]}
        )

    return nodes.groupBy("shard").applyInPandas(build, "shard int, entry int, band int, vecs binary, links binary, ids binary, counts binary")


def _blocks(queries: DataFrame) -> DataFrame:
    """Query vectors in blocks: block, qnos and vecs as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, QUERIES):
                part = batch.slice(a, QUERIES)
                no = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([int(no[0])]), pa.array([no.tobytes()], pa.binary()), pa.array([b"".join(part.column(1).to_pylist())], pa.binary())], names=["block", "qnos", "qvecs"])

    return queries.select("qno", "vec").mapInArrow(pack, "block long, qnos binary, qvecs binary")


def _search(dim: int, kind: str, k: int, beam: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for r in batch.to_pylist():
                if held is None or held[0] != r["shard"]:
                    vecs = np.frombuffer(r["vecs"], kind).reshape(-1, dim).astype(float)
                    counts = np.frombuffer(r["counts"], np.int32)
                    held = r["shard"], vecs, _unit(np.ldexp(vecs, -r["band"])), np.frombuffer(r["links"], np.int32).reshape(len(vecs) + 1, -1), counts, np.cumsum(counts) - counts, np.frombuffer(r["ids"], np.int64)
                _, vecs, x, links, counts, first, ids = held
                qvecs, qnos = np.frombuffer(r["qvecs"], kind).reshape(-1, dim).astype(float), np.frombuffer(r["qnos"], np.int64)
                for a in range(0, len(qnos), G.BATCH):
                    yield _best(qvecs[a : a + G.BATCH], qnos[a : a + G.BATCH], vecs, x, links, r["entry"], counts, first, ids, k, beam)

    return search


def _best(q, qnos, vecs, x, links, entry, counts, first, ids, k: int, beam: int) -> pa.RecordBatch:
    """The k best rows of a shard for each query of a block."""
    unit = np.zeros((len(q), q.shape[1] + 1), np.float32)
    top = q / np.abs(q).max(axis=1, keepdims=True)
    unit[:, :-1] = top / np.linalg.norm(top, axis=1, keepdims=True)
    node, d = G.beam_search(x, links, entry, unit, max(beam, k))
    order = np.argsort(d, axis=1, kind="stable")[:, : 2 * k]  # single precision ranks them only nearly
    b, j = np.nonzero(np.isfinite(np.take_along_axis(d, order, 1)))
    node = np.take_along_axis(node, order, 1)[b, j]
    score = (q[b] * vecs[node]).sum(axis=1)
    same = (q[b] == vecs[node]).all(axis=1)
    at, of = C.ranges(first[node], first[node] + counts[node])
    b, score, same, ids = b[of], score[of], same[of], ids[at]
    order = np.lexsort((ids, -score, b))
    rank = np.arange(len(order)) - np.searchsorted(b[order], b[order])
    order = order[rank < k]
    return pa.RecordBatch.from_arrays([pa.array(qnos[b[order]]), pa.array(ids[order]), pa.array(score[order]), pa.array(same[order])], names=["qno", "vec_id", "score", "same"])


def nearest(df: DataFrame, queries: Column, id_col: str = "vec_id", col: str = "embedding", k: int = 20, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows of each row that `queries` holds for."""
    spark, double = df.sparkSession, df.schema[col].dataType.elementType != T.FloatType()
    kind = "<f8" if double else "<f4"
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    C.small_batches(spark)
    dim = V.width(df, col)
    if not dim:
        return empty
    rows = C.stored(_rows(df, id_col, col, dim, double), "vectors")
    sizes = rows.groupBy("band").agg(F.count_distinct("vec").alias("n")).orderBy("band").collect()  # a row a power of two at most
    if not sizes:
        return empty
    count = {r.band: -(-r.n // shard) for r in sizes}
    start = {b: sum(count[c] for c in count if c < b) for b in count}
    shards = sum(count.values())
    of = F.create_map(*(F.lit(x) for b in count for x in (b, F.struct(F.lit(start[b]).alias("start"), F.lit(count[b]).alias("n")))))[F.col("band")]

    least = Window.partitionBy("vec", "band").orderBy("id")
    nodes = rows.withColumn("_no", F.row_number().over(least)).where(F.col("_no") <= k + 1).groupBy("vec", "band").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = nodes.withColumn("shard", (of["start"] + F.pmod(F.xxhash64("vec"), of["n"])).cast("int"))
    graphs = C.stored(_graphs(nodes.repartition(max(shards, 1), "shard"), dim, kind), "graphs")

    asked = rows.where(queries).select("id", "vec")
    distinct = C.stored(C.with_row_key(C.stored(asked.select("vec").distinct(), "asked"), "qno"), "queries")
    blocks = C.stored(_blocks(distinct), "blocks")
    turns = -(-blocks.count() // BLOCKS)  # each shard is read by so many tasks, so that its queries don't all wait for one
    if not turns:
        return empty
    parts = 2 * shards * turns
    left = blocks.withColumn("turn", F.pmod(F.xxhash64("block"), F.lit(turns)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = graphs.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    pairs = left.repartition(parts, "shard", "turn").join(right.repartition(parts, "shard", "turn").hint("merge"), ["shard", "turn"])
    found = pairs.select("shard", "entry", "band", "vecs", "links", "ids", "counts", "qnos", "qvecs").mapInArrow(_search(dim, kind, k + 1, beam), "qno long, vec_id long, score double, same boolean")

    best = Window.partitionBy("qno").orderBy(F.desc("score"), "vec_id")
    found = C.stored(found, "found").withColumn("_no", F.row_number().over(best)).where(F.col("_no") <= k + 1)
    lists = distinct.join(found.groupBy("qno").agg(F.sort_array(F.collect_list(F.struct("_no", "vec_id", "score", "same"))).alias("list")), "qno").select("vec", "list")
    every = asked.join(lists.hint("merge"), "vec").select("id", "list")
    # A query's own row is one entry of its own vector with its id; where it isn't among the best, nothing is taken out.
    own = F.array_min(F.transform(F.filter("list", lambda x: x.same & (x.vec_id == F.col("id"))), lambda x: x._no))
    others = F.slice(F.filter("list", lambda x: own.isNull() | (x._no != own)), 1, k)
    out = every.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
