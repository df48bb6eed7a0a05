"""Operator 9: resharding by minimum-cost flow: from old shard sizes and new capacities, transfers that move the fewest bytes.

Rows of an old shard are hashed into blocks; their sizes are a table of constant size, the only thing the driver sees. A minimum-cost flow
between old and new shards (a byte that stays costs nothing) fixes how many bytes go where. A shard's bytes are laid out block by block, and the
flows cut that line: whole blocks move, and a block that a cut goes through is divided row by row. So shards differ by less than
a row's size from their capacity at each cut. Rewriting stores the rows of every new shard as files; where the old shards are files themselves
(`reshard_files`), only shards that give or take bytes are written, and the files of the others stay what they are. Rows of one text may go to different shards.

Null texts have size 1. Repeated and null ids are rows like any others (a row's place in its block follows hashes of its id and text; equal rows are
interchangeable). Empty tables give no rows. Extra columns stay in the files; where one has a name that the operator uses (NAMES), it stays as own_<name>.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

SHARDS, BLOCKS, PART_BYTES = 16, 256, 32_000_000
NAMES = ("_size", "_old", "_hash", "_block", "_part", "_at", "_own", "_before", "_place", "_first", "n", "parts", "shard", "slot")


def minimum_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flows from each old to each new shard that ship all supply within capacity at least total cost (successive shortest paths)."""
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are below the total size")
    n, m = len(supply), len(capacity)
    source, sink, nodes = n + m, n + m + 1, n + m + 2
    edges: list[list[int]] = []  # to, room, cost; edge e and e ^ 1 are opposite
    out: list[list[int]] = [[] for _ in range(nodes)]

    def add(a: int, b: int, room: int, price: int) -> None:
        for x, y, r, p in ((a, b, room, price), (b, a, 0, -price)):
            out[x].append(len(edges))
            edges.append([y, r, p])

    for i, s in enumerate(supply):
        add(source, i, s, 0)
    first = len(edges)
    for i in range(n):
        for j in range(m):
            add(i, n + j, min(supply[i], capacity[j]), cost[i][j])
    for j, c in enumerate(capacity):
        add(n + j, sink, c, 0)
    while True:
        far, via, queue, waiting = [float("inf")] * nodes, [-1] * nodes, deque([source]), {source}
        far[source] = 0
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for e in out[a]:
                b, room, price = edges[e]
                if room and far[a] + price < far[b]:
                    far[b], via[b] = far[a] + price, e
                    if b not in waiting:
                        waiting.add(b)
                        queue.append(b)
        if via[sink] < 0:
            break
        path, node = [], sink
        while node != source:
            path.append(via[node])
            node = edges[via[node] ^ 1][0]
        push = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= push
            edges[e ^ 1][1] += push
    return [[edges[first + 2 * (i * m + j) + 1][1] for j in range(m)] for i in range(n)]


def even_capacities(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """Equal shares of the total, and room for a share `slack` more in each shard: with room, shards that are about even stay as they are."""
    return [total // shards + (k < total % shards) + int(slack * total / shards) for k in range(shards)]


def affected(flows: list[list[int]]) -> list[int]:
    """The shards, old or new, that give or take bytes."""
    moves = [(i, j) for i, row in enumerate(flows) for j, f in enumerate(row) if i != j and f]
    return sorted({k for move in moves for k in move})


def moved_bytes(flows: list[list[int]]) -> int:
    return sum(f for i, row in enumerate(flows) for j, f in enumerate(row) if i != j)


def size_of(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _own_names(docs: DataFrame) -> dict[str, str]:
    """The names under which columns of docs are kept."""
    names: dict[str, str] = {}
    for c in docs.columns:
        new = c
        while new.lower() in NAMES or new != c and new.lower() in {x.lower() for x in [*docs.columns, *names.values()]}:
            new = "own_" + new
        names[c] = new
    return names


def plan(docs: DataFrame, old: Column, capacities: list[int] | None = None, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text", blocks: int = BLOCKS, part_bytes: int = PART_BYTES, slack: float = 0.0) -> tuple[DataFrame, list[list[int]]]:
    """docs with _size, _old, _block, _part and shard; and the flows. old: the old shard of a row, 0 to shards - 1; any other value is an error.

    A block is laid out in parts of about part_bytes, so that no task has more than a part, however large the corpus is."""
    known = F.when(old.between(0, shards - 1), old.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no old shard: "), F.coalesce(old.cast("string"), F.lit("null")))).cast("int"))
    own = _own_names(docs)
    docs = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()), known.alias("_old"))
    id_col, text = own[id_col], own[text]
    rows = docs.withColumns({"_size": size_of(text), "_hash": F.xxhash64(F.col(id_col), F.col(text))})
    rows = rows.withColumn("_block", F.pmod("_hash", F.lit(blocks)).cast("int"))
    sizes = {(r[0], r[1]): r[2] for r in rows.groupBy("_old", "_block").agg(F.sum("_size")).collect()}  # at most shards * blocks rows
    parts = max(1, -(-max(sizes.values(), default=0) // part_bytes))
    rows = rows.withColumn("_part", F.pmod(F.shiftright("_hash", 24), F.lit(parts)).cast("int"))
    supply = [sum(v for (o, _), v in sizes.items() if o == k) for k in range(shards)]
    capacity = capacities or even_capacities(sum(supply), shards, slack)
    flows = minimum_cost_flow(supply, capacity, [[int(i != j) for j in range(len(capacity))] for i in range(shards)])
    starts, cuts = [], []
    for o in range(shards):
        at = 0
        for b in range(blocks):
            if (o, b) in sizes:
                starts.append((o, b, at))
                at += sizes[o, b]
        # what stays comes first, then the transfers in order of their targets
        line, ends = 0, []
        for t in sorted(range(len(capacity)), key=lambda t: (t != o, t)):
            if flows[o][t]:
                line += flows[o][t]
                ends.append((line, t))
        cuts.append(ends)
    spark = docs.sparkSession
    offsets = F.broadcast(spark.createDataFrame(starts, "_old int, _block int, _at long"))
    placed = rows.join(offsets, ["_old", "_block"])
    if parts > 1:
        own = rows.groupBy("_old", "_block", "_part").agg(F.sum("_size").alias("_own"))
        before = Window.partitionBy("_old", "_block").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        own = own.withColumn("_before", F.coalesce(F.sum("_own").over(before), F.lit(0))).drop("_own")
        placed = placed.join(own.hint("merge"), ["_old", "_block", "_part"]).withColumn("_at", F.col("_at") + F.col("_before")).drop("_before")
    inside = Window.partitionBy("_old", "_block", "_part").orderBy(F.shiftright("_hash", 8), "_hash", F.col(id_col)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_place", F.col("_at") + F.sum("_size").over(inside) - F.shiftright(F.col("_size") + 1, 1))
    shard = F.lit(None).cast("int")
    for o in range(shards):
        of = F.lit(cuts[o][-1][1] if cuts[o] else o)
        for end, t in reversed(cuts[o][:-1]):
            of = F.when(F.col("_place") < end, F.lit(t)).otherwise(of)
        shard = F.when(F.col("_old") == o, of).otherwise(shard)
    return placed.withColumn("shard", shard.cast("int")).drop("_at", "_place"), flows


def with_slots(placed: DataFrame) -> DataFrame:
    """Adds slot: gapless from 0 in each shard, by counts per block and ranks inside blocks."""
    spark = placed.sparkSession
    each = placed.groupBy("shard", "_old", "_block", "_part").agg(F.count("*").alias("n"))
    counts = each.groupBy("shard", "_old", "_block").agg(F.sum("n").alias("n"), F.max("_part").alias("parts")).orderBy("shard", "_old", "_block").collect()  # bounded by blocks and cuts
    starts, at = [], {}
    for r in counts:
        starts.append((r["shard"], r["_old"], r["_block"], at.get(r["shard"], 0)))
        at[r["shard"]] = at.get(r["shard"], 0) + r["n"]
    keys = ["shard", "_old", "_block"]
    table = F.broadcast(spark.createDataFrame(starts, "shard int, _old int, _block int, _first long"))
    found = placed.join(table, keys)
    if any(r["parts"] for r in counts):
        before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        own = each.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
        found = found.join(own.hint("merge"), [*keys, "_part"]).withColumn("_first", F.col("_first") + F.col("_before")).drop("_before")
    rank = F.row_number().over(Window.partitionBy("_old", "_block", "_part", "shard").orderBy("_hash")) - 1
    return found.withColumn("slot", F.col("_first") + rank).drop("_first")


def rewrite(placed: DataFrame, folder: str) -> None:
    """Stores the rows as files of their shards: folder/shard=k."""
    placed.write.partitionBy("shard").parquet(folder)


def _columns(placed: DataFrame) -> list[str]:
    """The columns that files of shards have, the shard last."""
    return [c for c in placed.columns if c != "shard"] + ["shard"]


def reshard(docs: DataFrame, old: Column, capacities: list[int] | None = None, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text", folder: str | None = None, **options) -> DataFrame:
    """Plans, rewrites and reads again: docs with _size, _old, shard and slot."""
    spark = docs.sparkSession
    folder = folder or C.new_path(spark, "shards")
    placed, _ = plan(docs, old, capacities, shards, id_col, text, **options)
    placed = placed.select(_columns(placed))
    rewrite(placed, folder)
    return with_slots(spark.read.schema(placed.schema).parquet(folder))


def reshard_files(spark: SparkSession, old_folder: str, folder: str, capacities: list[int] | None = None, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text", **options) -> tuple[list[str], list[list[int]]]:
    """Reshards old_folder/shard=k: the folder of each new shard, and the flows.

    Shards that give or take bytes are written to folder/shard=k, with the columns that they have; the others keep their folder below old_folder, and their
    texts are read for their sizes only. A shard without rows has no folder below `folder`; reading the list skips it (`read_shards`)."""
    docs = spark.read.parquet(old_folder)
    placed, flows = plan(docs.withColumnRenamed("shard", "_from"), F.col("_from"), capacities, shards, id_col, text, **options)
    touched = affected(flows)
    own = _own_names(docs.drop("shard"))
    # the old shard is the folder's name, so files of shards that stay are not opened
    changed = placed.where(F.col("_from").isin(touched)).select(*(F.col(f"`{n}`").alias(c) for c, n in own.items()), "shard")
    rewrite(changed, folder)
    return [f"{folder if k in touched else old_folder}/shard={k}" for k in range(len(flows[0]))], flows


def read_shards(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The rows of shards at several places, with the shard of each."""
    wanted: dict[str, list[int]] = {}
    for at, _, k in (f.rpartition("/shard=") for f in folders):
        wanted.setdefault(at, []).append(int(k))
    found = [spark.read.parquet(at).where(F.col("shard").isin(shards)) for at, shards in wanted.items()]
    return reduce(DataFrame.unionByName, found)
