"""Operator 11: words that are one edit apart, by a positional q-gram inverted index with a count filter.

Two words of lengths m and m or m + 1 that differ by one edit share their first m // 2 or their last m - m // 2 code points. So the index is dealt out by
half words: a cell holds the words of these two lengths that share a half (read backwards where it is the last), and every near pair meets in one cell. In a
cell, postings are the cell's words by bigram and position behind the shared half. A probe merges its postings by a heap, under the limits that one edit
sets: lengths m and m + 1, the same position or, for the longer words, the next. Words that share fewer bigrams than the edit leaves untouched
(all but two, of words of equal length; all but one of the shorter word's otherwise) go; what stays is verified. Cells of more than `cell` words are cut into
blocks by hash, and pairs of blocks become cells, so a task's index is bounded and no pair is lost. Each pair comes out once: from the cell of its
first half if that half is equal, else from the other.

Words: maximal runs of [A-Za-z\\u00C0-\\u00FF], A-Z lower-cased; with `damage`, one code point of some runs is deleted, as the contract of op11 says. A null
text has no words, a null id counts as empty; repeated rows count again; ties go to the first in code-point order; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, FACTOR, DAMAGE = 6, 5, 5, 199
#: Words of a cell at most; larger ones are cut. Words whose cells make a task.
CELL, TASK = 4000, 10_000


def words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", damage: int | None = DAMAGE) -> DataFrame:
    """word, n: the words of at least six code points with at least five occurrences."""
    runs = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("word"))
    if damage:
        h = F.crc32(F.concat_ws(":", "id", "word").cast("binary"))
        at = (h % F.length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        found = found.select(F.when(h % damage == 0, less).otherwise(F.col("word")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def cells(found: DataFrame, cell: int = CELL) -> DataFrame:
    """cell, m, w (the word as read in the cell), n, side: every word in the cells of both halves and of both frames, its own length and one less."""
    frame = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")
    each = found.select("word", "n", frame).where(F.col("m") >= LEAST_LENGTH)
    half = F.floor(F.col("m") / 2).cast("int")
    each = each.select("m", "n", F.explode(F.array(F.struct(F.lit("<").alias("end"), F.col("word").alias("w"), half.alias("h")), F.struct(F.lit(">").alias("end"), F.reverse("word").alias("w"), (F.col("m") - half).alias("h")))).alias("x"))
    each = each.select("m", "n", F.col("x.w").alias("w"), F.concat("x.end", F.col("m").cast("string"), F.lit(":"), F.substring("x.w", F.lit(1), F.col("x.h"))).alias("cell"))
    sizes = each.groupBy("cell").agg(F.count("*").alias("size"), F.max(F.length("w") == F.col("m")).alias("probes")).where("size > 1 and probes").select("cell", F.ceil(F.col("size") / cell).cast("int").alias("blocks"))
    each = each.join(sizes, "cell")
    block = F.pmod(F.xxhash64("w"), F.col("blocks")).cast("int")
    # A word of block b meets those of block c in the cell of the two, for every c; within b, in the cell of b alone.
    meets = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("with")
    each = each.withColumn("side", block).select("*", meets)
    of = F.concat("cell", F.lit("\n"), F.least("side", "with").cast("string"), F.lit(","), F.greatest("side", "with").cast("string"))
    return each.select(of.alias("cell"), "m", "w", "n", "side")


def near(a: str, b: str) -> bool:
    """Whether b is a with exactly one code point inserted or replaced (b is no shorter)."""
    i, most = 0, len(a)
    while i < most and a[i] == b[i]:
        i += 1
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else len(b) == most + 1 and a[i:] == b[i + 1 :])


def cell_pairs(cell: str, m: int, members: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, str, int]]:
    """The near pairs of a cell: word and count of the shorter (or first) word and of the other. members: word as read, count, side."""
    back, half = cell[0] == ">", m // 2
    shared = m - half if back else half
    blocks = cell.rpartition("\n")[2].split(",")
    members.sort()
    postings: dict = defaultdict(list)
    for i, (w, _, _) in enumerate(members):
        for p in range(shared - 1, len(w) - 1):
            postings[len(w), p, w[p : p + 2]].append(i)
    grams = m - shared  # bigrams of a probe behind those that lie in the shared half
    for i, (w, n, side) in enumerate(members):
        if len(w) != m:
            continue
        same, longer = [], []
        for p in range(shared - 1, m - 1):
            g = w[p : p + 2]
            same.append(postings.get((m, p, g), ()))
            longer += [x for at in (p, p + 1) if (x := postings.get((m + 1, at, g)))]
        for lists, least in ((same, max(1, grams - 2)), (longer, max(1, grams - 1))):
            for j, run in groupby(heapq.merge(*lists)):
                v, n2, side2 = members[j]
                if len(v) == m and j <= i or blocks[0] != blocks[1] and side == side2:
                    continue
                if sum(1 for _ in run) >= least and near(w, v):
                    a, b = (w[::-1], v[::-1]) if back else (w, v)
                    if not back or a[:half] != b[:half]:
                        yield a, n, b, n2


def pairs(found: DataFrame, cell: int = CELL) -> DataFrame:
    """a, n_a, b, n_b: each pair of near words once."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        rows = (r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(5))))
        for (key, m), group in groupby(rows, lambda r: r[:2]):
            out += cell_pairs(key, m, [(w, n, side) for _, _, w, n, side in group])
            if len(out) > 20_000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["a", "n_a", "b", "n_b"])

    # Merging costs much more time than its input has bytes, so tasks are sized by words; a given number isn't coalesced by size.
    tasks = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-found.count() // TASK))
    dealt = cells(found, cell).repartition(tasks, "cell").sortWithinPartitions("cell").select("cell", "m", "w", "n", "side")
    return dealt.mapInArrow(merge, "a string, n_a long, b string, n_b long")


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", damage: int | None = DAMAGE, cell: int = CELL) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    found = C.stored(words(docs, id_col, text, damage), "words")
    met = C.stored(pairs(found, cell), "pairs")
    both = met.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")).unionByName(met.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n_other")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("rank"), "other")).alias("best"))
    far = -F.col("best.rank") >= FACTOR * F.col("n")
    rows = found.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(far, F.col("best.other")).alias("form"), F.when(far, -F.col("best.rank")).alias("form_n")
    )
    rows = C.stored(rows, "forms")
    # Counts grow at least fivefold from word to form, so chains end, after a logarithm of the largest count; each round doubles how far a word looks.
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = C.stored(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            break
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle_sql() -> str:
    """DuckDB SQL for `variants` over documents: crc32 by its table, near pairs by words with one code point taken out."""
    return f"""
WITH RECURSIVE
bits AS (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bits),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[{LETTERS}]+')) AS run FROM documents),
each AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(key), 1), lambda i: ('0x' || substr(hex(key), i * 2 + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT run, n, encode(id || ':' || run) AS key FROM each), crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cuts AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT DISTINCT word, other, n_other FROM (
    SELECT a.word, b.word AS other, b.n AS n_other FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
    UNION ALL SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
    UNION ALL SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word)),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n_other, other)) AS other, max(n_other) AS n_other FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN n_other >= {FACTOR} * w.n THEN other END AS form, CASE WHEN n_other >= {FACTOR} * w.n THEN n_other END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at AND f.form IS NOT NULL),
roots AS (SELECT c.word, c.at AS root FROM chain c JOIN forms f ON f.word = c.at AND f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN roots r ON r.word = f.word"""
