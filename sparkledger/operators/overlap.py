"""Verbatim overlap of a benchmark and a corpus: the longest run of words that an item and a document share (§2.13's verbatim check and train overlap).

Runs of `least` words of the items go into a Bloom filter, one aggregate with a fixed number of bits; a document's runs are tested against it while the
document is read, so that only runs which may occur in the benchmark leave the scan. What is left is joined by the words themselves, and common runs are chained along
diagonals (the same distance between place in the document and place in the item), so lengths are exact. Words are runs without white space, as they are.

Null texts have no words; ids are carried as they are, and rows of one id are one text each only if their ids differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a common run at least; bits of the filter, and hashes of a run.
LEAST, BITS, HASHES = 8, 1 << 22, 3


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))


def _run(w: Column, at: Column, n: int) -> Column:
    return F.array_join(F.slice(w, at, n), " ")


def _places(run: Column) -> list[Column]:
    """The bits of a run: HASHES places of the filter."""
    return [F.pmod(F.xxhash64(run, F.lit(i)), F.lit(BITS)) for i in range(HASHES)]


def bloom_filter(runs: DataFrame, run: str = "run") -> DataFrame:
    """One row, bits: the filter of a column of texts, as an array of longs of fixed size."""
    at = runs.select(F.explode(F.array(*_places(F.col(run)))).alias("at"))
    word = F.shiftright("at", 6).cast("int")
    parts = at.groupBy(word.alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("w"))
    every = runs.sparkSession.range(BITS // 64).select(F.col("id").cast("int").alias("i"))  # words without a bit are zeros
    full = every.join(parts, "i", "left").select(F.struct("i", F.coalesce("w", F.lit(0).cast("long")).alias("w")).alias("x"))
    return full.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["w"]).alias("bits"))


def might_contain(bits: Column, run: Column) -> Column:
    """Whether a text may be among those of the filter; never false for one that is."""
    found = F.lit(True)
    for at in _places(run):
        found = found & (F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1)
    return found


def _starts(w: Column, n: int) -> Column:
    return F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))


def longest_common_runs(items: DataFrame, docs: DataFrame, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """item_id, doc_id, words (of the longest common run) and item_words, for each pair that shares a run of at least so many words."""
    own = items.select(F.col(item_id).alias("item"), words(F.col(text)).alias("w"))
    runs = own.select("item", F.size("w").alias("item_words"), F.explode(F.transform(_starts(F.col("w"), least), lambda i: F.struct(i.alias("at"), _run(F.col("w"), i, least).alias("run")))).alias("r")).select("item", "item_words", "r.*")
    bits = bloom_filter(runs)  # one row of a fixed size
    theirs = docs.select(F.col(doc_id).alias("doc"), words(F.col(text)).alias("w")).crossJoin(F.broadcast(bits))
    each = F.transform(_starts(F.col("w"), least), lambda i: F.struct(i.alias("at"), _run(F.col("w"), i, least).alias("run")))
    kept = theirs.select("doc", F.explode(F.filter(each, lambda r: might_contain(F.col("bits"), r["run"]))).alias("r")).select("doc", F.col("r.at").alias("doc_at"), F.col("r.run").alias("run"))
    met = runs.join(kept, "run").select("item", "item_words", "doc", "doc_at", (F.col("doc_at") - F.col("at")).alias("diagonal"))
    # Places of one chain follow each other: place less rank is the same for all of them.
    order = Window.partitionBy("item", "doc", "diagonal").orderBy("doc_at")
    chains = met.withColumn("chain", F.col("doc_at") - F.row_number().over(order)).groupBy("item", "item_words", "doc", "diagonal", "chain").agg(F.count("*").alias("n"))
    return chains.groupBy(F.col("item").alias(item_id), F.col("doc").alias(doc_id)).agg((F.max("n") + least - 1).alias("words"), F.max("item_words").cast("long").alias("item_words"))
