"""Operator 2: removal of byte strings that repeat, over a suffix order built with difference covers.

Sorting all suffixes of all bytes would shuffle some tens of bytes for each byte of text, several times. Instead
the suffixes that are sorted start at a sample of places that any two equal strings of `length` bytes share at the same
distance, which is what a difference cover is for. Here the sample is chosen by content (repeats.py), so it has one place in about a
hundred bytes, and places whose following bytes occur once drop out first. On this sample's sequence of phrases:

1. Phrase triples at numbers 1 and 2 modulo 3 of each text are sorted and named in that order.
2. The names are a shorter text; triples of names are sorted and named again, so a name stands for nine phrases.
3. Suffixes at number 0 are merged by their first phrase and the name of the suffix after it. Two suffixes of any two remainders
   are comparable at a shift of 0, 1 or 2, where both have names (the cover's property), so equal prefixes meet under one of three keys.
4. Neighbours with equal prefixes of `length` bytes and equal bytes before the place settle all strings around the place.

Strings that begin in bytes which are not sampled are merged through the sampled place at their shift. What the order leaves open (at the
edges of a repeat, and where nine phrases are shorter than `length`) gets an exact check of every single string.

Matches never cross texts. Null is empty. Repeated rows are rows of their own and so repeat each other. Empty tables give no rows.
Extra columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import repeats as R

LENGTH = 400


def windows(length: int = LENGTH) -> R.Windows:
    gram = max(1, min(16, length // 8))
    return R.Windows(length, max(1, min(200, length // 2, length - gram + 1)), gram, "byte", R.byte_symbols, max(1, length // 16), True)


def named(rows: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Adds names of the key tuples that follow their order: equal tuples get one name, greater tuples greater names. Also gives the stored table of names."""
    tuples = rows.select(*keys).distinct().orderBy(*keys)
    names = C.stored(tuples.withColumn(name, F.monotonically_increasing_id() + 1), "names")
    same = [F.col(f"r.{k}") == F.col(f"n.{k}") for k in keys]
    return rows.alias("r").join(names.alias("n"), same).select("r.*", f"n.{name}"), names


def suffix_names(phrases: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """phrases: _row, nth (number in its text), run, phrase. Adds `rank` where nth % 3 > 0: the name, in sorted order, of the nine phrases from there on.

    A run is an unbroken stretch of phrases; past its end all symbols are 0. Also gives the stored tables that the result reads."""
    run = Window.partitionBy(R.ROW, "run").orderBy("nth")
    ahead = lambda c, k: F.coalesce(F.lead(c, k).over(run), F.lit(0))
    triples = phrases.withColumns({"p1": ahead("phrase", 1), "p2": ahead("phrase", 2)})
    sample, first = named(triples.where("nth % 3 > 0").select(R.ROW, "run", "nth", F.col("phrase").alias("k0"), F.col("p1").alias("k1"), F.col("p2").alias("k2")), ["k0", "k1", "k2"], "name")
    chain = Window.partitionBy(R.ROW, "run", F.col("nth") % 3).orderBy("nth")
    further = lambda k: F.coalesce(F.lead("name", k).over(chain), F.lit(0))
    longer = sample.select(R.ROW, "run", "nth", "name").withColumns({"name1": further(1), "name2": further(2)})
    ranks, second = named(longer, ["name", "name1", "name2"], "rank")
    return triples.join(ranks.select(R.ROW, "nth", "rank"), [R.ROW, "nth"], "left"), [first, second]


def equal_prefixes(length: int, core: int):
    """Sets `whole` for the anchors whose suffix has an equal prefix of `length` bytes elsewhere, with equal bytes before it."""

    def decide(shared: DataFrame) -> DataFrame:
        place = F.shiftright("at", 20)
        text = Window.partitionBy(R.ROW).orderBy("nth")
        run = Window.partitionBy(R.ROW, "run").orderBy("nth")
        rows = shared.withColumn("run", F.col("nth") - F.row_number().over(text))
        step = F.coalesce(F.lead(place, 1).over(run) - place, F.lit(0))
        rows = rows.withColumn("phrase", F.xxhash64("core", step)).withColumn("reach", F.max(place).over(run.rowsBetween(0, 8)) + core - place)
        rows = C.stored(rows, "phrases")
        ranked, tables = suffix_names(rows)
        ranked = ranked.withColumns({"r1": F.lead("rank", 1).over(run), "r2": F.lead("rank", 2).over(run)})
        rest = F.col("nth") % 3

        def key(shift: int, *parts: Column) -> Column:
            return F.xxhash64(F.lit(shift), "left", *parts)

        zero = F.lit(0).cast("long")
        at0, at1 = key(0, F.coalesce("rank", zero)), key(1, F.col("phrase"), F.coalesce("r1", zero))
        at2 = key(2, F.col("phrase"), F.col("p1"), F.coalesce("r2", zero))
        keys = F.when(rest == 0, F.array(at1, at2)).when(rest == 1, F.array(at0, at1)).otherwise(F.array(at0, at2))
        keyed = C.stored(ranked.select(R.ROW, "nth", "reach", keys.alias("keys")).where(F.col("reach") >= length), "ranked")
        each = keyed.select(R.ROW, "nth", F.explode("keys").alias("key"))
        again = C.stored(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "equal")
        settled = each.join(again, "key", "left_semi").select(R.ROW, "nth").distinct().withColumn("equal", F.lit(True))
        out = shared.drop("whole").join(settled, [R.ROW, "nth"], "left").withColumn("whole", F.coalesce("equal", F.lit(False))).drop("equal", "left", "nth")
        out = C.stored(out, "decided")
        C.discard(shared, rows, keyed, again, *tables)
        return out

    return decide


def _clean(length: int, id_col: str, text_col: str):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in C.pieces(batch, text_col):
                lo, hi, text = R.span_arrays(part.column(part.schema.get_field_index(R.SPANS)))
                gone = C.covered(len(data), lo + off[text], hi + off[text] + length)
                total = np.concatenate([[0], np.cumsum(gone)])
                begin = gone.copy()
                begin[1:] &= ~gone[:-1]
                begin[off[:-1][off[:-1] < len(data)]] |= gone[off[:-1][off[:-1] < len(data)]]
                runs = np.concatenate([[0], np.cumsum(begin)])
                kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(id_col)), pa.array(np.diff(off)), pa.array(total[off[1:]] - total[off[:-1]]), pa.array(runs[off[1:]] - runs[off[:-1]]), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                    names=[id_col, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
                )

    return clean


def remove_repeated_strings(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id_col, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes left) and kept_sha256."""
    w = windows(length)
    found = R.repeated_spans(C.with_row_key(docs.select(id_col, text), R.ROW), w, text, equal_prefixes(length, w.core))
    kind = docs.schema[id_col].dataType.simpleString()
    return found.mapInArrow(_clean(length, id_col, text), f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
