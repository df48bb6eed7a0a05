"""Exact search for windows of a fixed number of symbols that occur more than once in a corpus.

A symbol is a byte or a word. Whether a window repeats is decided for every window of every text, but most
windows are decided in groups, so that the rows to count are a fraction of the windows:

* Every window starts a stretch of `span` places; its *anchor* is the place with the least hash of `gram`
  symbols there. Equal windows have their anchors at equal distances, and the windows of one anchor are neighbours.
* All windows of an anchor contain the same *core* of symbols. Where the core occurs once, none of them repeats.
* All of them lie in one *hull*. Where the hull occurs again, all of them repeat.
* Where the core occurs again but the hull doesn't (at the edges of a copied passage), the same is asked of parts of its windows,
  and where that leaves them open the Rabin-Karp hash of every window is counted. Of equal hulls one stands for all of them, so a large group of copies counts its windows once.

Rows of a hot group meet only in aggregates that combine before the shuffle and in joins against one row per key,
which adaptive execution can split. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ROW, SPANS = "_row", "_spans"


@dataclass(frozen=True)
class Windows:
    """What counts as a window. symbols: (bytes, offsets) -> (symbol codes, offsets of each text's symbols)."""

    length: int
    span: int
    gram: int
    kind: str
    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    part: int = 0  # starts that are settled together once an anchor's windows differ; 0: none
    ordered: bool = False  # whether anchors carry their left hash and their number in the text

    @property
    def core(self) -> int:
        return self.length - self.span + 1


def byte_symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return C.BYTE_CODE[data], off


def word_symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, stops, woff = C.word_spans(data, off)
    return C.word_hashes(data, starts, stops), woff


def sliding_argmin(values: np.ndarray, width: int, most: int = 1 << 24) -> np.ndarray:
    """For each place the leftmost least (by its upper 36 bits) of the `width` values from there on.

    Values are packed with their places in 28 bits, so a longer array is taken in runs of `most` values that overlap by a width."""
    if len(values) > most:
        step = most - width + 1
        return np.concatenate([a + sliding_argmin(values[a : a + most], width, most) for a in range(0, len(values) - width + 1, step)])
    best = (values >> C.U64(28)) << C.U64(28) | np.arange(len(values), dtype=C.U64)
    have = 1
    while have * 2 <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if rest := width - have:
        best = np.minimum(best[:-rest], best[rest:])
    return (best & C.U64((1 << 28) - 1)).astype(np.int64)


def anchors(code: np.ndarray, off: np.ndarray, w: Windows) -> tuple[np.ndarray, ...]:
    """Per anchor: text number, place, first and last window start, hash of core, of hull and of the hull's part before the place.

    Places count in the concatenated symbols."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, C.U64),) * 3
    if len(code) < w.length:
        return none
    roll = C.Rolling(code, w.kind)
    at = np.arange(len(code) - w.gram + 1)
    least = sliding_argmin(roll(at, at + w.gram), w.span)
    starts, text = C.ranges(off[:-1], off[1:] - w.length + 1)
    if not len(starts):
        return none
    place = least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    place, text, lo, hi = place[first], text[first], starts[first], starts[last]
    left, right = np.maximum(place - w.span + 1, off[text]), np.minimum(place + w.length, off[text + 1])
    core = roll(place, place + w.core)
    hull = C.mix(roll(left, right) ^ C.mix((place - left).astype(C.U64) + C.U64(1)))
    return text, place, lo, hi, core, hull, roll(left, place)


def _scan(w: Windows, text_col: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in C.pieces(batch, text_col):
                code, soff = w.symbols(data, off)
                text, place, lo, hi, core, hull, left = anchors(code, soff, w)
                rows = part.column(part.schema.get_field_index(ROW)).to_numpy(zero_copy_only=False)
                base = soff[text]
                packed = (place - base) << 20 | (place - lo) << 10 | (place - hi)  # the distances are below span
                nth = np.arange(len(text)) - np.searchsorted(text, text)
                more = [pa.array(left.view(np.int64)), pa.array(nth)] if w.ordered else []
                yield pa.RecordBatch.from_arrays([pa.array(rows[text]), pa.array(packed), pa.array(core.view(np.int64)), pa.array(hull.view(np.int64)), *more], names=[ROW, "at", "core", "hull", "left", "nth"][: 4 + len(more)])

    return scan


def _asked(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of all anchors asked for: text number, place, greatest and least distance of a window start before it, known."""
    lists = part.column(part.schema.get_field_index("asked"))
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    at, known = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n), at >> 20, at >> 10 & 1023, at & 1023, known


def _each_part(w: Windows, text_col: str):
    """Core and hull of each part of `w.part` window starts, counted from the anchor back."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in C.pieces(batch, text_col):
                code, soff = w.symbols(data, off)
                roll = C.Rolling(code, w.kind)
                text, place, far, near, known = _asked(part)
                k, which = C.ranges(near // w.part, far // w.part + 1)
                text, place, far, near = text[which], place[which], far[which], near[which]
                here = place + soff[text]
                back, ahead = (k + 1) * w.part - 1, k * w.part
                left, right = np.maximum(here - back, soff[text]), np.minimum(here - ahead + w.length, soff[text + 1])
                salt = C.mix(k.astype(C.U64) + C.U64(1))
                core = roll(here - ahead, here - back + w.length) ^ salt
                hull = C.mix(roll(left, right) ^ C.mix((here - left).astype(C.U64) + C.U64(1))) ^ salt
                packed = place << 20 | np.minimum(far, back) << 10 | np.maximum(near, ahead)
                rows = part.column(part.schema.get_field_index(ROW)).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(rows[text]), pa.array(packed), pa.array(core.view(np.int64)), pa.array(hull.view(np.int64)), pa.array(known[which])], names=[ROW, "at", "core", "hull", "known"])

    return parts


def _each_window(w: Windows, text_col: str):
    """The hash of each window of the anchors listed with a text."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in C.pieces(batch, text_col):
                code, soff = w.symbols(data, off)
                text, place, far, near, known = _asked(part)
                start, which = C.ranges(place - far, place - near + 1)
                begin = start + soff[text[which]]
                rows = part.column(part.schema.get_field_index(ROW)).to_numpy(zero_copy_only=False)
                hashes = C.Rolling(code, w.kind)(begin, begin + w.length)
                yield pa.RecordBatch.from_arrays([pa.array(rows[text[which]]), pa.array(start), pa.array(known[which]), pa.array(hashes.view(np.int64))], names=[ROW, "start", "known", "window"])

    return windows


def _level(rows: DataFrame, decide: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Settles groups of windows (ROW, at, core, hull, known): the ranges of those that repeat, one row per hull that is still open, and the table to discard once these are read.

    known: the group's result is known already and it is only there for others to match.
    Aggregates are stored before rows are joined to them, so that either side is an exchange of its own and a hot key can be split."""
    cores = rows.groupBy("core").agg(F.count("*").alias("n"), (F.min("hull") == F.max("hull")).alias("whole")).where("n > 1").select("core", "whole")
    cores = C.stored(cores, "cores")
    shared = C.stored(rows.join(cores, "core"), "shared")
    C.discard(cores)
    if decide:
        shared = decide(shared)
    lo, hi = (F.shiftright("at", 20) - F.shiftright("at", 10).bitwiseAND(1023)).alias("lo"), (F.shiftright("at", 20) - F.col("at").bitwiseAND(1023)).alias("hi")
    sure = shared.where("whole and not known").select(ROW, lo, hi)
    unsure = shared.where("not whole")
    opened = C.stored(unsure.select("core").distinct(), "open") if decide else None
    partners = shared.join(opened, "core", "left_semi") if decide else unsure
    hulls = C.stored(partners.groupBy("hull").agg(F.count("*").alias("n"), F.min(F.struct(ROW, "at")).alias("one"), F.max("known").alias("known")), "hulls")
    again = unsure.where("not known").join(hulls.where("n > 1").select("hull"), "hull", "left_semi").select(ROW, lo, hi)
    spans = C.stored(sure.unionByName(again), "spans")
    C.discard(shared, *([opened] if decide else []))
    ask = hulls.select(f"one.{ROW}", F.struct(F.col("one.at").alias("at"), (F.col("known") | (F.col("n") > 1)).alias("known")).alias("ask"))
    return spans, ask.groupBy(ROW).agg(F.collect_list("ask").alias("asked")), hulls


def repeated_spans(docs: DataFrame, w: Windows, text: str = "text", decide: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """docs (with a column ROW, a number per row) and a column SPANS: ranges [lo, hi] of starts of windows that occur more than once.

    decide: given the stored anchors whose cores repeat, gives a stored table with `whole` (all windows of the anchor repeat) and discards the first.
    Null and short texts, and texts without a repeated window, get null."""
    C.small_batches(docs.sparkSession)
    slim = docs.select(ROW, text)
    found = slim.mapInArrow(_scan(w, text), f"{ROW} long, at long, core long, hull long" + ", left long, nth long" * w.ordered)
    found = C.stored(found, "anchors")
    spans, asked, hulls = _level(found.withColumn("known", F.lit(False)), decide)
    C.discard(found)
    open_texts, done = slim.join(asked, ROW), [hulls]
    if w.part:
        texts = C.stored(open_texts, "texts")
        parts = C.stored(texts.mapInArrow(_each_part(w, text), f"{ROW} long, at long, core long, hull long, known boolean"), "parts")
        more, asked, others = _level(parts)
        C.discard(parts)
        spans = spans.unionByName(more)
        open_texts, done = texts.drop("asked").join(asked, ROW), [hulls, texts, others]
    each = open_texts.mapInArrow(_each_window(w, text), f"{ROW} long, start long, known boolean, window long")
    each = C.stored(each, "windows")
    C.discard(*done)
    twice = each.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    single = each.where("not known").join(C.stored(twice, "twice"), "window", "left_semi").select(ROW, F.col("start").alias("lo"), F.col("start").alias("hi"))
    spans = spans.unionByName(single).groupBy(ROW).agg(F.collect_list(F.struct("lo", "hi")).alias(SPANS))
    return docs.join(spans, ROW, "left")


def span_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lo, hi and text number of the ranges in a SPANS column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    return flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)
