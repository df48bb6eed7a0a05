"""Operator 6: near-duplicate groups by improved consistent weighted sampling over TF-IDF word shingles.

A text is a weighted set of shingles of five words (words: runs without white space, lower case for ASCII letters); a shingle weighs its count times
the mean inverse document frequency of its words. Document frequencies cover all rows, in a fixed number of hashed
buckets, so they are a table of constant size. Samples (Ioffe 2010) are cut into bands; pairs of rows that share a band are verified by exact
weighted Jaccard similarity, and links are closed to classes. First each row meets two rows of its band (the least and a hashed one); where a band has
rows of several classes left, an exact filter on what they have more or less of than one of its rows leaves the pairs to verify (`_complete`).
Equal word sequences (by a 128-bit digest) are one node from the start, so groups of copies never meet in a band.

A text of under five words is one shingle. Null texts and texts without words are classes of their own. Repeated rows are copies.
Null ids are allowed: the class id is the least id there is. Extra columns are left out here and kept by `keep_one`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .components import components

SHINGLE, SIMILARITY, BANDS, ROWS, BUCKETS, POOL = 5, 0.8, 14, 3, 1 << 18, 1 << 16
ROW = "_row"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = _LOWER[data]
    starts, stops, woff = C.word_spans(data, off)
    return C.word_hashes(data, starts, stops), woff


def _digests(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a 128-bit BLAKE2 digest of each text's words in lower case, joined by single spaces."""
    data = _LOWER[data]
    gap = C.SEPARATOR[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    keep[off[:-1][off[:-1] < len(data)]] = True  # a text's first byte stays, whatever the text before ends with
    kept, at = np.where(gap, np.uint8(32), data)[keep].tobytes(), np.concatenate([[0], np.cumsum(keep)])[off].tolist()
    both = np.frombuffer(b"".join([hashlib.blake2b(kept[a:b].strip(b" "), digest_size=16).digest() for a, b in zip(at, at[1:])]), C.U64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _frequencies(text_col: str, buckets: int, slices: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(buckets, np.int64), 0
        for batch in batches:
            for part, data, off in C.pieces(batch, text_col):
                code, woff = _words(data, off)
                rows += part.num_rows
                bucket = (code % C.U64(buckets)).astype(np.int64)
                text = np.repeat(np.arange(part.num_rows), np.diff(woff))
                total += np.bincount(np.unique(text * buckets + bucket) % buckets, minlength=buckets)
        parts = np.append(total, np.zeros(-buckets % slices, np.int64)).reshape(slices, -1)
        yield pa.RecordBatch.from_arrays([pa.array([*range(slices), -1]), pa.array([*(p.tobytes() for p in parts), np.array([rows], np.int64).tobytes()], pa.binary())], names=["slice", "counts"])

    return count


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
    return pa.table({"slice": table.column("slice").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def inverse_frequencies(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """log((rows + 1) / (rows with a word of the bucket + 1)) for each bucket of words, over all rows. Of constant size."""
    slices = 64
    C.small_batches(docs.sparkSession)
    rows = docs.select(text).mapInArrow(_frequencies(text, buckets, slices), "slice long, counts binary").groupBy("slice").applyInArrow(_add, "slice long, counts binary").collect()
    got = {r.slice: np.frombuffer(bytes(r.counts), np.int64) for r in rows}
    if not got:
        return np.ones(buckets, np.float32)
    df = np.concatenate([got[i] for i in range(slices)])[:buckets]
    return np.log((got[-1][0] + 1.0) / (df + 1.0)).astype(np.float32)


def _totals(text: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text, weight, n).astype(np.float64)  # without any weights the counts are integers


def weighted_shingles(code: np.ndarray, woff: np.ndarray, idf: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and weight of the distinct shingles of each text, ordered by both."""
    count = np.diff(woff)
    size = np.minimum(count, n)
    start, text = C.ranges(woff[:-1], woff[1:] - size + (size > 0))
    stop = start + size[text]
    roll = C.Rolling(code, "word")
    h = roll(start, stop)
    sums = np.concatenate([[0.0], np.cumsum(idf[(code % C.U64(len(idf))).astype(np.int64)], dtype=np.float64)])
    mean = (sums[stop] - sums[start]) / np.maximum(size[text], 1)
    order = np.lexsort((h, text))
    h, text, mean = h[order], text[order], mean[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    tf = np.diff(np.append(first, len(h)))
    return text[first], h[first], np.maximum(np.round(mean[first], 4), 1e-3) * tf


class Sampler:
    """Consistent weighted samples: equal for two sets with the probability of their weighted Jaccard similarity."""

    def __init__(self, hashes: int, pool: int = POOL, seed: int = 20101213):
        rng = np.random.default_rng(seed)
        self.pool = pool
        self.r = rng.gamma(2.0, 1.0, (pool, hashes)).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, (pool, hashes))).astype(np.float32)
        self.beta = rng.random((pool, hashes), np.float32)

    def __call__(self, text: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int, step: int = 50_000) -> np.ndarray:
        """A row of 64-bit samples for each text (0 for a text without shingles)."""
        hashes = self.r.shape[1]
        best = np.full((texts, hashes), np.inf, np.float32)
        out = np.zeros((texts, hashes), C.U64)
        for a in range(0, len(h), step):
            t_, h_, w_ = text[a : a + step], h[a : a + step], weight[a : a + step]
            b = (h_ % C.U64(self.pool)).astype(np.int64)
            r = self.r[b]
            beta = self.beta[b]
            t = np.floor(np.log(w_).astype(np.float32)[:, None] / r + beta)
            score = self.log_c[b] - r * (t - beta + 1)
            first = np.flatnonzero(np.append(True, t_[1:] != t_[:-1]))
            least = np.minimum.reduceat(score, first, axis=0)
            hit_h, hit = np.nonzero((score == np.repeat(least, np.diff(np.append(first, len(t_))), axis=0)).T)
            key = hit_h * texts + t_[hit]
            once = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            hit, hit_h = hit[once], hit_h[once]
            at = t_[hit]
            value, s = C.mix(h_[hit] ^ C.mix(t[hit, hit_h].astype(np.int64).astype(C.U64))), score[hit, hit_h]
            better = s < best[at, hit_h]
            best[at[better], hit_h[better]] = s[better]
            out[at[better], hit_h[better]] = value[better]
        return out


def _signatures(text_col: str, idf, bands: int, rows: int, shingle: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(bands * rows)
        for batch in batches:
            for part, data, off in C.pieces(batch, text_col):
                code, woff = _words(data, off)
                n = part.num_rows
                shingles = weighted_shingles(code, woff, idf.value, shingle)
                samples = sampler(*shingles, n).reshape(n, bands, rows)
                band = np.zeros((n, bands), C.U64) + np.arange(1, bands + 1, dtype=C.U64)
                for k in range(rows):
                    band = C.mix(band ^ samples[:, :, k]) + C.U64(k)
                digest, other = _digests(data, off)
                has = np.diff(woff) > 0
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(has * bands)).astype(np.int32)), pa.array(band[has].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(ROW)), pa.array(digest.view(np.int64), mask=~has), pa.array(other.view(np.int64), mask=~has), lists, pa.array(_totals(*shingles[::2], n))],
                    names=[ROW, "d1", "d2", "bands", "weight"],
                )

    return sign


def _verify(idf, shingle: int, least: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in C.pieces(batch, "text_a"):
                data_b, off_b = C.text_buffers(part.column(part.schema.get_field_index("text_b")))
                n = part.num_rows
                t1, h1, w1 = weighted_shingles(*_words(data, off), idf.value, shingle)
                t2, h2, w2 = weighted_shingles(*_words(data_b, off_b), idf.value, shingle)
                t, h, w = np.concatenate([t1, t2]), np.concatenate([h1, h2]), np.concatenate([w1, w2])
                order = np.lexsort((h, t))
                t, h, w = t[order], h[order], w[order]
                same = np.flatnonzero((t[1:] == t[:-1]) & (h[1:] == h[:-1]))
                both = np.bincount(t[same], np.minimum(w[same], w[same + 1]), n)
                total = np.bincount(t1, w1, n) + np.bincount(t2, w2, n) - both
                keep = both >= least * total - 1e-9
                a, b = (part.column(part.schema.get_field_index(c)).filter(pa.array(keep)) for c in "ab")
                yield pa.RecordBatch.from_arrays([a, b, pa.array((both / np.maximum(total, 1e-12))[keep])], names=["a", "b", "similarity"])

    return verify


def _texts_of(slim: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (a, b) with text_a and text_b, and the stored texts that it reads."""
    # the rows of pairs grow with the input, so they are never broadcast
    texts = slim.join(pairs.select(F.col("a").alias(ROW)).union(pairs.select(F.col("b").alias(ROW))).distinct().hint("merge"), ROW, "left_semi")
    texts = C.stored(texts, "texts")
    return pairs.join(texts.select(F.col(ROW).alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col(ROW).alias("b"), F.col("text").alias("text_b")), "b"), texts


def _links(slim: DataFrame, pairs: DataFrame, idf, shingle: int, least: float) -> DataFrame:
    """The stored pairs that are similar, with their texts compared in full."""
    sides, texts = _texts_of(slim, pairs)
    links = C.stored(sides.mapInArrow(_verify(idf, shingle, least), "a long, b long, similarity double"), "links")
    C.discard(texts)
    return links


def _differences(idf, shingle: int):
    """For pairs of a hub a and a row b: the weights of both, what both have, and the shingles whose weights differ with the difference.

    A shingle of which b has more than a, and one of which it has less, are different elements."""

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in C.pieces(batch, "text_b"):
                data_a, off_a = C.text_buffers(part.column(part.schema.get_field_index("text_a")))
                n = part.num_rows
                t1, h1, w1 = weighted_shingles(*_words(data_a, off_a), idf.value, shingle)
                t2, h2, w2 = weighted_shingles(*_words(data, off), idf.value, shingle)
                t, h, w = np.concatenate([t1, t2]), np.concatenate([h1, h2]), np.concatenate([-w1, w2])
                order = np.lexsort((h, t))
                t, h, w = t[order], h[order], w[order]
                first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (h[1:] != h[:-1]))) if len(t) else np.zeros(0, np.int64)
                gap = np.add.reduceat(w, first) if len(t) else w
                t, h = t[first], h[first]
                some = np.abs(gap) > 1e-9
                t, h, gap = t[some], h[some], gap[some]
                element = C.mix(h ^ C.U64(1)) ^ (gap > 0).astype(C.U64)
                at = np.searchsorted(t, np.arange(n + 1)).astype(np.int32)
                more = _totals(t, np.maximum(gap, 0), n)
                less = _totals(t, np.maximum(-gap, 0), n)
                both = _totals(t2, w2, n) - more
                total = _totals(t1, w1, n) + more
                names = ["a", "b", "similarity", "more", "less", "weight_a", "element", "gap"]
                a, b = (part.column(part.schema.get_field_index(c)) for c in "ab")
                yield pa.RecordBatch.from_arrays(
                    [a, b, pa.array(both / np.maximum(total, 1e-12)), pa.array(more), pa.array(less), pa.array(_totals(t1, w1, n)), pa.ListArray.from_arrays(at, pa.array(element.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(np.abs(gap)))], names=names
                )

    return differ


def _complete(slim: DataFrame, nodes: DataFrame, met: DataFrame, pairs: DataFrame, links: DataFrame, idf, shingle: int, least: float) -> DataFrame:
    """node, label of all links within bands, where those to each band's first two heads are known.

    Bands whose remaining rows are of one class are done. In each of the others the row with the most links (often what the others were made
    from) is the hub, and the rows are compared with it. What a row has more or less of than its hub h is a weighted set D of its own. For rows x and y,
        sum of min(x, y) = |h| - less(x) - less(y) + sum of min(D(x), D(y)),
    so x and y are similar by s just if, with k = s / (1 + s), t(x) = (1 - k) * less(x) + k * more(x) and c = (1 - 2 * k) * |h|,
        sum of min(D(x), D(y)) >= t(x) + t(y) - c,
    where t(x) > c just if x is not similar to h. Two rows that are not must share t(x) and t(y) of their differences at least (more than half of them), so by the
    prefix principle they share one of the rarest elements that hold the rest of D; edits that a row has to itself are the rarest and settle
    most rows. With a row similar to h, a row that is not shares 1 / (1 - k) * (t(y) - c) at least, as D(x) <= t(x) / k. Pairs of one class need no look. So pairs that share such an element are
    verified and no other pair can be similar: no pair of a band is lost, and the pairs made do not grow with the square of a band."""
    share = least / (1 + least)
    label = components(links)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    of = met.where("n > 2").join(label, "node", "left").join(ends, "node", "left")
    of = C.stored(of.select("band", "node", ((F.col("node") == F.col("h1")) | (F.col("node") == F.col("h2"))).alias("head"), F.coalesce("label", "node").alias("label"), F.coalesce("degree", F.lit(0)).alias("degree")), "of")
    rest = F.when(~F.col("head"), F.col("label"))  # all pairs with a head are known
    bands = of.groupBy("band").agg(F.min(rest).alias("lo"), F.max(rest).alias("hi"), F.max(F.struct("degree", F.xxhash64("node").alias("hash"), "node")).alias("best")).where("lo <> hi")
    bands = C.stored(bands.select("band", F.col("best.node").alias("hub")), "bands")
    around = C.stored(of.where("not head").join(bands, "band").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "around")
    if not bands.limit(1).count():
        C.discard(of, bands, around, links, pairs)
        return label
    sides, texts = _texts_of(slim, around)
    apart = C.stored(sides.mapInArrow(_differences(idf, shingle), "a long, b long, similarity double, more double, less double, weight_a double, element array<long>, gap array<double>"), "apart")
    C.discard(texts, of, bands)
    direct = apart.where(F.col("similarity") >= least - 1e-9).select("a", "b", "similarity")
    label = components(direct.select("a", "b").unionByName(label.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    t, c = (1 - share) * F.col("less") + share * F.col("more"), (1 - 2 * share) * F.col("weight_a")
    label_of = lambda side: label.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
    rows = apart.join(label_of("a").hint("merge"), "a", "left").join(label_of("b").hint("merge"), "b", "left").join(nodes.select(F.col("node").alias("b"), "weight").hint("merge"), "b")
    rows = rows.select("a", "b", "weight", "element", "gap", F.coalesce("label_b", "b").alias("label"), F.coalesce("label_a", "a").alias("home"), t.alias("t"), (t - c).alias("over"), (F.col("more") + F.col("less")).alias("size"))
    # of two rows in different classes one isn't in the hub's; only such a stranger can meet rows that are similar to the hub
    rows = rows.withColumns({"far": F.col("over") > 0, "stranger": F.col("label") != F.col("home"), "slack": 1e-6 * (1 + F.col("size"))})
    rows = C.stored(rows.withColumn("need", F.when(F.col("stranger"), F.least("t", F.col("over") / (1 - share))).otherwise(F.col("t")) - F.col("slack")), "rows")
    each = rows.select("a", "b", "weight", "label", "t", "over", "size", "far", "stranger", "slack", "need", F.explode(F.arrays_zip("element", "gap")).alias("e")).select("*", "e.element", "e.gap").drop("e")
    often = C.stored(each.groupBy("a", "element").agg(F.count("*").alias("n"), F.max("stranger").alias("any")).where("n > 1 and any").drop("any"), "often")
    after = F.sum("gap").over(Window.partitionBy("a", "b").orderBy(F.desc("n"), F.desc("element")))
    rarest = C.stored(each.join(often.hint("merge"), ["a", "element"]).withColumn("after", after).where("after >= need").withColumn("core", F.col("far") & (F.col("after") >= F.col("t") - F.col("slack"))).withColumnRenamed("n", "common").drop("gap", "need"), "rarest")
    # a changed word is in several shingles: elements that exactly the same rows share make the same pairs, so the rarest of them stands for all
    shared = [F.bit_xor(F.xxhash64("b", "core", F.lit(k))).alias(f"rows{k}") for k in (1, 2)]
    met_there = rarest.groupBy("a", "element").agg(F.count("*").alias("n"), F.max("stranger").alias("any"), F.max("common").alias("common"), *shared).where("n > 1 and any")
    met_there = C.stored(met_there.groupBy("a", "n", "rows1", "rows2").agg(F.min(F.struct("common", "element")).alias("s")).select("a", "s.element"), "met")
    posts = C.stored(rarest.join(met_there.hint("merge"), ["a", "element"], "left_semi"), "posts")
    other = posts.select("a", "element", *(F.col(x).alias(x + "2") for x in ("b", "t", "over", "size", "far", "stranger", "core", "weight", "label", "after")))
    floor = F.col("t") + F.col("over2") - 1e-6 * (1 + F.col("size") + F.col("size2"))
    new = posts.join(other.where("far2 and stranger2"), ["a", "element"]).where("label <> label2 and (not far or core and core2 and (not stranger or b < b2))")
    # all that two rows share lies at or after their rarest shared element, and two sets are no more similar than the lighter is to the heavier
    new = new.where((F.least("after", "after2") >= floor) & (F.least("weight", "weight2") >= least * F.greatest("weight", "weight2") - 1e-6))
    new = new.select(F.least("b", "b2").alias("a"), F.greatest("b", "b2").alias("b")).distinct()
    new = C.stored(new.join(pairs.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    more = _links(slim, new, idf, shingle, least)
    label = components(more.select("a", "b").unionByName(label.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    C.discard(around, apart, rows, often, rarest, met_there, posts, new, more, links, pairs)
    return label


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs (with ROW) as ROW, id_col, class_id (least id of the class), class_size, keep (the row that stays: least id, then row)."""
    spark = docs.sparkSession
    C.small_batches(spark)
    idf = spark.sparkContext.broadcast(inverse_frequencies(docs, text))
    slim = docs.select(ROW, F.col(text).alias("text"))
    sigs = C.stored(slim.mapInArrow(_signatures("text", idf, bands, rows, shingle), f"{ROW} long, d1 long, d2 long, bands array<long>, weight double"), "signatures")
    nodes = C.stored(sigs.where("d1 is not null").groupBy("d1", "d2").agg(F.min(F.struct(ROW, "bands", "weight")).alias("s")).select("d1", "d2", F.col(f"s.{ROW}").alias("node"), "s.bands", "s.weight"), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("h1"), F.min_by("node", F.xxhash64("node", "band")).alias("h2")).where("n > 1")
    met = C.stored(banded.join(heads, "band"), "met")
    pairs = met.select("node", F.explode(F.array_distinct(F.array("h1", "h2"))).alias("head")).where("node <> head")
    pairs = C.stored(pairs.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct(), "pairs")
    links = _links(slim, pairs, idf, shingle, least)
    label = _complete(slim, nodes, met, pairs, links, idf, shingle, least)
    of_row = sigs.select(ROW, "d1", "d2").join(nodes.select("d1", "d2", "node"), ["d1", "d2"], "left").join(label, "node", "left").select(ROW, F.coalesce("label", "node", ROW).alias("label"))
    members = docs.select(ROW, id_col).join(of_row, ROW)
    heads = members.groupBy("label").agg(F.min(F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), F.col(ROW).alias("r"))).alias("m"), F.count("*").alias("class_size"))
    heads = C.stored(heads, "heads")  # so that the join below reads exchanges of its own, and a large class can be split
    return members.join(heads, "label").select(ROW, id_col, F.col("m.id").alias("class_id"), "class_size", (F.col(ROW) == F.col("m.r")).alias("keep"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """id_col, class_id, class_size, keep: a row per row of docs."""
    return classes(C.with_row_key(docs.select(id_col, text), ROW), id_col, text, **options).drop(ROW)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without all but one row of each class; its columns are unchanged."""
    plain, name, back = C.aside(docs)
    keyed = C.with_row_key(plain, ROW)
    return back(keyed.join(classes(keyed, name(id_col), name(text), **options).where("keep").select(ROW), ROW, "left_semi"))
