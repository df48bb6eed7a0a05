"""Operator 7: language identification by averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

Subwords are the byte n-grams (2 to 4) of a text's letters, with everything else as one space. An n-gram is a hashed row of an embedding table;
a text is their mean; a linear layer and softmax give probabilities. The model is trained by stochastic gradient descent in numpy, on
the driver, from the whole texts of about `sample` (never over twice as many) labelled rows. Tasks count a text's n-grams per bucket, so the driver takes at most
8 bytes for each of a row's buckets, whatever the text's length. A fifth of the rows is kept back
to fit the temperature and the rejection threshold. N-grams of a language that isn't learned fall into buckets like thrown dice, so one more class is
learned from thrown buckets, as many examples as a language has on average: `unknown`, which takes probability and is never predicted. A text is rejected
if its language's probability lies below the threshold: the least one that keeps the precision wanted over the rows kept back, examples of `unknown`
among them as wrong, and at most 0.5, so that a language with most of the probability always stays. Prediction reads every whole text, with one table of class scores per n-gram.

Null texts and texts without a letter are `und` with score 0, and rejected. With no labelled row, everything is. Rows with a null
label are predicted, not learned from. Repeated rows get equal results; an empty table gives no rows; extra columns are kept by `add_language`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE, BUCKETS, DIMENSIONS, EPOCHS, RATE, PRECISION = 4000, 1 << 16, 16, 15, 5.0, 0.99
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
#: Odd multipliers of the n-gram hash; any will do.
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)
_ORDERS = (2, 3, 4)


def _ngrams(data: np.ndarray, off: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of all n-grams and the offsets of each text's."""
    b = _FOLD[data]
    keep = b != 32
    keep[1:] |= b[:-1] != 32
    first = off[:-1][off[:-1] < len(b)]
    keep[first] = b[first] != 32
    at = np.concatenate([[0], np.cumsum(keep)])[off]
    b = b[keep].astype(np.uint32) + np.uint32(1)
    shift = np.uint32(32 - int(np.log2(buckets)))
    for n in _ORDERS:
        if len(b) < n:
            yield np.zeros(0, np.int64), np.zeros(len(off), np.int64)
            continue
        m = len(b) - n + 1
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h += b[k : k + m] * _MULTIPLIERS[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(2246822519)
        start, text = C.ranges(at[:-1], at[1:] - n + 1)
        yield (h >> shift)[start].astype(np.int64), np.searchsorted(text, np.arange(len(off)))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # scores of each bucket for the languages and, last, for unknown
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        total, count = np.zeros((n, len(self.bias))), np.zeros(n)
        for bucket, at in _ngrams(data, off, len(self.table)):
            size = np.diff(at)
            some = np.flatnonzero(size)
            if len(some):
                total[some] += np.add.reduceat(self.table[bucket], at[some], axis=0)
                count += size
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Of each language; what is left to 1 is unknown's."""
        return _softmax(self.logits(data, off) / self.temperature)[:, :-1]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def bucket_counts(data: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and how many fall in each."""
    total = np.zeros(buckets, np.int64)
    for bucket, _ in _ngrams(data, np.array([0, len(data)]), buckets):
        total += np.bincount(bucket, minlength=buckets)
    ids = np.flatnonzero(total)
    return ids.astype(np.int32), total[ids].astype(np.int32)


def _thrown(weights: np.ndarray, buckets: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """An example of unknown: thrown buckets with a text's weights, or with some of them only, as few letters make few n-grams."""
    some = rng.permutation(weights)[: max(1, int(len(weights) ** rng.uniform(0.3, 1)))]
    return rng.choice(buckets, len(some), replace=False), some / some.sum()


def train(counts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, precision: float = PRECISION, seed: int = 7) -> Model | None:
    """Fits the model to texts' bucket counts; None without a text that has n-grams."""
    pairs = [(c, y) for c, y in zip(counts, labels) if len(c[0])]
    if not pairs:
        return None
    features, labels = [(ids, (n / n.sum()).astype(np.float32)) for (ids, n), _ in pairs], [y for _, y in pairs]
    names = tuple(sorted(set(labels)))
    rng = np.random.default_rng(seed)
    unknown = -(-len(labels) // len(names))
    features += [_thrown(features[i][1], buckets, rng) for i in rng.integers(0, len(labels), unknown)]
    y = np.array([names.index(x) for x in labels] + [len(names)] * unknown)
    held = rng.permutation(len(y)) % 5 == 0 if len(labels) >= 50 else np.zeros(len(y), bool)
    embed = (rng.random((buckets, dimensions), np.float32) - 0.5) / dimensions
    weight, bias = np.zeros((dimensions, len(names) + 1), np.float32), np.zeros(len(names) + 1, np.float32)
    todo = np.flatnonzero(~held)
    for epoch in range(epochs):
        rate = np.float32(RATE * (1 - epoch / epochs))
        for i in rng.permutation(todo):
            ids, w = features[i]
            mean = w @ embed[ids]
            z = mean @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = weight @ p
            weight -= rate * 0.1 * np.outer(mean, p)
            bias -= rate * 0.01 * p
            embed[ids] -= rate * w[:, None] * g
    table = embed @ weight
    logits = np.stack([w @ table[ids] + bias for ids, w in features])
    judge = held if held.any() else np.ones(len(y), bool)
    grid = np.geomspace(0.1, 10, 41)
    loss = [-np.log(np.maximum(_softmax(logits[judge] / t)[np.arange(judge.sum()), y[judge]], 1e-12)).mean() for t in grid]
    heat = float(grid[int(np.argmin(loss))])
    p = _softmax(logits[judge] / heat)[:, :-1]
    score, right = p.max(1), p.argmax(1) == y[judge]
    order = np.argsort(-score, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision
    threshold = min(0.5, float(score[order][np.flatnonzero(good)[-1]])) if good.any() else 0.5
    return Model(names, table.astype(np.float32), bias, heat, threshold)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out(id_col: str) -> Column:
    """Whether the CRC-32 of the id's text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _count(text_col: str, label: str, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in C.pieces(batch, text_col):
                labels = part.column(part.schema.get_field_index(label))
                for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                    if has_letter(data[a:b].tobytes().decode()):
                        ids, n = bucket_counts(data[a:b], buckets)
                        yield pa.RecordBatch.from_arrays([labels.slice(i, 1), pa.array([ids.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["label", "ids", "n"])

    return count


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE, buckets: int = BUCKETS) -> Model | None:
    """Trains on the whole texts of about `sample` rows with a label and an id that isn't held out: those whose hashes of id and text lie below the share of rows that is wanted.

    So tasks send the driver only what it takes. Repeated rows count once."""
    can = docs.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & F.col(text).isNotNull() & ~held_out(id_col))
    n = can.count()
    share = F.pmod(F.xxhash64(F.col(id_col), F.col(text)), F.lit(1_000_000_007)) < int(1_000_000_007 * min(1.0, sample / max(1, n)) + 1)
    rows = can.where(share).select(F.col(text).alias("t"), F.col(label).cast("string").alias("l")).distinct()
    some = C.stored(rows.select("t", "l", F.xxhash64("t", "l").alias("h")), "training")
    C.small_batches(docs.sparkSession)
    least = [r.h for r in some.select("h").orderBy("h").limit(2 * sample).collect()]
    if not least:
        return None
    counted = some.where(F.col("h") <= least[-1]).orderBy("h", "t", "l").select("t", "l").mapInArrow(_count("t", "l", buckets), "label string, ids binary, n binary").collect()
    C.discard(some)
    return train([(np.frombuffer(r.ids, np.int32), np.frombuffer(r.n, np.int32)) for r in counted], [r.label for r in counted], buckets)


def _predict(model, text_col: str):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part, data, off in C.pieces(batch, text_col):
                n = part.num_rows
                ascii_letter = np.concatenate([[0], np.cumsum((data | 32) - np.uint8(97) < 26)])
                known = ascii_letter[off[1:]] > ascii_letter[off[:-1]]
                for i in np.flatnonzero(~known & (np.diff(off) > 0)):
                    known[i] = has_letter(data[off[i] : off[i + 1]].tobytes().decode())
                if m is None:
                    best, score, known = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
                else:
                    p = m.probabilities(data, off)
                    best, score = p.argmax(1), p.max(1)
                score = np.where(known, score, 0.0)
                names = [m.languages[b] if k else "und" for b, k in zip(best, known)]
                reject = ~known | (score < (m.threshold if m else 1.0))
                columns = [part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(score), pa.array(reject)], names=[*part.schema.names, "_lang", "_score", "_reject"])

    return predict


def add_language(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs and lang columns _lang, _score, _reject."""
    C.small_batches(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_predict(shared, text), f"{fields}, _lang string, _score double, _reject boolean")


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """id_col, held_out, lang_pred, score, rejected for each row."""
    found = add_language(docs.select(id_col, text), fit(docs, id_col, text, label), text)
    return found.select(id_col, held_out(id_col).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_reject").alias("rejected"))


def keep_known(docs: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """docs without the rows that are rejected."""
    plain, name, back = C.aside(docs)
    return back(add_language(plain, fit(docs, id_col, text, label), name(text)).where(~F.col("_reject")))
