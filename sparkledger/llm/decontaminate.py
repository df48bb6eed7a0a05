"""Operator 3: benchmark decontamination by latent semantic retrieval.

Terms are the words of the benchmark (lower case, punctuation as space). Texts are cut into blocks of `block` words, all of them; a passage is a run
of blocks long enough to hold an item. A first pass over all blocks of all rows counts terms, a second makes the random projection of
the block-term matrix (Halko, Martinsson and Tropp 2011): with counts T and weights D the range of (TD)'(TD)W is that of D T'T W' with
W' = DW, so tasks need no weights. Its orthonormal basis Q is the latent space. In a third pass each passage is projected and compared with every item of its
length by cosine; pairs from `cosine` on are checked exactly, unless too few of the item's words are there for any match: longest common subsequence
of words around the passage, and whether the item's answer (its last sentence, or its last third) is there too. A row is a leak if the subsequence
covers `exact` of the item, or `loose` of it along with `loose` of the answer.

The benchmark is read in blocks of bounded size, so what is sent to executors is bounded; documents are never grouped or shuffled.
Null and empty texts and items match nothing. Repeated rows are each reported. Empty tables give no rows. Extra columns are kept by `drop_leaks`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common as C

BLOCK, RANK, COSINE, EXACT, LOOSE, COMMON, PRIOR, RAREST = 16, 96, 0.45, 0.8, 0.6, 0.1, 20_000, 10
#: Bytes of benchmark text that are compared in one go.
ITEM_BYTES = 4_000_000
_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _codes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = _FOLD[data]
    starts, stops, woff = C.word_spans(data, off)
    return C.word_hashes(data, starts, stops), woff


def _encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


class Terms:
    """Numbers of known words, by a sorted table with a bitmap in front."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.unique(codes)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.codes >> C.U64(44)).astype(np.int64)] = True

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known words, and their numbers."""
        at = np.flatnonzero(self.maybe[(codes >> C.U64(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        hit = self.codes[k] == codes[at]
        return at[hit], k[hit]


@dataclass
class Item:
    """One benchmark text, or a part of one that is too long for a passage."""

    item_id: object
    words: np.ndarray
    answer: np.ndarray


def _answer(text: str) -> str:
    parts = [p for p in text.replace("!", ".").replace("?", ".").replace("\n", " ").split(".") if p.strip()]
    if len(parts) > 1:
        return parts[-1]
    words = text.split()
    return " ".join(words[-max(1, len(words) // 3) :])


def read_items(rows: list, longest: int = 64) -> list[Item]:
    """Items of (id, text in lower case) rows; a text of more than `longest` words becomes several parts that each have to stand for it."""
    items = []
    for item_id, text in rows:
        words = _codes(*_encode([text or ""]))[0]
        answer = _codes(*_encode([_answer(text or "")]))[0]
        for a in range(0, len(words), longest):
            part = words[a : a + longest]
            if len(part) >= min(8, len(words)):
                items.append(Item(item_id, part, answer if a == 0 and len(words) <= longest else part[-max(1, len(part) // 3) :]))
    return items


def _blocks(woff: np.ndarray, block: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the blocks that the words at some places are in, and n+1 offsets of each text's blocks."""
    boff = np.concatenate([[0], np.cumsum(-(-np.diff(woff) // block))])
    text = np.searchsorted(woff, at, "right") - 1
    return boff[text] + (at - woff[text]) // block, boff


def _runs(b: np.ndarray, step: int = 20_000) -> Iterator[tuple[slice, np.ndarray]]:
    """Words, whose blocks are b, in runs of whole blocks and about `step` words, with the first word of each block in the run."""
    first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    cut = np.unique(np.searchsorted(first, np.arange(0, len(b), step)))
    for lo, hi in zip(cut, [*cut[1:], len(first)]):
        if lo < hi:
            yield slice(first[lo], first[hi] if hi < len(first) else len(b)), first[lo:hi] - first[lo]


def _sums(table: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of table[row] over runs of rows that begin at `first`: the k-th rows of all runs that have one are added at once."""
    size = np.diff(np.append(first, len(row)))
    order = np.argsort(-size, kind="stable")
    begin, size = first[order], size[order]
    total = table[row[begin]]
    for k in range(1, int(size[0])):
        m = int(np.searchsorted(-size, -k))
        total[:m] += table.take(row[begin[:m] + k], axis=0)
    out = np.empty_like(total)
    out[order] = total
    return out


def _slices(full: np.ndarray, blocks: int) -> pa.RecordBatch:
    """Rows of a table of sums in 32 slices, and the number of blocks."""
    step = max(1, -(-len(full) // 32))
    cut = list(range(0, len(full), step))
    return pa.RecordBatch.from_arrays([pa.array([*cut, -1]), pa.array([*(full[a : a + step].tobytes() for a in cut), np.array([float(blocks)]).tobytes()], pa.binary())], names=["slice", "sums"])


def _gathered(docs: DataFrame, task) -> tuple[float, np.ndarray]:
    """Blocks in all and the flat sums of what the tasks give: of constant size, whatever the rows."""
    rows = docs.mapInArrow(task, "slice long, sums binary").groupBy("slice").applyInArrow(_add, "slice long, sums binary").collect()
    got = {r.slice: np.frombuffer(bytes(r.sums), np.float64) for r in rows}
    return (got.pop(-1)[0] if got else 0.0), (np.concatenate([got[k] for k in sorted(got)]) if got else np.zeros(0))


def _counts(terms, text_col: str, block: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = terms.value
        total, blocks = np.zeros(len(t.codes)), 0
        for batch in batches:
            for _, data, off in C.pieces(batch, text_col):
                code, woff = _codes(data, off)
                blocks += int((-(-np.diff(woff) // block)).sum())
                total += np.bincount(t(code)[1], minlength=len(t.codes))
        yield _slices(total, blocks)

    return count


def _sketch(terms, text_col: str, block: int, rank: int, seed: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = terms.value
        v = len(t.codes)
        omega = np.random.default_rng(seed).standard_normal((v, rank)).astype(np.float32)
        total, blocks = np.zeros((v, rank)), 0
        for batch in batches:
            for _, data, off in C.pieces(batch, text_col):
                code, woff = _codes(data, off)
                at, k = t(code)
                of, boff = _blocks(woff, block, at)
                blocks += int(boff[-1])
                if not len(at):
                    continue
                for run, first in _runs(of):
                    ks = k[run]
                    of_block = _sums(omega, ks, first)
                    order = np.argsort(ks, kind="stable")
                    of_word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ks))))[order]
                    ks = ks[order]
                    first = np.flatnonzero(np.append(True, ks[1:] != ks[:-1]))
                    total[ks[first]] += _sums(of_block, of_word, first)
        yield _slices(total, blocks)

    return sketch


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist())
    return pa.table({"slice": table.column("slice").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


@dataclass
class Space:
    """The latent space and the items in it."""

    terms: Terms
    weight: np.ndarray
    basis: np.ndarray  # weighted rows of Q: what a term adds to a passage
    items: list[Item]
    sizes: np.ndarray  # passage length of each item, in blocks
    vectors: np.ndarray


def latent_space(docs: DataFrame, items: list[Item], text: str = "text", block: int = BLOCK, rank: int = RANK, common: float = COMMON, seed: int = 3) -> Space:
    """Frequencies, then the random projection, each over all blocks of docs; then the basis on the driver: as many rows as the items have words.

    Terms in more than `common` of the blocks stay out, but for the RAREST terms of each item. Shares are smoothed by PRIOR blocks without terms, so small tables have no common terms."""
    spark = docs.sparkSession
    C.small_batches(spark)
    lower = docs.select(F.lower(text).alias("t"))
    every = Terms(np.concatenate([i.words for i in items]))
    n, counts = _gathered(lower, _counts(spark.sparkContext.broadcast(every), "t", block))
    counts = counts if len(counts) else np.zeros(len(every.codes))
    live = counts <= common * (n + PRIOR)
    for item in items:
        own = np.unique(every(item.words)[1])
        live[own[np.argsort(counts[own], kind="stable")[:RAREST]]] = True
    terms = Terms(every.codes[live])
    weight = np.log((n + PRIOR) / (counts[live] + 1))
    v = len(terms.codes)
    rank = min(rank, v)  # of either half of the basis
    _, flat = _gathered(lower, _sketch(spark.sparkContext.broadcast(terms), "t", block, rank, seed))
    corpus = weight[:, None] * (flat.reshape(v, rank) if len(flat) else np.zeros((v, rank)))
    # items join the sketch, so that their own directions are in the space however rare their words are
    mixed, rng = np.zeros((v, min(rank, v - rank))), np.random.default_rng(seed + 1)
    for item in items:  # the items' own matrix is never made, only its product with a random one
        own, times = np.unique(terms(item.words)[1], return_counts=True)
        mixed[own] += np.outer(times * weight[own], rng.standard_normal(mixed.shape[1]))
    corpus *= np.linalg.norm(mixed) / max(np.linalg.norm(corpus), 1e-12) if mixed.any() and corpus.any() else 1
    q, _ = np.linalg.qr(np.column_stack([mixed, corpus]))
    basis = (weight[:, None] * q).astype(np.float32)
    vectors = np.stack([basis[terms(i.words)[1]].sum(0) for i in items])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    sizes = np.array([-(-len(i.words) // block) + 1 for i in items])
    return Space(terms, weight, basis, items, sizes, vectors.astype(np.float32))


def _places(a: np.ndarray) -> dict[int, int]:
    """Where each word of a is, as bits."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def _subsequence(n: int, found: list[int]) -> int:
    """Length of the longest common subsequence of n words and a text with words at these places of them, bit-parallel (Hyyro 2004)."""
    full = v = (1 << n) - 1
    for m in found:
        u = v & m
        v = (v + u | v - u) & full
    return n - v.bit_count()


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    masks = _places(a)
    return _subsequence(len(a), [masks[y] for y in b.tolist() if y in masks])


def _search(space, id_col: str, text_col: str, item_type: pa.DataType, block: int, cosine: float, exact: float, loose: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Space = space.value
        places, answers = [_places(i.words) for i in s.items], [_places(i.answer) for i in s.items]
        # what a match has at least of the item's words, and of those with weight
        least = [min(exact, loose) * len(i.words) - 1e-9 for i in s.items]
        need = np.array([n - len(i.words) + len(s.terms(i.words)[0]) for n, i in zip(least, s.items)])
        for batch in batches:
            out: dict[tuple[int, int], tuple] = {}
            row = 0
            for part, data, off in C.pieces(batch, text_col):
                code, woff = _codes(data, off)
                at, k = s.terms(code)
                b, boff = _blocks(woff, block, at)
                if not len(at):
                    row += part.num_rows
                    continue
                tokens = np.searchsorted(b, np.arange(int(boff[-1]) + 1))
                blocks = int(boff[-1])
                of_block = np.zeros((blocks + 1, s.basis.shape[1]), np.float32)  # the last stands for what lies past a text's end
                for words, first in _runs(b):
                    of_block[b[words][first]] = _sums(s.basis, k[words], first)
                passage, width = of_block[:-1].copy(), 1
                text_of = np.repeat(np.arange(part.num_rows), np.diff(boff))
                for size in np.unique(s.sizes):
                    mine = np.flatnonzero(s.sizes == size)
                    start = np.arange(blocks)
                    for width in range(width, size):
                        passage += of_block.take(np.where(start + width < boff[text_of + 1], start + width, blocks), axis=0)
                    width = size
                    stop = np.minimum(start + size, boff[text_of + 1])
                    # the last passages of a text are inside the one before, but for texts of one passage
                    full = (stop - start == size) | (start == boff[text_of])
                    # the words with weight in a passage and the blocks beside it
                    most = tokens[np.minimum(stop + 1, boff[text_of + 1])] - tokens[np.maximum(start - 1, boff[text_of])]
                    full &= most >= need[mine].min()
                    start, stop, most = start[full], stop[full], most[full]
                    for a in range(0, len(start), 20_000):
                        v = passage.take(start[a : a + 20_000], axis=0)
                        near = v @ s.vectors[mine].T
                        length = np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12)
                        for p, j in zip(*np.nonzero((near >= np.float32(cosine) * length[:, None]) & (most[a : a + 20_000, None] >= need[mine]))):
                            j_ = int(mine[j])
                            i, item = s.items[j_], j_
                            text = int(text_of[start[a + p]])
                            lo, hi = woff[text] + (start[a + p] - boff[text]) * block, min(woff[text + 1], woff[text] + (stop[a + p] - boff[text]) * block)
                            lo, hi = max(woff[text], lo - block), min(woff[text + 1], hi + block)
                            region = code[lo:hi].tolist()
                            if len(hits := [m for m in map(places[item].get, region) if m]) < least[item]:
                                continue
                            whole = _subsequence(len(i.words), hits) / len(i.words)
                            if whole < min(exact, loose):
                                continue
                            answer = _subsequence(len(i.answer), [m for m in map(answers[item].get, region) if m]) / max(1, len(i.answer))
                            if whole >= exact or whole >= loose and answer >= loose:
                                key, found = (row + text, item), (whole, float(near[p, j] / length[p]), answer, int(lo - woff[text]))
                                if key not in out or found > out[key]:
                                    out[key] = found
                row += part.num_rows
            ids = batch.column(batch.schema.get_field_index(id_col))
            best: dict[tuple[int, object], tuple] = {}
            for (r, item), found in out.items():
                key = (r, s.items[item].item_id)
                if key not in best or found > best[key]:
                    best[key] = found
            keys = sorted(best, key=lambda x: (x[0], str(x[1])))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array([r for r, _ in keys], pa.int64())), pa.array([i for _, i in keys], item_type), *(pa.array([best[x][c] for x in keys], pa.float64()) for c in range(3)), pa.array([best[x][3] for x in keys], pa.int64())],
                names=[id_col, "item_id", "subsequence", "cosine", "answer", "at_word"],
            )

    return search


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK, cosine: float = COSINE, exact: float = EXACT, loose: float = LOOSE) -> DataFrame:
    """A row for each row of docs and each item that it leaks: id_col, item_id, subsequence, cosine, answer, at_word."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id {benchmark.schema[item_col].dataType.simpleString()}, subsequence double, cosine double, answer double, at_word long"
    items = benchmark.select(F.col(item_col).alias("i"), F.lower(item_text).alias("t")).where("trim(t) <> ''")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    found = []
    for k in range(groups := max(1, -(-size // ITEM_BYTES))):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(groups)) == k).orderBy("i", "t").collect()
        if parts := read_items([(r.i, r.t) for r in rows]):
            sent = spark.sparkContext.broadcast(latent_space(docs, parts, text, block))
            lower = docs.select(id_col, F.lower(text).alias("_t"))
            found.append(lower.mapInArrow(_search(sent, id_col, "_t", to_arrow_type(benchmark.schema[item_col].dataType), block, cosine, exact, loose), schema))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the rows that leak an item; its columns are unchanged."""
    plain, name, back = C.aside(docs)
    keyed = C.with_row_key(plain, "_row")
    bad = leaks(keyed, benchmark, "_row", name(text), **options).select("_row").distinct()
    return back(keyed.join(bad, "_row", "left_anti"))
