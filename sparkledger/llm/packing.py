"""Operator 4: packing of tokenised documents into sequences, by vector bin packing with the dot-product heuristic.

A document's ids are its tokens and an end id. It is cut at every `size` ids; full pieces are sequences of their own, and the
rests are placed under three limits at once: ids, segments and loss-bearing ids of a sequence. A sequence takes, again and again,
the piece that fits and has the largest dot product with what the sequence has left, each dimension weighted by total demand over capacity.

Pieces are dealt by hash into groups of about `group` rows that are packed apart: memory and time of a task are bounded, at the
cost of less than one part-filled sequence a group. The hash takes a number for each row in, so repeated rows are spread over all groups.
Null and empty texts are documents of just the end id. Repeated rows, also with a null id, are packed as rows of their own. A piece that
breaks a limit by itself is an error. An empty table gives no rows. Extra columns play no part.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SIZE, END_ID, SEGMENTS, GROUP = 4096, 2, 256, 4000
#: Words whose ids a worker keeps at most.
CACHE = 300_000


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies have for each byte: printable Latin-1 stands for itself, the rest for letters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordTokens:
    """Ids of texts as bytes (unsigned 32 bit, little endian), with a bounded memory of words.

    Only for byte-level tokenizers whose normaliser composes, lowers the case and unites white space, and whose pieces are runs of letters,
    single digits or runs of other characters, never across white space: then a text's ids are its words' ids. Words of lower-case Latin-1
    letters are one piece each and go straight to the model; a full stop or comma at their end is a piece of its own. All others go through the whole tokenizer."""

    _LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}

    def _whole(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def _letters(self, word: bytes) -> bytes:
        text = word.decode("ascii") if word.isascii() else "".join([self.letters[b] for b in word])
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _learn(self, words: list[bytes]) -> None:
        known, full, stops = self.known, self._LETTERS.fullmatch, {b".": self._whole(b"."), b",": self._whole(b",")}
        for w in words:
            if full(w):
                known[w] = self._letters(w)
            elif (end := w[-1:]) in stops and full(stem := w[:-1]):
                if stem not in known:
                    known[stem] = self._letters(stem)
                known[w] = known[stem] + stops[end]
            else:
                known[w] = self._whole(w)

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            words = text.encode().lower().split()  # ASCII only: the tokenizer lowers the rest
            known = self.known
            if new := set(words).difference(known):
                if len(known) + len(new) > CACHE:
                    known.clear()
                    new = set(words)
                self._learn(list(new))
            yield b"".join([known[w] for w in words])


def _tokenise(path: str, size: int, end_id: int, id_col: str, text_col: str):
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = WordTokens(path), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_col))
            texts = batch.column(batch.schema.get_field_index(text_col)).fill_null("").to_pylist()
            row, start, length, crc, total = [], [], [], [], []
            for i, raw in enumerate(tokens(texts)):
                raw += end
                n = len(raw) // 4
                for a in range(0, n, size):
                    part = raw[4 * a : 4 * (a + size)]
                    row.append(i)
                    start.append(a)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=[id_col, "start", "length", "ids_crc32", "doc_tokens"])

    return tokenise


def tokenised_pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens."""
    C.small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(_tokenise(path, size, end_id, id_col, text), f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def place(demand: np.ndarray, capacity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item and its rank there. demand: items x dimensions, each item within the capacity by itself.

    Items of equal demand are one class with a count, so a choice costs as many products as there are classes."""
    n = len(demand)
    bins, rank = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return bins, rank
    kinds, which = np.unique(demand, axis=0, return_inverse=True)
    which = which.ravel()
    members = np.argsort(which, kind="stable")
    left = np.bincount(which, minlength=len(kinds))
    ends = np.cumsum(left)
    scale = kinds / capacity
    weights = demand.sum(0) / capacity / n
    here, room, count = 0, capacity.astype(float).copy(), 0
    live = np.arange(len(kinds))
    done = 0
    while done < n:
        fits = (kinds[live] <= room).all(1)
        if not fits.any():
            here, room, count = here + 1, capacity.astype(float).copy(), 0
            live = np.flatnonzero(left)
            continue
        can = live[fits]
        k = can[np.argmax(scale[can] @ (weights * room / capacity))]
        item = members[ends[k] - left[k]]
        bins[item], rank[item] = here, count
        room -= kinds[k]
        count += 1
        done += 1
        left[k] -= 1
        live = can if left[k] else can[can != k]  # room only shrinks in a bin
    return bins, rank


def pack(pieces: DataFrame, size: int = SIZE, segments: int = SEGMENTS, loss_tokens: int | None = None, loss: str | None = None, group: int = GROUP, length: str = "length") -> DataFrame:
    """Adds sequence_id, offset and segment (the rank in its sequence) to pieces.

    loss: a column with the loss-bearing ids of each piece (default: all but its first); loss_tokens: how many of them a sequence takes (default: size)."""
    groups = max(1, -(-pieces.count() // group))
    fields = pieces.columns
    loss_limit = size if loss_tokens is None else loss_tokens
    dealt = C.with_row_key(pieces, "_nth").withColumn("_group", F.pmod(F.xxhash64("_nth", *fields), F.lit(groups))).drop("_nth")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(fields, kind="stable").reset_index(drop=True)
        n = pdf[length].to_numpy(np.int64)
        cost = pdf[loss].fillna(0).to_numpy(np.int64) if loss else np.maximum(n - 1, 0)
        demand, capacity = np.stack([n, np.ones_like(n), cost], 1), np.array([size, segments, loss_limit], np.int64)
        if (demand > capacity).any():
            raise ValueError(f"a piece of {n.max()} ids, {cost.max()} of them loss-bearing, breaks the limits {size} and {loss_limit}: cut it first")
        bins, rank = place(demand, capacity)
        out = pdf.assign(sequence_id=int(pdf["_group"].iloc[0]) << 32 | bins, segment=rank).sort_values(["sequence_id", "segment"])
        out["offset"] = out.groupby("sequence_id")[length].cumsum() - out[length]
        return out.drop(columns="_group")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, segment long, offset long"
    return dealt.groupBy("_group").applyInPandas(fill, schema)


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, segments: int = SEGMENTS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenises and packs: id_col, start, length, ids_crc32, doc_tokens, sequence_id, segment, offset for each piece."""
    return pack(C.stored(tokenised_pieces(docs, path, size, id_col=id_col, text=text), "pieces"), size, segments)
