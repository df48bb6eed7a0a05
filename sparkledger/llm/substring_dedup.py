"""Operator 10: removal of token windows that repeat, by Rabin-Karp hashes counted in Spark (see repeats.py).

Words are runs of characters other than space and \\t \\n \\v \\f \\r, unchanged. A window is `length` consecutive words of one text;
each word in a window whose words also start anywhere else, same text included, is removed; windows are judged on the input.
Null and empty texts have no words; repeated rows are rows of their own (so their windows repeat); an empty table gives no rows;
extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import repeats as R

LENGTH = 35


def windows(length: int = LENGTH) -> R.Windows:
    gram = max(1, min(3, length // 8))
    return R.Windows(length, max(1, min(20, length - gram + 1 - length // 3)), gram, "word", R.word_symbols)


def _clean(length: int, text_col: str):
    """Adds _n_words, _n_removed and _kept to whatever columns there are."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in C.pieces(batch, text_col):
                starts, stops, woff = C.word_spans(data, off)
                spans = part.schema.get_field_index(R.SPANS)
                lo, hi, text = R.span_arrays(part.column(spans))
                gone = C.covered(len(starts), lo + woff[text], hi + woff[text] + length)
                total = np.concatenate([[0], np.cumsum(gone)])
                raw, kept = data.tobytes(), []
                for a, b in zip(woff[:-1].tolist(), woff[1:].tolist()):
                    left = ~gone[a:b]
                    kept.append(b" ".join([raw[x:y] for x, y in zip(starts[a:b][left].tolist(), stops[a:b][left].tolist())]).decode())
                others = [i for i in range(part.num_columns) if i != spans]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in others), pa.array(np.diff(woff)), pa.array(total[woff[1:]] - total[woff[:-1]]), pa.array(kept, pa.string())],
                    names=[*(part.schema.names[i] for i in others), "_n_words", "_n_removed", "_kept"],
                )

    return clean


def _cleaned(docs: DataFrame, length: int, text: str) -> DataFrame:
    found = R.repeated_spans(C.with_row_key(docs, R.ROW), windows(length), text).drop(R.ROW)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return found.mapInArrow(_clean(length, text), f"{fields}, _n_words long, _n_removed long, _kept string")


def remove_repeated_windows(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id_col, n_words, n_removed, kept (the words left, joined by one space) and kept_sha256."""
    kept = F.col("_kept").alias("kept")
    return _cleaned(docs.select(id_col, text), length, text).select(id_col, F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), kept, F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


def clean_documents(docs: DataFrame, length: int = LENGTH, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with repeated windows taken out of their texts; texts without any stay as they are. Columns are unchanged; n_chars follows its text."""
    plain, name, back = C.aside(docs)
    cut = F.col("_n_removed") > 0
    new = {name(text): F.when(cut, F.col("_kept")).otherwise(F.col(name(text)))}
    if n_chars in docs.columns:
        new[name(n_chars)] = F.when(cut, F.length("_kept")).otherwise(F.col(name(n_chars))).cast(docs.schema[n_chars].dataType)
    return back(_cleaned(plain, length, name(text)).withColumns(new))
