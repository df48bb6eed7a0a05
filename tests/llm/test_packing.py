import zlib

import numpy as np
import pytest

from sparkledger.llm import packing
from sparkledger.llm.queries import tokenizer_path

TEXTS = ["ÉCOLE it's 'sure don't x≠y ΣΑΣ é. a b 123,4. straße", "", None, " \n ", "word " * 5000, "<|endoftext|> q\x85r \x1cz a.. b,.", "Hello, WORLD.", "Hello, WORLD.", "ñandú más. ça va, ÷a ×b"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "no id", 2)], "doc_id long, text string, start int").repartition(2)


def test_ids_are_the_tokenizers(docs):
    tokens = packing.WordTokens(tokenizer_path())
    plain = [t or "" for t in TEXTS]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in tokens.tokenizer.encode_batch(plain, add_special_tokens=False)]
    assert list(tokens(plain)) == want


def test_round_trip(docs):
    out = packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path(), size=256).toPandas()
    tokens = packing.WordTokens(tokenizer_path())
    for i, t in enumerate(TEXTS):
        ids = np.append(np.frombuffer(next(iter(tokens([t or ""]))), "<u4"), np.uint32(2))
        mine = out[out.doc_id == i].sort_values("start")
        assert mine.length.sum() == len(ids) and (mine.doc_tokens == len(ids)).all()
        at = 0
        for r in mine.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].astype("<u4").tobytes())
            at += r.length
    assert len(out[out.doc_id.isna()]) == 1
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.length.sum() <= 256 and (s.offset.to_numpy() == np.append(0, s.length.cumsum().to_numpy()[:-1])).all()


def test_limits_hold_at_once():
    rng = np.random.default_rng(1)
    demand = np.stack([rng.integers(1, 400, 600), np.ones(600, int), rng.integers(0, 200, 600)], 1)
    capacity = np.array([1000, 6, 450])
    bins, rank = packing.place(demand, capacity)
    for b in range(bins.max() + 1):
        here = demand[bins == b]
        assert len(here) and (here.sum(0) <= capacity).all()
        assert sorted(rank[bins == b]) == list(range(len(here)))
    assert bins.max() + 1 <= 1.15 * (demand.sum(0) / capacity).max() + 1


def test_instruction_columns(spark):
    pieces = spark.createDataFrame([(i, 10 + i % 50, i % 30) for i in range(500)], "id long, length long, loss long")
    out = packing.pack(pieces, size=128, segments=4, loss_tokens=40, loss="loss").toPandas()
    by = out.groupby("sequence_id")
    assert len(out) == 500 and by.length.sum().max() <= 128 and by.size().max() <= 4 and by.loss.sum().max() <= 40


def test_only_the_loss_limit_binds(spark):
    """Short pieces, almost all loss: with the limit on loss alone tight, sequences are full of loss and far from full of ids."""
    pieces = spark.createDataFrame([(i, 10, 9) for i in range(400)], "id long, length long, loss long")
    out = packing.pack(pieces, size=4096, segments=1000, loss_tokens=36, loss="loss").toPandas()
    by = out.groupby("sequence_id")
    assert len(by) == 100 and (by.loss.sum() == 36).all() and by.length.sum().max() == 40


def test_a_piece_above_a_limit_is_an_error(spark):
    pieces = spark.createDataFrame([(1, 10, 3), (2, 10, 41)], "id long, length long, loss long")
    with pytest.raises(Exception, match="breaks the limits"):
        packing.pack(pieces, size=128, loss_tokens=40, loss="loss").collect()
    with pytest.raises(Exception, match="breaks the limits"):
        packing.pack(pieces, size=8).collect()


def test_repeated_rows_are_spread_over_groups(spark):
    pieces = spark.range(3000).selectExpr("1L AS id", "10L AS length")
    out = packing.pack(pieces, size=100, group=100).toPandas()
    assert len(out) == 3000 and out.groupby("sequence_id").length.sum().max() <= 100
    assert out.groupby(out.sequence_id // 2**32).size().max() < 200


def test_empty(docs):
    assert packing.pack_documents(docs.select("doc_id", "text").limit(0), tokenizer_path()).count() == 0
