"""Operators 2 and 10 against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from sparkledger.llm import repeats, substring_dedup, suffix_dedup


def brute_words(texts, n):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(d[i : i + n]) for d in docs for i in range(len(d) - n + 1))
    out = []
    for d in docs:
        gone = [False] * len(d)
        for i in range(len(d) - n + 1):
            if seen[tuple(d[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        kept = " ".join(w for w, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def brute_bytes(texts, n):
    docs = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + n] for d in docs for i in range(len(d) - n + 1))
    out = []
    for d in docs:
        gone = bytearray(len(d))
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, alphabet, sizes):
    """Random texts with copied stretches, edits, repeated rows, nulls, empty and low-entropy texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randint(*sizes))) for _ in range(25)]
    for _ in range(15):
        a, b = rng.choice(texts), rng.choice(texts)
        i, j = sorted(rng.randrange(len(a) + 1) for _ in range(2))
        k = rng.randrange(len(b) + 1)
        texts.append(b[:k] + " " + a[i:j] + " " + b[k:])
    base = texts[3]
    for _ in range(10):
        w = base.split()
        w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    return [*texts, texts[0], texts[0], None, None, "", " \n\t ", "ab " * 300, "x" * 900, "x" * 700, "é" * 200, "one", base + base]


def rows(spark, texts, ids=None):
    made = [(i if ids is None else ids[i], t, "extra") for i, t in enumerate(texts)]
    return spark.createDataFrame(made, "doc_id long, text string, source string").repartition(3)


@pytest.mark.parametrize("seed,alphabet,sizes,n", [(1, "abcdefgh", (5, 80), 5), (2, "ab", (20, 120), 12), (3, "abcdefghijklmnop", (60, 200), 35)])
def test_word_windows(spark, seed, alphabet, sizes, n):
    texts = corpus(seed, alphabet, sizes)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeated_windows(rows(spark, texts), n).collect()}
    assert [got[i] for i in range(len(texts))] == brute_words(texts, n)


@pytest.mark.parametrize("seed,alphabet,sizes,n", [(1, "abcdefgh", (20, 120), 40), (2, "ab", (40, 160), 64), (3, "abcdefghijklmnopé", (60, 400), 400)])
def test_byte_strings(spark, seed, alphabet, sizes, n):
    texts = corpus(seed, alphabet, sizes)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeated_strings(rows(spark, texts), n).collect()}
    assert [got[i] for i in range(len(texts))] == brute_bytes(texts, n)


def test_null_and_repeated_ids(spark):
    texts = ["a b c d e f g", "a b c d e f g", "h i j k l m"]
    got = sorted(((r.doc_id is None, r.n_removed) for r in substring_dedup.remove_repeated_windows(rows(spark, texts, [None, None, 7]), 5).collect()))
    assert got == [(False, 0), (True, 7), (True, 7)]


def test_empty_tables(spark):
    none = rows(spark, ["x"]).limit(0)
    assert substring_dedup.remove_repeated_windows(none).count() == 0
    assert suffix_dedup.remove_repeated_strings(none).count() == 0


def test_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (2, "z  a b c d e", "en", "s", 12), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in substring_dedup.clean_documents(docs, 5).collect()}
    assert out == {1: ("f", 1), 2: ("z", 1), 3: (None, None)}
    assert substring_dedup.clean_documents(docs, 5).columns == docs.columns


@pytest.mark.parametrize("width,most", [(1, 7), (5, 5), (5, 16), (13, 40)])
def test_anchors_of_long_texts_do_not_depend_on_the_runs_they_are_taken_in(width, most):
    values = np.random.default_rng(width).integers(0, 6, 500).astype(np.uint64) << np.uint64(40)
    want = [i + int(np.argmin(values[i : i + width])) for i in range(500 - width + 1)]
    assert repeats.sliding_argmin(values, width).tolist() == want == repeats.sliding_argmin(values, width, most).tolist()


def test_texts_of_megabytes(spark):
    """A passage that two very long texts share, one of them twice, goes from all places; the rest stays."""
    rng = np.random.default_rng(3)
    noise = lambda n: " ".join(f"{x:x}" for x in rng.integers(0, 2**40, n))
    passage, head, tail, other = noise(900), noise(120_000), noise(100_000), noise(200_000)
    texts = [f"{head} {passage} {tail} {passage}", f"{other} {passage}", "short"]
    assert min(map(len, texts[:2])) > 2_000_000
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeated_windows(rows(spark, texts)).collect()}
    assert got == {0: 1800, 1: 900, 2: 0}
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeated_strings(rows(spark, texts)).collect()}
    n = len(passage) + 1  # with the space before it
    assert got[2] == (0, 0) and got[1] == (n, 1) and got[0] in {(2 * n, 2), (2 * n + 1, 2)}


def test_suffix_names_follow_the_order_of_suffixes(spark):
    """Names of nine phrases: equal where the phrases are, and in the order of the phrases."""
    rng = random.Random(5)
    seqs = {r: [rng.randint(1, 3) for _ in range(40)] for r in range(6)}
    seqs[6] = seqs[0][:]
    df = spark.createDataFrame([(r, i, 0, p) for r, s in seqs.items() for i, p in enumerate(s)], "_row long, nth long, run long, phrase long")
    got = [(r.rank, (seqs[r._row] + [0] * 9)[r.nth : r.nth + 9]) for r in suffix_dedup.suffix_names(df)[0].where("nth % 3 > 0").collect()]
    assert len(got) == sum(i % 3 > 0 for s in seqs.values() for i in range(len(s)))
    names = {}
    for rank, nine in got:
        assert names.setdefault(rank, nine) == nine
    assert len(names) == len({tuple(n) for n in names.values()})
    assert repeats.ROW == "_row"
