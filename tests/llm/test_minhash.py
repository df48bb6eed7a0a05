import random

import numpy as np

from sparkledger.llm import components, minhash


def brute(texts, idf):
    """Classes by links of weighted Jaccard 0.8 or more between all pairs."""
    sets = []
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        _, h, w = minhash.weighted_shingles(*minhash._words(raw, np.array([0, len(raw)])), idf)
        sets.append(dict(zip(h.tolist(), w.tolist())))
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
            total = sum(a.values()) + sum(b.values()) - both
            if total and both >= 0.8 * total:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_classes_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 120))) for _ in range(40)]
    for t in texts[:12]:
        for edits in (0, 1, 1, 2, 4, 9):
            w = t.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    texts += ["a b", "A b", None, None, "", "  ", "one two three"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string").repartition(3)
    idf = minhash.inverse_frequencies(docs)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert [got[i].class_id for i in range(len(texts))] == brute(texts, idf)
    for r in got.values():
        assert r.keep == (r.doc_id == r.class_id) and r.class_size == sum(x.class_id == r.class_id for x in got.values())
    assert sorted(r.doc_id for r in minhash.keep_one(docs).collect()) == sorted({r.class_id for r in got.values()})
    assert minhash.keep_one(docs).columns == docs.columns


def test_copies_linked_by_an_original_that_is_no_head(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(20)]
    original = [rng.choice(vocabulary) for _ in range(300)]
    texts = []
    for _ in range(140):
        w = list(original)
        for k in range(5):
            w[k * 60 + rng.randrange(5, 55)] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts.insert(97, " ".join(original))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    idf = minhash.inverse_frequencies(docs)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    want = brute(texts, idf)
    assert set(want) == {0} and [got[i] for i in range(len(texts))] == want


def test_samples_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    w = rng.uniform(0.5, 5, 300)
    a, b = slice(0, 220), slice(60, 300)
    sampler = minhash.Sampler(2000)
    one = sampler(np.zeros(220, int), np.sort(h[a]), w[a][np.argsort(h[a])], 1)
    two = sampler(np.zeros(240, int), np.sort(h[b]), w[b][np.argsort(h[b])], 1)
    assert abs((one == two).mean() - w[60:220].sum() / w.sum()) < 0.04


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (None, "q r s t u v")], "doc_id long, text string")
    out = minhash.near_duplicates(docs).collect()
    assert sorted((r.class_id is None, r.class_size, r.keep) for r in out) == [(False, 3, False), (False, 3, False), (False, 3, True), (True, 1, True)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 140)) and got[201] == 200


def test_many_copies_around_one_original_at_mixed_distances(spark):
    """Bands hold rows that are near the original, rows that are not, and near copies of those."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    original = [rng.choice(vocabulary) for _ in range(200)]
    texts = [" ".join(original)]
    for _ in range(150):
        w = list(original)
        for _ in range(rng.choice((1, 3, 6, 10, 16))):
            k = rng.randrange(len(w))
            w[k : k + rng.choice((0, 1, 2))] = [rng.choice(vocabulary) for _ in range(rng.choice((0, 1, 1)))]
        texts.append(" ".join(w))
        if rng.random() < 0.3:
            w[rng.randrange(len(w))] = "other"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    idf = minhash.inverse_frequencies(docs)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    want = brute(texts, idf)
    assert len(set(want)) > 5 and [got[i] for i in range(len(texts))] == want


def test_texts_whose_rolling_hashes_collide_stay_apart(spark):
    """Thue-Morse sequences of two words and their complements are equal under any polynomial hash modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    docs = spark.createDataFrame([(0, " ".join(("ab", "cd")[b] for b in bits)), (1, " ".join(("cd", "ab")[b] for b in bits)), (2, " ".join(("cd", "AB")[b] for b in bits))], "doc_id long, text string")
    data, off = minhash.C.text_buffers(minhash.pa.array([r.text for r in docs.orderBy("doc_id").collect()]))
    digest, other = minhash._digests(data, off)
    assert digest[0] != digest[1] and other[0] != other[1] and digest[1] == digest[2] and other[1] == other[2]
