import random

import numpy as np

from sparkledger.llm import decontaminate as D


def test_leaks(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    common = ["the", "of", "and", "to"]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(18, 60)).replace(" ", ". ", 1)) for i in range(12)] + [(98, None), (99, "")]
    docs, want = [], set()
    for i in range(120):
        t = text(rng.randint(10, 400)).split()
        if i % 6 == 0:
            item = rng.choice(items[:12])
            w = item[1].split()
            if i % 12 == 0:  # a paraphrase: some words changed, others put in between
                for _ in range(len(w) // 12):
                    w[rng.randrange(len(w) * 2 // 3)] = rng.choice(vocabulary)
                w.insert(3, "extra")
            at = rng.randrange(len(t) + 1)
            t[at:at] = [x.upper() for x in w]
            want.add((i, item[0]))
        docs.append((i, " ".join(t), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (0, docs[0][1], "x")]
    table = spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.leaks(table, bench)
    rows = got.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want
    assert sum(r.doc_id == 0 for r in rows) == 2
    kept = D.drop_leaks(table, bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, *_ in docs if i not in {d for d, _ in want})
    assert kept.columns == table.columns
    assert D.leaks(table, bench.limit(0)).count() == 0 and D.leaks(table.limit(0), bench).count() == 0


def test_paraphrases_without_the_rarest_words(spark):
    rng = random.Random(8)
    frequent, rare = [f"f{i}" for i in range(150)], [f"r{i}" for i in range(200)]
    items, planted = [], []
    for i in range(20):
        w = rng.sample(frequent, 32) + rng.sample(rare, 8)
        rng.shuffle(w)
        items.append((i, " ".join(w)))
        planted.append((i, " ".join(f"new{i}" if x[0] == "r" else x for x in w)))
    docs = planted + [(100 + i, " ".join(rng.choice(rare if rng.random() < 0.1 else frequent) for _ in range(400))) for i in range(3000)]
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, i) for i in range(20)}


def test_long_items_leak_by_their_parts(spark):
    words = [f"w{i}x" for i in range(200)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b " + " ".join(words[60:140]) + " c"), (2, "nothing of it")], "doc_id long, text string")
    assert [r.doc_id for r in D.leaks(docs, bench).collect()] == [1]


def test_one_document_of_its_own(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa.")], "item_id long, text string")
    docs = spark.createDataFrame([(7, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.subsequence) for r in D.leaks(docs, bench).collect()] == [(7, 1, 1.0)]


def test_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 70)), rng.integers(0, 5, rng.integers(0, 90))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert D.common_subsequence(a, b) == table[-1, -1]


def test_items_with_ids_of_any_type_and_letters_of_any_case(spark):
    words = "Älpha BETA gamma delta epsilon zeta eta theta iota ÖKAPPA"
    bench = spark.createDataFrame([("x-1", words), (None, words + " more")], "item_id string, text string")
    docs = spark.createDataFrame([(7, words.lower()), (8, "nothing")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()} == {(7, "x-1"), (7, None)}
