"""Nearest neighbours against brute force: recall on clouds without structure, exact rows where a shard is small, and the edges."""

import numpy as np
from pyspark.sql import functions as F

from sparkledger.llm import graph as G
from sparkledger.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, queries, k=20):
    """query row number -> [(score, id)] over all other rows."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = []
    for n, (i, v) in enumerate(good):
        if i % queries == 0:
            found = sorted((-float((v * w).sum()), j) for m, (j, w) in enumerate(good) if m != n)[:k]
            out.append((i, [(j, -s) for s, j in found]))
    return out


def run(spark, rows, queries, **more):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(3)
    return N.nearest(df, F.col("id") % queries == 0, **more).collect()


def lists(rows):
    """The lists as sorted text, so that repeated query ids are compared too."""
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    return {q: sorted(v) for q, v in by.items()}


def test_small_shards_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(60)]  # a hot vector, queries among it
    rows += [(300, [x * 1e6 for x in rows[1][1]]), (301, [x * 1e-6 for x in rows[2][1]]), (310, [-x for x in rows[3][1]])]
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [float("nan")] * 8), (404, [None] * 8), (405, [1.0]), (None, rows[4][1])]
    rows += [(5, rows[5][1])]  # a repeated row
    got = lists(run(spark, rows, 5, shard=40))
    want = {}
    for i, found in brute([r for r in rows if r[0] not in (401, 405)], 5):
        want.setdefault(i, []).extend((n + 1, j, round(s, 9)) for n, (j, s) in enumerate(found))
    assert got == {i: sorted(v) for i, v in want.items()}
    few = run(spark, rows[:4], 2)
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2), (0, 3), (2, 1), (2, 2), (2, 3)]
    assert run(spark, [(400, None)], 5) == [] and run(spark, [(1, [1.0, 2.0]), (2, [2.0, 1.0])], 5) == []
    assert run(spark, [(5, [1.0, 2.0])], 5) == []


def test_recall_of_whole_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = dict(brute(rows, 20))
    got = lists(N.nearest(df, F.col("id") % 20 == 0, shard=700).collect())
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({j for _, j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want]) >= 0.97


def test_the_graph_decides(spark):
    """Links are few, diverse and reach: searches in the graph find near nodes, and with links cut they don't."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links, entry = G.build(x)
    assert links.shape == (3001, G.DEGREE) and all(i not in set(links[i].tolist()) for i in range(0, 3000, 97))
    q = x[:200] + rng.normal(size=(200, 24)).astype(np.float32) * 0.1
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    true = np.argsort(-(q @ x.T), axis=1)[:, :20]

    def recall(links):
        ids, d = G.beam_search(x, links, entry, q, 100)
        got = np.take_along_axis(ids, np.argsort(d, axis=1)[:, :20], 1)
        return np.mean([len(set(a) & set(b)) / 20 for a, b in zip(got.tolist(), true.tolist())])

    assert recall(links) >= 0.95
    cut = links.copy()
    cut[:, 4:] = len(x)
    assert recall(cut) < recall(links)
