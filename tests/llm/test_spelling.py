"""Spelling variants against all pairs, against SQL on whole tables, and the edges."""

import random
import zlib

import duckdb
import pytest

from sparkledger.llm import spelling as S


def brute(rows, damage=199):
    import re

    count = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                count[run] = count.get(run, 0) + 1
    count = {w: n for w, n in count.items() if n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = [], {}
    for w, n in count.items():
        others = [v for v in count if near(w, v)]
        best = min(others, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best and count[best] >= 5 * n else None
        out.append([w, form[w], None, n, len(others), count[form[w]] if form[w] else None])
    for r in out:
        r[2] = r[0]
        while form[r[2]]:
            r[2] = form[r[2]]
    return sorted(map(tuple, out))


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    return sorted(tuple(r) for r in S.variants(df, **more).collect())


@pytest.mark.parametrize("cell", [4000, 7])
def test_all_pairs(spark, cell):
    rng = random.Random(4)
    base = ["".join(rng.choice("abeéß") for _ in range(rng.randint(6, 9))) for _ in range(120)]
    rows = []
    for i in range(160):
        said = []
        for _ in range(150):
            w = base[int(rng.random() ** 4 * len(base))]
            p = rng.randrange(len(w))
            said.append(rng.choice([w] * 30 + [w[:p] + w[p + 1 :], w[:p] + "a" + w[p:], w[:p] + "b" + w[p + 1 :], w.upper(), w + "a", "a" + w]))
        rows.append((i if i % 9 else None, rng.choice([" ", "1", ", ", "Ø x \n"]).join(said)))
    want = brute(rows)
    assert sum(r[4] for r in want) > 100 and sum(r[1] is not None for r in want) > 20
    assert run(spark, rows, cell=cell) == want


def test_edges(spark):
    assert run(spark, [(1, None), (2, ""), (None, None)]) == []
    assert run(spark, [(1, "x")][:0]) == []
    long = "spelling " * 200_000 + "speling " * 30 + "Speling " * 10 + "Écouter " * 6 + "écouter " * 6
    got = {r[0]: r for r in run(spark, [(1, long), (1, long)], damage=None)}
    assert got["speling"] == ("speling", "spelling", "spelling", 80, 1, 400_000) and got["spelling"] == ("spelling", None, "spelling", 400_000, 1, None)
    assert got["Écouter"][4] == 1 and got["Écouter"][1] is None and got["Écouter"][3] == 12
    ties = "abcdef " * 5 + "abcdeg " * 25 + "abcdea " * 25
    assert {r[0]: r[1] for r in run(spark, [(1, ties)], damage=None)} == {"abcdef": "abcdea", "abcdeg": None, "abcdea": None}
    chain = "abcdef " * 5 + "abcdegf " * 25 + "abcdegfh " * 125 + "zbcdegfh " * 625
    assert {r[0]: (r[1], r[2]) for r in run(spark, [(1, chain)], damage=None)}["abcdef"] == ("abcdegf", "zbcdegfh")


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(S.oracle_sql()).fetchall()
    assert len(want) > 1000
    assert sorted(tuple(r) for r in S.variants(spark.read.parquet(f"{sf}/documents.parquet")).collect()) == sorted(want)
