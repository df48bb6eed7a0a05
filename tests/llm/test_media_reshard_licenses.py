import hashlib
import os
import textwrap
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkledger.llm import common, licenses, media, reshard

TEXTS = ["plain", "", None, "é" * 500, "plain", "x" * 64, "y" * 200_000]


def rows(spark):
    return spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(TEXTS)] + [(None, "none", "a", "b")], "doc_id long, text string, media string, shard_name string").repartition(2)


def test_media_round_trip(spark):
    got = {r.doc_id: r for r in media.media_features(rows(spark)).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate([*TEXTS, "none"]):
        r = got[i if i < len(TEXTS) else None]
        payload = media.pad((t or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert media.decode_png(media.encode_png(payload)) == payload
    assert got[0].media_sha256 == got[4].media_sha256 and got[0].feature == got[4].feature
    assert media.media_features(rows(spark).limit(0)).count() == 0


def test_ranges_and_damaged_members(spark):
    folder = common.new_path(spark, "media")
    assert media.write_archives(rows(spark).coalesce(1), folder) == len(TEXTS) + 1
    whole = {r.member: bytes(r.media) for r in media.read_archives(spark, folder).collect()}
    pieces = media.read_archives(spark, folder, rangebytes=300, batchbytes=100)
    assert {r.member: bytes(r.media) for r in pieces.collect()} == whole and pieces.rdd.getNumPartitions() > 2
    r = media.read_archives(spark, folder).orderBy("offset").first()
    path = r.archive
    with open(path, "r+b") as f:
        f.seek(r.offset + 30 + len(r.member) + 20)
        f.write(b"\0\1\2")
    bad = media.read_archives(spark, folder, tries=2).collect()
    assert len(bad) == len(whole) and [(x.member, x.tries) for x in bad if x.error] == [(r.member, 2)]
    assert all(bytes(x.media) == whole[x.member] for x in bad if not x.error)


def test_flow_moves_least():
    flow = reshard.minimum_cost_flow([10, 0, 5], [5, 5, 5], [[int(i != j) for j in range(3)] for i in range(3)])
    assert [sum(f) for f in flow] == [10, 0, 5] and [sum(c) for c in zip(*flow)] == [5, 5, 5]
    assert sum(f for i, row in enumerate(flow) for j, f in enumerate(row) if i != j) == 5
    dear = reshard.minimum_cost_flow([4, 4], [4, 4], [[5, 1], [1, 5]])
    assert dear == [[0, 4], [4, 0]]
    with pytest.raises(ValueError):
        reshard.minimum_cost_flow([2], [1], [[0]])


@pytest.mark.parametrize("options", [{}, {"blocks": 4, "part_bytes": 3000}])
def test_reshard(spark, options):
    docs = spark.createDataFrame([(i, "t" * (i % 97) if i % 11 else None, f"s{i % 7 if i % 3 else 0}") for i in range(4000)] + [(1, "same", "s1")] * 5 + [(None, "x", "s2")], "doc_id long, text string, source string").repartition(4)
    old = F.pmod(F.xxhash64("source"), F.lit(16))
    out = reshard.reshard(docs, old, **options).toPandas()
    assert len(out) == 4006
    size = out.groupby("shard")["_size"].sum()
    assert len(size) == 16 and size.max() - size.min() <= 3 * 97
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    before = out.groupby("_old")["_size"].sum()
    moved = out.loc[out["_old"] != out["shard"], "_size"].sum()
    least = sum(max(0, v - size.sum() / 16) for v in before)
    assert least - 97 * 32 <= moved <= least + 97 * 32
    assert reshard.reshard(docs.limit(0), old).count() == 0


def test_only_affected_files_are_rewritten(spark):
    """One old shard overflows and one has room; with slack the others keep their very files, and as few bytes move as can."""
    from pyspark.errors import AnalysisException

    sizes = [900, 300, 300, 310, 300]
    docs = spark.createDataFrame([(k * 1000 + i, f"{i:09d}", k, "own", k) for k, n in enumerate(sizes) for i in range(n)], "doc_id long, text string, shard int, slot string, _hash int")
    old, new = common.new_path(spark, "old"), common.new_path(spark, "new")
    docs.write.partitionBy("shard").parquet(old)
    capacities = [9000 - 2000, 5000, 3000, 3100, 3000]
    folders, flows = reshard.reshard_files(spark, old, new, capacities, shards=5)
    assert reshard.affected(flows) == [0, 1] and reshard.moved_bytes(flows) == 2000
    assert folders == [f"{new}/shard=0", f"{new}/shard=1"] + [f"{old}/shard={k}" for k in (2, 3, 4)]
    with pytest.raises(AnalysisException):
        spark.read.parquet(f"{new}/shard=2")
    out = reshard.read_shards(spark, folders)
    assert sorted(out.columns) == sorted(docs.columns)
    got = out.toPandas()
    assert got.drop(columns="shard").sort_values("doc_id").values.tolist() == docs.toPandas()[[c for c in got.columns if c != "shard"]].sort_values("doc_id").values.tolist()
    assert got.groupby("shard").size().tolist() == [700, 500, 300, 310, 300]
    same, _ = reshard.reshard_files(spark, old, common.new_path(spark, "new"), shards=5, slack=2.0)
    assert same == [f"{old}/shard={k}" for k in range(5)]


def test_reshard_keeps_columns_of_the_same_name(spark):
    docs = spark.createDataFrame([(i, "x" * i, i, "s", 7) for i in range(40)], "doc_id long, text string, _hash int, Shard string, _size int")
    out = reshard.reshard(docs, F.pmod("_hash", F.lit(16))).toPandas()
    assert {"own__hash", "own_Shard", "own__size", "_size", "shard", "slot"} <= set(out.columns)
    assert (out["own__hash"] == out["doc_id"]).all() and (out["_size"] == out["doc_id"] + 1).all() and (out["own__size"] == 7).all()
    assert (out["_old"] == out["doc_id"] % 16).all()


def test_licenses(spark):
    mit = next(t for i, t in licenses.LICENSES if i == "MIT")
    bsd = next(t for i, t in licenses.LICENSES if i == "BSD-3-Clause")
    texts = [
        ("MIT", "MIT LICENSE\n\nCopyright (c) 2020 Some One\n(C) Other\n\n" + mit.upper().replace(",", " ;")), ("MIT", "© 1999 X\n" + mit.replace("sublicense", "sub-licence")), ("BSD-3-Clause", "\t" + bsd.replace(" ", "\n ")),
        (None, mit + " And more."), (None, ""), (None, None), (None, "Copyright 2001 Only"), (None, "!!!"), ("MIT", mit), ("MIT", mit),
    ]
    docs = spark.createDataFrame([(i, t, "mine") for i, (_, t) in enumerate(texts)], "doc_id long, text string, license_id string")
    out = licenses.scan(docs)
    got = {r.doc_id: r.license_id for r in out.collect()}
    assert got == {i: want for i, (want, _) in enumerate(texts)}
    assert licenses.scan(docs.limit(0)).count() == 0
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841  (DuckDB reads it by name)
    con.register("documents", documents)
    assert sorted(map(str, con.execute(licenses.oracle_sql()).fetchall())) == sorted(str((r.doc_id, r.digest, r.license_id)) for r in out.collect())


PUBLISHED = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.exists(f"{PUBLISHED}/GPL-3"), reason="no published texts on this machine")
def test_longer_licences(spark):
    """Whole texts as published, filled in, wrapped anew or in capitals, and texts with a word more or less, which are none."""
    read = lambda name: open(f"{PUBLISHED}/{name}", encoding="utf-8").read()
    apache, gpl, mpl = read("Apache-2.0"), read("GPL-3"), read("MPL-2.0")
    filled = apache.replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2024 Some One")
    terms = apache[: apache.index("END OF TERMS") + len("END OF TERMS AND CONDITIONS")]
    texts = [("Apache-2.0", apache), ("Apache-2.0", filled), ("Apache-2.0", textwrap.fill(terms, 60)), ("GPL-3.0", gpl.upper()), ("GPL-3.0", gpl.replace("https://", "http://")), ("MPL-2.0", " ".join(mpl.split()))]
    texts += [(None, apache.replace("royalty-free", "royalty", 1)), (None, "Note. " + gpl)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs).collect()}
    assert got == {i: want for i, (want, _) in enumerate(texts)}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert {r[0]: r[2] for r in con.execute(licenses.oracle_sql()).fetchall()} == got


def test_a_table_of_licences(spark):
    own = spark.createDataFrame([("House", "Use it as you like."), ("Blank", " "), ("Also", "use it: as YOU like")], "name string, body string")
    docs = spark.createDataFrame([(1, "(c) 2020 X\nUse it, as you like!"), (2, "Use it")], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs, licenses.digests_of(own, "name", "body")).collect()}
    assert got == {1: "Also", 2: None}


def test_an_old_shard_out_of_range_is_an_error(spark):
    import pytest
    from pyspark.sql import functions as F

    from sparkledger.llm import reshard

    docs = spark.createDataFrame([(1, "a", 0), (2, "b", 99), (3, None, None)], "doc_id long, text string, old int")
    for bad in (2, 3):
        with pytest.raises(Exception, match="no old shard"):
            reshard.plan(docs.where(F.col("doc_id").isin(1, bad)), F.col("old"))
