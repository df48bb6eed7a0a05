"""The pipeline's stages against plain versions of their decisions, and the registered queries on a small table."""

import random

import pytest

import __spark_entry__
import corpus_pipeline
from sparkledger.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    word = {"en": "the of and that with was for is", "fr": "le la des que pour dans une est"}
    vocabulary = {k: v.split() + ["".join(rng.choice("aeioulrst") for _ in range(6)) for _ in range(300)] for k, v in word.items()}
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    docs = [(i, text(lang := rng.choice(["en", "fr"]), rng.randint(80, 200)), lang, "s") for i in range(80)]
    docs += [(200, docs[0][1], "en", "s"), (201, docs[1][1].replace(docs[1][1].split()[40], "changed", 1), "en", "s"), (202, "12 34 !!", None, "s"), (203, None, None, "s")]
    item, passage = text("en", 30), text("en", 60)
    docs += [(300, f"{text('en', 60)} {item} {text('en', 60)}", "en", "s"), (301, f"{text('en', 90)} {passage} {text('en', 80)}", "en", "s"), (302, f"{text('en', 70)} {passage}", "en", "s")]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"file://{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{at}/benchmark.parquet")
    return f"file://{at}", dict((d[0], d[1]) for d in docs), passage


def test_stages(spark, folder):
    sf, texts, passage = folder
    docs, ids = spark.read.parquet(f"{sf}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.common.stored(stage(spark, docs, sf), name)
        ids[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns or k == 4
    assert set(texts) - set(ids["language_id"]) == {202, 203}
    assert set(ids["language_id"]) - set(ids["near_dedup"]) == {200, 201}
    cut = ids["substring_dedup"]
    for i in (301, 302):
        assert passage not in cut[i].text and cut[i].n_chars == len(cut[i].text)
    assert all(cut[i].text == texts[i] for i in cut if i not in (301, 302))
    assert set(cut) - set(ids["decontamination"]) == {300}
    assert set(ids["packing"]) == set(ids["decontamination"])
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_entry():
    assert {*queries.QUERIES, "pipeline"} <= set(__spark_entry__.queries())
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in queries.QUERIES)] == []
    assert "op5_licenses" in __spark_entry__.oracle_sql()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_whole_tables(spark, name):
    """A row for each row of the table (pieces: at least one; leaks and words: some; neighbours: 20 a query; components: 32 a vector)."""
    out = queries.QUERIES[name](spark, SF)
    op = name.split("_")[0]
    table = spark.read.parquet(f"{SF}/{ {'op1': 'pages', 'op12': 'embeddings', 'op13': 'embeddings'}.get(op, 'documents') }.parquet")
    n = table.count()
    if op == "op3":
        assert 0 < out.count() < n
    elif op == "op4":
        assert out.select("doc_id").distinct().count() == n
    elif op == "op11":
        assert 0 < out.count() == out.select("word").distinct().count()
    elif op == "op12":
        assert out.count() == 20 * table.where("vec_id % 20 = 0").count()
    elif op == "op13":
        vectors = out.groupBy("vec_id").count().collect()
        assert len(vectors) == n and {r["count"] for r in vectors} == {32}
    else:
        assert out.count() == n
