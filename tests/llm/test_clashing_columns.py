"""Columns of documents that carry the operators' own internal names come through unchanged."""

from sparkledger.llm import decontaminate, langid, minhash, substring_dedup

NAMES = ["_row", "_spans", "_lang", "_score", "_reject", "_kept", "_n_removed", "_n_words", "_t", "own_row", "band", "node", "label", "keep"]


def _docs(spark):
    texts = ["the cat sat on the mat " * 8, "the cat sat on the mat " * 8, "ein ganz anderer text " * 6 + str(1), None, ""]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(i, t, "en", *(f"{n}{i}" for n in NAMES)) for i, t in enumerate(texts)], schema)


def test_extra_columns_are_kept(spark):
    docs = _docs(spark)
    bench = spark.createDataFrame([(1, "no such words are in any of the documents here")], "item_id long, text string")
    for made in (minhash.keep_one(docs), decontaminate.drop_leaks(docs, bench), langid.keep_known(docs), substring_dedup.clean_documents(docs)):
        assert made.columns == docs.columns
        rows = made.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in NAMES)


def test_empty_tables_keep_their_columns(spark):
    docs = _docs(spark).limit(0)
    bench = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    for made in (minhash.keep_one(docs), decontaminate.drop_leaks(docs, bench), langid.keep_known(docs), substring_dedup.clean_documents(docs)):
        assert made.columns == docs.columns and made.count() == 0
