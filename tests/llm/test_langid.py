import random
import zlib

import pytest

from sparkledger.llm import langid

WORDS = {"en": "the of and to in is that for it was with".split(), "fr": "le la les des une est que pour dans été".split(), "de": "der die und das nicht ist ein mit für über".split()}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 60))), lang if i % 10 else None, lang))
    rows += [(900, None, "en", "und"), (901, "", "en", "und"), (902, "123 !! 4.5", "en", "und"), (903, "７٣", None, "und"), (None, "the and of was with that", "en", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string").repartition(3)


def test_held_out_accuracy(docs):
    out = langid.identify(docs).join(docs.select("doc_id", "truth"), "doc_id").collect()
    assert len(out) == 304
    held = [r for r in out if r.held_out and r.truth != "und"]
    assert len(held) > 30 and sum(r.lang_pred == r.truth for r in held) / len(held) > 0.95
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        if r.truth == "und":
            assert r.lang_pred == "und" and r.score == 0 and r.rejected
        else:
            assert r.lang_pred in WORDS


def test_keeps_columns_and_rejects_junk(docs):
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {900, 901, 902, 903} and len(ids) > 285


def test_no_labels_and_no_rows(spark, docs):
    from pyspark.sql import functions as F

    out = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in out} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_labels_are_no_inputs(docs):
    from pyspark.sql import functions as F

    model = langid.fit(docs)
    one = {r.doc_id: (r._lang, r._score) for r in langid.add_language(docs, model).collect()}
    other = {r.doc_id: (r._lang, r._score) for r in langid.add_language(docs.withColumn("lang", F.lit("zz")), model).collect()}
    assert one == other


def test_learns_from_whole_texts(spark, docs):
    """What tells the languages apart comes after 5000 characters that all of them share; repeated rows are one; no limit on a text's length."""
    lead = "xylo zzz " * 600
    rng = random.Random(5)
    rows = [(i, lead + " ".join(rng.choice(WORDS[list(WORDS)[i % 3]]) for _ in range(5000)), list(WORDS)[i % 3]) for i in range(90)] + [(90, "the of and " * 400_000, "en")]
    long = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string").repartition(2)
    out = langid.identify(long).collect()
    assert len(out) == 182 and all(r.lang_pred == ("en" if r.doc_id == 90 else list(WORDS)[r.doc_id % 3]) and not r.rejected for r in out)
    ids, n = langid.bucket_counts(langid.np.frombuffer(b"Ab, ab", langid.np.uint8), 1 << 16)
    assert n.sum() == 4 + 3 + 2 and len(ids) == 8  # ab_ab: ab twice


def test_unknown_letters_are_rejected(spark, docs):
    """Texts of letters that no learned language has get a low score and go; texts of the learned languages stay."""
    rng = random.Random(3)
    junk = spark.createDataFrame([(5000 + i, " ".join("".join(rng.choice("жщцыюящъэ") for _ in range(rng.randint(3, 9))) for _ in range(40)), "en") for i in range(40)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert langid.add_language(junk, model).where("_reject").count() == 40
    assert langid.add_language(docs.where("truth != 'und'"), model).where("_reject").count() <= 3
