"""Classifiers: held-out accuracy on whole tables, and cases."""

import zlib

import pytest
from pyspark.sql import functions as F

from brigade.llm import language_id, quality_score
from brigade.llm import queries as llm

SF = "/root/testdata/sf0.01"


def test_languages_held_out(spark):
    got = llm.QUERIES["op4_language_id"](spark, SF)
    rows = got.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_language_cases(spark, docs):
    texts = [(1, "the cat and the dog"), (2, "der Hund und die Katze"), (3, None), (4, ""), (5, "123 !?"), (6, "the " * 30000), (None, "und die"), (1, "the cat and the dog")]
    df = docs(texts).withColumn("lang", F.when(F.col("text").contains("the"), "en").when(F.col("text").contains("die"), "de"))
    model = language_id.fit(df, F.lit(True))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(df, model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, 6, None)] == ["en", "de", "und", "und", "und", "en", "de"]
    assert got[3][1] == got[5][1] == 0 and got[1][1] > 0.5
    assert language_id.predict(df.limit(0), model).count() == 0
    nothing = language_id.fit(df, F.lit(False))
    assert nothing is None and {tuple(r) for r in language_id.predict(df, nothing).select("lang_pred", "score").collect()} == {("und", 0.0)}


def test_predictions_use_the_text_alone(spark, docs):
    model = language_id.fit(docs([(1, "the cat"), (2, "der Hund")]).withColumn("lang", F.when(F.col("doc_id") == 1, "en").otherwise("de")), F.lit(True))
    a, b = (language_id.predict(docs([(i, "the cat")]).withColumn("lang", F.lit(x)), model).select("lang_pred", "score").first() for i, x in ((1, "en"), (9, "de")))
    assert a == b


def test_quality_held_out(spark):
    got = llm.QUERIES["op5_quality_classifier"](spark, "/root/testdata/sf0.1")
    rows = got.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    for label in (0, 1):
        mine = [r for r in rows if r["quality"] == label]
        assert sum(r["predicted"] == label for r in mine) >= 0.95 * len(mine)


def test_quality_cases(spark, docs):
    good, bad = "a calm line of plain words about the sea. ", "BUY!! NOW!! CHEAP!! $$$ ### "
    texts = [(i, (good if i % 2 else bad) * (3 + i % 5) + str(i)) for i in range(60)] + [(100, None), (101, ""), (102, good * 3000), (None, good * 3), (1, good)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality_score.fit(docs(texts), labels, F.lit(True))
    got = quality_score.score(docs(texts + [(200, good * 4), (201, bad * 4)]), model).collect()
    by = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == len(texts) + 2 and by[200] > 0.7 > by[201] and by[102] > 0.7 and by[100] == by[101]
    assert quality_score.score(docs([]), model).count() == 0
    one_sided = quality_score.fit(docs(texts), labels.where("quality = 1"), F.lit(True))
    assert one_sided is None and quality_score.score(docs([(1, "x")]), one_sided).first()["score"] == 0.5


@pytest.mark.parametrize("name", ["op4_language_id", "op5_quality_classifier"])
def test_every_document_has_a_row(spark, name):
    assert llm.QUERIES[name](spark, "/root/testdata/sf0.001").select("doc_id").distinct().count() == 200
