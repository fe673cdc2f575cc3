"""Bounds that hold whatever the rows, names that clash in another case, and classifiers beside plain versions of themselves."""

import math

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from brigade.llm import byte_bpe, decontaminate, filter_audit, language_id, licences, near_dedup, quality_rules, quality_score, sampling, suffix_dedup, token_counts
from brigade.session import shared_path

NAMES = ["KEPT", "N_Removed", "ITEMS", "Score", "Lang_Pred", "IDS", "N_Tokens", "Labels", "N_WORDS", "Hits", "Size_Difference", "_TEXT", "_ID", "Class_Id", "MASK"]
TEXTS = [(1, "a quiet line of plain words that says nothing in particular at all"), (2, None), (3, ""), (1, "x y z"), (None, "MIT License")]


def _language(df):
    model = language_id.fit(df.withColumn("lang", F.when(F.col("doc_id") == 1, "en").otherwise("de")), F.lit(True))
    return language_id.predict(df, model)


def _quality(df):
    labels = df.sparkSession.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    return quality_score.score(df, quality_score.fit(df, labels, F.lit(True)) or quality_score.Model(b"a" * 500, b"b" * 500))


def _audit(df):
    path = shared_path(df.sparkSession, "clash")
    df.write.parquet(path)
    labels = df.sparkSession.createDataFrame([], "doc_id bigint, quality int, toxic int")
    return filter_audit.audit(df.sparkSession, path, labels).where("step = 1 AND filter_order = 'ABCDE'").select(F.explode(F.sequence(F.lit(1), F.col("kept") + F.col("removed"))))


OPERATORS = {
    "quality_rules": quality_rules.clean, "suffix_dedup": suffix_dedup.dedup, "licences": licences.scan, "language_id": _language, "quality_score": _quality,
    "near_dedup": near_dedup.classes, "filter_audit": _audit,
    "decontaminate": lambda df: decontaminate.scan(df, df.sparkSession.createDataFrame([(1, "x y z")], "item_id bigint, text string")),
    "token_counts": lambda df: token_counts.count_tokens(df, token_counts.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))),
    "byte_bpe": lambda df: byte_bpe.encode(df, byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_names_clash_in_any_case(spark, docs, name):
    df = docs(TEXTS, extra=False)
    for c in NAMES:
        df = df.withColumn(c, F.lit("x"))
    got = OPERATORS[name](df)
    assert len(got.collect()) == len(TEXTS)
    low = [c.lower() for c in got.columns]
    assert len(low) == len(set(low))


def test_a_sample_has_no_more_rows_than_were_drawn(spark):
    rows = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("the cat "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    rows = rows.unionByName(spark.range(30).select(F.col("id").alias("doc_id"), F.lit("der Hund").alias("text"), F.lit("de").alias("lang")).where("doc_id != 7"))
    drawn = sampling.drawn(rows, "lang", "doc_id", 10)
    found = sampling.with_texts(drawn, rows, "doc_id", "text")
    assert drawn.count() == found.count() == 11
    again = sampling.with_texts(drawn, rows.repartition(7), "doc_id", "text")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, again.collect()))


def test_blocks_of_the_benchmark_are_jobs_of_their_own(spark, docs):
    items = [(i, f"item{i} " + " ".join(f"b{i}w{k}" for k in range(12))) for i in range(6)]
    texts = [(i, f"before {t} after") for i, t in items] + [(100, "clean"), (101, " ".join(t for _, t in items))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole, parts = (decontaminate.scan(docs(texts), bench, block_bytes=b) for b in (1 << 20, 100))
    assert parts._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 2  # not one for each block
    columns = ["doc_id", "n_words", "hits", "items", "longest_match", "longest_at", "longest_item"]
    assert sorted(map(str, whole.select(*columns).collect())) == sorted(map(str, parts.select(*columns).collect()))
    assert [r["items"] for r in parts.where("doc_id = 101").collect()] == [[str(i) for i, _ in items]]


def _grams(text):
    low = "".join(chr(c) for c in text.encode().translate(language_id._FOLD))
    return {low[i : i + n] for n in language_id.ORDERS for i in range(len(low) - n + 1)}


def test_languages_like_a_plain_kernel_ridge(spark):
    """Every n-gram set in full, every sampled text a landmark: the predictions are the same."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL AND text IS NOT NULL").orderBy("doc_id").collect()
    taught, asked = rows[0:120], rows[120:320]
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in taught], "doc_id bigint, text string, lang string")
    model = language_id.fit(df, F.lit(True))
    questions = spark.createDataFrame([(r["doc_id"], r["text"]) for r in asked], "doc_id bigint, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(questions, model).collect()}

    def kernel(a, b):
        return np.array([[len(x & y) / math.sqrt(max(len(x), 1) * max(len(y), 1)) for y in b] for x in a])

    known, new = [_grams(r["text"]) for r in taught], [_grams(r["text"]) for r in asked]
    names = sorted({r["lang"] for r in taught})
    target = np.array([[1.0 if r["lang"] == n else -1.0 for n in names] for r in taught])
    weights = np.linalg.solve(kernel(known, known) + language_id.RIDGE * len(known) * np.eye(len(known)), target)
    plain = [names[k] for k in (kernel(new, known) @ weights).argmax(1)]
    lettered = [(r, p) for r, p in zip(asked, plain) if any(c.isalpha() for c in r["text"])]
    assert sum(got[r["doc_id"]] == p for r, p in lettered) >= 0.98 * len(lettered)


def test_quality_like_two_plain_dictionaries(spark, docs):
    """Scores are the difference of two compressions by the library, part by part, on the fitted curve."""
    good, bad = "a calm line of plain words about the sea. ", "BUY!! NOW!! CHEAP!! $$$ ### "
    texts = [(i, (good if i % 2 else bad) * (3 + i % 5) + str(i)) for i in range(60)] + [(100, good * 300), (101, ""), (102, None)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    model = quality_score.fit(docs(texts), labels, F.lit(True))
    for r in quality_score.score(docs(texts), model).collect():
        raw, sizes = (r["text"] or "").encode(), []
        for blob in (model.bad, model.good):
            compressor = zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(blob), level=quality_score.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(compressor.compress(raw[k : k + quality_score.PART_BYTES])) for k in range(0, len(raw), quality_score.PART_BYTES)))
        want = (sizes[0] - sizes[1]) / len(raw) if raw else 0.0
        assert abs(r["size_difference"] - want) <= 0.01 and abs(r["score"] - 1 / (1 + math.exp(-(model.slope * r["size_difference"] + model.offset)))) < 1e-9
