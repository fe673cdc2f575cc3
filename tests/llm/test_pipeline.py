"""The pipeline against brute force, stage by stage on what the stage before kept."""

import duckdb
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from brigade.llm import byte_bpe, quality_rules
from brigade.operators.spread import settle
from tests.llm import reference

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, made = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, SF), name)
        made.append(docs)
    assert all(d.columns == columns for d in made[:-1])
    cleaned, single, cut, clean, tokens = made
    judged = {r["doc_id"]: r for r in quality_rules.clean(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert dict(pairs(cleaned)) == {i: r["clean_text"] for i, r in judged.items() if r["kept"]}

    rows = pairs(cleaned)
    classes = reference.near_classes(rows)
    assert sorted(pairs(single)) == sorted(rows[k] for k in classes if classes[k] == rows[k][0])

    rows = pairs(single)
    want = {i: kept.decode("utf-8", "ignore") for (i, _), (_, _, _, kept) in reference.without_repeats(rows).items()}
    assert dict(pairs(cut)) == {i: t for i, t in want.items() if t}
    assert cut.where(F.col("n_chars") != F.length("text")).count() == 0

    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    assert sorted(pairs(clean)) == sorted((i, t) for i, t in pairs(cut) if not reference.contamination(t, items)[1])

    codec = byte_bpe.Codec(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    texts = dict(pairs(clean))
    assert {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in tokens.collect()} == {
        i: (len(library.encode_ordinary(t)), reference.digest(t)) for i, t in texts.items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, tokens.collect()))


def test_stages_take_odd_rows(spark, docs):
    text = "plain words of a quiet text that goes on for a while and says little about much of anything at all"
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, text + " but this one ends in another way than all the others do here today"), (None, None)]
    for given in (rows, []):
        frame = docs(given)
        for name, stage in corpus_pipeline.STAGES:
            out = settle(stage(spark, frame, SF), name)
            assert name == "byte_bpe" or out.columns == frame.columns
            frame = out
        assert frame.count() == (2 if given else 0)


def test_one_row_of_a_class_stays_with_repeated_and_null_ids(spark, docs):
    def passage(name):
        return " ".join(f"{name}{i}" for i in range(60))

    first, second, third = map(passage, "abc")
    rows = docs([
        (1, first), (1, second), (0, second + " end"), (None, third), (None, third + " end"), (None, first + " end"), (None, "..."), (1, first),
    ], extra=False)
    kept = corpus_pipeline.near_dedup_stage(spark, rows, "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"][:2]) for r in kept) == [
        (False, 0, "b0"), (False, 1, "a0"), (True, 0, ".."), (True, 0, "c0")]
