"""The gram index and the catalog automaton against brute force."""

import random

from pyspark.sql import functions as F

from brigade.operators import question_index, spread, substrings
from brigade.operators.catalog import match_questions
from tests.conftest import rows


def brute(texts, needles):
    return sorted({(a, b) for a in texts if a for b in needles if b and b.lower() in a.lower()}, key=lambda r: tuple(map(str, r)))


def frames(spark, texts, needles):
    return spark.createDataFrame([(x,) for x in texts], "item string"), spark.createDataFrame([(x,) for x in needles], "ingredient string")


def test_pairs_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(1)
    texts = ["Beef Steak", "Iced TEA", "Water melon", "tea", "", None, "steak & tea", "éclair", "a", "𝒜 tea", "x" * 3000 + "needle"]
    needles = ["tea", "Steak", "melon", "e", "ea", "beef steak", "ÉCLAIR", "zzz", "TEA", "", None, "𝒜", "a" * 40, "xneedle", "x" * 2990]
    texts += ["".join(rnd.choices("abc ", k=rnd.randrange(1, 30))) for _ in range(300)]
    needles += ["".join(rnd.choices("abc ", k=rnd.randrange(1, 8))) for _ in range(200)]
    t, n = frames(spark, texts * 2, needles)
    assert rows(substrings.pairs(t, "item", n, "ingredient")) == brute(texts, needles)
    monkeypatch.setattr(spread, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(spread, "HOT_ROWS", 5)
    assert rows(substrings.pairs(t, "item", n, "ingredient")) == brute(texts, needles)
    none = t.where("false")
    assert substrings.pairs(none, "item", n, "ingredient").count() == substrings.pairs(t, "item", n.where("false"), "ingredient").count() == 0


def test_rows_laid_follow_the_length_of_the_text(spark):
    """Not the lengths of needles: three times as long a text lays three times the rows."""
    for size in (1000, 3000):
        text = "".join(random.Random(size).choices("abcdefghijklmnopqrstuvwxyz", k=size))
        laid = spark.createDataFrame([(text,)], "t string").select(F.size(substrings.grams(F.col("t"), 3))).first()[0]
        assert laid <= size - 2


def catalog(spark, entries):
    return spark.createDataFrame([(name, k, p, kpi, skip) for k, (name, patterns, kpi, skip) in enumerate(entries) for p in patterns],
                                 "prompt_id string, position bigint, pattern string, is_kpi boolean, skip_with_period boolean")


def test_automaton_equals_the_projection(spark):
    entries = [("a", ["sales", "SALE of"], False, False), ("b", ["ales", "tips"], True, False), ("c", ["tip"], False, True), ("d", ["total"], True, False),
               ("e", ["sales today"], False, False), ("f", ["é"], False, False)]
    texts = ["Show SALES", "tips", "a tip", "the total tip of last week", "sale of it", "nothing", "", None, "  Été ", "sales last month", "tip this week", "ales today"]
    q = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string")
    want = match_questions(q, "text", [(n, p, k) for n, p, k, _ in entries], skip_with_period=["c"])
    got = question_index.match(q, "text", catalog(spark, entries))
    assert rows(got) == rows(want)
    assert rows(question_index.match(q, "text", catalog(spark, entries), catalog_bytes=-1)) == rows(want)
    with_all = catalog(spark, [*entries, ("every", [""], False, False)])
    assert {r["prompt_id"] for r in question_index.match(q, "text", with_all).collect()} >= {"every"}
    assert rows(question_index.match(q, "text", with_all)) == rows(question_index.match(q, "text", with_all, catalog_bytes=-1))
    assert question_index.match(q, "text", with_all.where("false")).where("prompt_id IS NOT NULL").count() == 0


def test_ten_thousand_patterns(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randrange(3, 7))) for _ in range(10_000)]
    texts = [" ".join(rnd.choices(words, k=3)) if rnd.random() < 0.7 else "zz " * 5 for _ in range(300)]
    q = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string")
    c = catalog(spark, [(f"p{k}", [w], k % 5 == 0, False) for k, w in enumerate(words)])
    want = sorted((i, t, next((f"p{k}" for k, w in enumerate(words) if w in t), None)) for i, t in enumerate(texts))
    assert sorted(map(tuple, question_index.match(q, "text", c).collect())) == want
    assert sorted(map(tuple, question_index.match(q, "text", c, catalog_bytes=0).collect())) == want
