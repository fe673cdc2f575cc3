"""Repeats, near duplicates and contamination against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brigade.llm import decontaminate, deep_shallow, near_dedup, probminhash, suffix_dedup, words
from tests.llm import reference

SF = "/root/testdata/sf0.001"
PASSAGE = "a passage that many documents share, " * 6


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(n))


def test_suffixes_are_sorted_with_their_common_prefixes():
    rng = random.Random(3)
    for _ in range(150):
        width = rng.choice([8, 20, 68, 100])
        bases = [bytes(rng.choice(b"\0ab") for _ in range(width)) for _ in range(3)]
        strings = []
        for _ in range(rng.randint(1, 50)):
            s = bytearray(rng.choice(bases))
            s[rng.randrange(width)] = rng.choice(b"\0abc")
            strings.append(bytes(s[: rng.choice([width, rng.randint(0, width)])]))
        rows, lengths = np.zeros((len(strings), width), np.uint8), np.array([len(s) for s in strings])
        for i, s in enumerate(strings):
            rows[i, : len(s)] = list(s)
        order, common = deep_shallow.suffix_array(rows, lengths)
        got = [strings[i] for i in order]
        assert got == sorted(strings) and sorted(order) == list(range(len(strings)))
        for k in range(1, len(got)):
            a, b = got[k - 1], got[k]
            assert common[k] == next((e for e in range(min(len(a), len(b))) if a[e] != b[e]), min(len(a), len(b)))


REPEATS = [
    (0, prose(1, 60)), (1, prose(1, 60)), (2, "x" + prose(1, 60)), (3, PASSAGE + prose(2, 30)), (4, prose(3, 30) + PASSAGE),
    (5, PASSAGE), (6, "a" * 1000), (7, "a" * 150), (8, None), (9, ""), (10, "short"), (11, "é" * 90 + prose(4, 9)), (12, prose(5, 9) + "é" * 90),
    (13, prose(6, 3000)), (14, prose(6, 3000)[5000:9000] + "!" + prose(6, 3000)[100:300]), (15, "b" * 99 + prose(7, 5)), (16, "b" * 100 + prose(8, 5)),
    (17, PASSAGE), (17, PASSAGE), (None, PASSAGE[7:] + "end"), (18, prose(9, 40) + prose(9, 40)),
]


@pytest.mark.parametrize("hot_rows", [suffix_dedup.HOT_ROWS, 3])
def test_repeated_strings_go(spark, docs, hot_rows):
    want = reference.without_repeats(REPEATS)
    got = suffix_dedup.dedup(docs(REPEATS).repartition(5), hot_rows=hot_rows).collect()
    assert len(got) == len(REPEATS)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) == want[r["doc_id"], r["text"]], r["doc_id"]
        assert sum(b - a for a, b in r["spans"]) == r["n_removed"] and r["_id"] == "x"


def test_nothing_to_remove(spark, docs):
    assert suffix_dedup.dedup(docs([])).count() == 0
    got = suffix_dedup.dedup(docs([(1, None), (2, "one text")]), whole_characters=True).select("doc_id", "kept", "n_removed").collect()
    assert sorted(map(tuple, got)) == [(1, "", 0), (2, "one text", 0)]


def test_probability_jaccard_by_its_definition():
    rng = random.Random(8)
    for _ in range(100):
        a, b = ([rng.randint(0, 12) for _ in range(rng.randint(1, 30))] for _ in range(2))
        from collections import Counter
        want = reference.probability_jaccard(Counter(a), Counter(b))
        got = probminhash.probability_jaccard(*(np.array(sorted(x), np.uint64) for x in (a, b)))
        assert got == pytest.approx(want)


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 1 << 40, 400, np.uint64)
    b = np.r_[a[:300], rng.integers(1, 1 << 40, 100, np.uint64), a[:50]]
    agree = []
    for shift in range(12):  # other ids, other registers
        runs = np.r_[a, b] + np.uint64(shift << 41)
        s = probminhash.signatures(runs, np.r_[np.zeros(len(a), int), np.ones(len(b), int)], 2)
        agree.append((s[0] == s[1]).mean())
    want = probminhash.probability_jaccard(np.sort(a), np.sort(b))
    assert np.mean(agree) == pytest.approx(want, abs=0.03)


def edited(text, every):
    return " ".join("new" + str(i) if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


NEAR = (
    [(i, prose(20, 120)) for i in range(3)] + [(3, edited(prose(20, 120), 119)), (4, edited(prose(20, 120), 20)), (5, prose(20, 120).upper() + " !!")]
    + [(6, None), (7, ""), (8, "... !"), (9, "two words"), (10, "two  words"), (11, "other words"), (None, prose(20, 120)), (None, "alone here")]
    + [(30 + i, edited(prose(21, 400), 150 + i)) for i in range(12)] + [(50, prose(22, 5000)), (51, prose(22, 5000) + " more"), (51, prose(22, 5000) + " more")]
    + [(60 + i, prose(23, 30) + " " + prose(100 + i, 30)) for i in range(6)] + [(70, "la la " * 200), (71, "la la " * 300)]
)


def test_near_duplicates(spark, docs):
    want = reference.near_classes(NEAR)
    rows = near_dedup.classes(docs(NEAR).repartition(4)).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in rows), key=str) == sorted(((i, want[k]) for k, (i, _) in enumerate(NEAR)), key=str)
    assert near_dedup.classes(docs([])).count() == 0


def test_buckets_beyond_one_block(spark, docs, monkeypatch):
    """Everything meets in the same buckets, no centre settles them, and blocks are tiny."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    monkeypatch.setattr(near_dedup, "AGREE", 1)
    monkeypatch.setattr(near_dedup, "FAR", 0)
    base = prose(30, 300)
    rows = [(i, edited(base, 30 + 3 * i)) for i in range(14)]
    want = reference.near_classes(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs(rows)).collect()}
    assert got == {i: want[k] for k, (i, _) in enumerate(rows)}


def test_further_centres_lose_no_link(spark, docs, monkeypatch):
    """Classes of near texts that are far, between and near to each other in shared buckets, at the real marks and with tiny blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    base, rows = prose(31, 260).split(" "), []
    for c in range(4):
        own = [w if (k * 7 + c) % 100 >= 4 * c else f"c{c}w{k}" for k, w in enumerate(base)]
        for v in range(4):
            rows.append((100 * c + v, " ".join(f"v{c}{v}" if k in (30 * v + 11, 17 * v + 100) else w for k, w in enumerate(own))))
    want = reference.near_classes(rows)
    assert len(set(want.values())) > 1
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs(rows)).collect()}
    assert got == {i: want[k] for k, (i, _) in enumerate(rows)}


def test_further_links_join_classes(spark):
    """Two classes, two single nodes and a chain over them; links within a class change nothing."""
    labels = spark.createDataFrame([("a", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("x", "x"), ("y", "x")], "node string, label string")
    more = [("c", "e", 0.9), ("b", "e", 0.8), ("a", "c", 1.0), ("p", "q", 0.9)]
    for rows, joined in ((more, {"b": "a", "d": "a", "e": "a", "p": "p", "q": "p"}), ([], {})):
        got = near_dedup._merged(labels, spark.createDataFrame(rows, "a string, b string, similarity double")).collect()
        want = {"a": "a", "c": "a", "d": "d", "e": "d", "x": "x", "y": "x"} | joined
        assert len(got) == len(want) and {r["node"]: r["label"] for r in got} == want


@pytest.mark.parametrize("others", [1, 40])
def test_rows_laid_for_a_large_bucket(spark, others):
    """Few others among 20,000 members of one class: about one row a member, however the others lie."""
    n = 20_000
    role = F.expr(f"CASE WHEN id < {others} THEN 'ring' WHEN id % 10 = 0 THEN 'home' ELSE 'near' END")
    told = spark.range(n).select(F.lit(5).cast("long").alias("key"), F.col("id").cast("string").cast("binary").alias("node"), F.lit(b"x").alias("label"), role.alias("role"))
    rows, left = near_dedup._laid(told, 1, False)
    assert left.isEmpty() and n <= rows.count() <= n + others * (n // near_dedup.BLOCK + 4)
    assert rows.groupBy("i", "j", "step").count().agg(F.max("count")).first()[0] < 1.2 * near_dedup.BLOCK + others


ITEMS = [(1, prose(40, 25)), (2, prose(41, 9)), (3, None), (4, ""), (5, "?!"), (6, prose(40, 25)), (7, prose(42, 10)), (8, "one word"), (None, prose(43, 12)), (10, prose(40, 25).split(" ", 3)[3])]
TEXTS = [
    (0, "see " + prose(40, 25) + " end"), (1, prose(41, 9)), (2, prose(41, 8)), (3, prose(42, 10).upper().replace(" ", ", ")), (4, None), (5, ""),
    (6, prose(40, 25).replace(" ", "\n") + " one word, One WORD"), (7, prose(50, 300)), (8, " ".join(prose(40, 25).split(" ")[:12])),
    (9, prose(43, 12) + " x " + prose(43, 12)), (9, prose(43, 12) + " x " + prose(43, 12)), (None, prose(42, 10)), (11, prose(51, 5000) + " " + prose(42, 10)),
    (12, " ".join(prose(40, 25).split(" ")[:6])), (13, " ".join(prose(40, 25).split(" ")[6:])),
]


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 60])
def test_contamination(spark, docs, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("hits", F.lit("x"))
    for r in decontaminate.scan(docs(TEXTS), items, block_bytes=block_bytes).collect():
        n, hit, found, longest = reference.contamination(r["text"], ITEMS)
        assert (r["n_words"], len(r["hits"]), r["items"], r["longest_match"]) == (n, hit, found, longest), r["doc_id"]
        if longest:
            at = r["longest_at"]
            run = " ".join(reference.words(r["text"])[at : at + longest])
            assert any(run in " ".join(reference.words(t)) for i, t in ITEMS if ("" if i is None else str(i)) == r["longest_item"])


def test_empty_benchmark_and_documents(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [r["items"] for r in decontaminate.scan(docs(TEXTS), none).collect()] == [[]] * len(TEXTS)
    assert decontaminate.scan(docs([]), none).count() == 0


def test_words_beyond_ascii():
    def found(*texts):
        raw = [t.encode() for t in texts]
        data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        starts, ends, _, first = words.find(data, at, unicode=True)
        got = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
        return [got[a:b] for a, b in zip(first, first[1:])]

    assert found("“One”—two café…", "", "中文a1中", "ガx ที่น", "हिन्दी 😀 é") == [
        ["One", "two", "café"], [], ["中", "文", "a1", "中"], ["ガ", "x", "ที่", "น"], ["हिन्दी", "é"]]


def test_near_copies_beyond_ascii(spark, docs):
    chinese = "".join(chr(0x4E00 + 7 * i) for i in range(150))
    plain = " ".join(f"\"word{i}\" - and" for i in range(60))
    curly = " ".join(f"\u201cword{i}\u201d\u2014and" for i in range(60))
    rows = docs([(1, chinese), (2, chinese[:149] + "\u4e00"), (3, plain), (4, curly)], extra=False)
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.classes(rows).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
