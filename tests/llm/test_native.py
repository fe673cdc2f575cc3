"""Chat formatting, quality rules and sharding: cases and whole tables against SQL."""

import pytest
from pyspark.sql import functions as F

from brigade.llm import chat, quality_rules, sharding
from brigade.llm import queries as llm
from tests import oracle

SF = "/root/testdata/sf0.001"
CHAT = "conv_id bigint, turn bigint, role string, text string, page string, pos string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], CHAT)


def test_snapshots_collapse(spark):
    a, b, c = ("user", "hi"), ("assistant", "yo"), ("user", "more")
    rows = [(1, 0, *a), (1, 1, *b), (2, 0, *a), (2, 1, *b), (2, 2, *c), (3, 5, *a), (3, 9, *b), (3, 11, *c), (4, 0, *b), (4, 1, *a),
            (5, 0, "user", "hi!"), (None, 0, "user", None), (6, None, None, None), (6, 1, *a), (6, 1, *a)]
    got = {r["conv_id"]: r for r in chat.render(turns(spark, rows)).collect()}
    # 1 is a prefix of 2; 3 equals 2; the rest stand alone
    assert set(got) == {2, 4, 5, 6, None}
    assert got[2]["n_copies"] == 2 and got[2]["rendered"] == "<|user|>\nhi\n<|assistant|>\nyo\n<|user|>\nmore\n"
    assert got[6]["n_turns"] == 2 and got[6]["rendered"] == "<||>\n\n<|user|>\nhi\n"
    assert got[None]["rendered"] == "<|user|>\n\n"
    assert chat.render(turns(spark, [])).count() == 0


def test_long_conversations_are_paged(spark):
    rows = [(1, i, "user", str(i)) for i in range(25)] + [(2, i, "user", str(i)) for i in range(24)]
    got = chat.render(turns(spark, rows), page_turns=10).orderBy("page").collect()
    assert [(r["conv_id"], r["page"]) for r in got] == [(1, 0), (1, 1), (1, 2)]
    assert "".join(r["rendered"] for r in got) == "".join(f"<|user|>\n{i}\n" for i in range(25))


def test_line_rules(spark, docs):
    prose = "a quiet line of plain words that says nothing in particular at all"
    texts = [
        prose, prose + "\nHome | News | About | Contact", prose + "\nLicensed under the Apache License, Version 2.0.",
        "one*** two### three$$$ four%%% five&&& six*** seven$$$ eight### nine%%% ten***", "too short", "", None, " \n\t ",
        "x " * 5000, "\n".join([prose] * 2), "Stop! " + prose,
        "HOME | NEWS | ABOUT | MORE | ELSE | HERE | THERE | EVER | NEVER | AGAIN\n" + "last words stay here",
    ]
    got = {r["doc_id"]: r for r in quality_rules.clean(docs(enumerate(texts))).collect()}
    assert [i for i in got if got[i]["kept"]] == [0, 1, 2, 10]
    assert got[1]["clean_text"] == prose and got[2]["clean_text"] == prose and got[10]["clean_text"] == texts[10]
    assert got[6]["clean_text"] is None and got[5]["clean_text"] == "" and got[9]["n_dup_lines"] == 1
    assert got[8]["n_repeat_words"] == 5000 and got[8]["base_failed"] and not got[3]["base_failed"]
    assert got[0]["_q"] == "x" and got[0]["n_words"] == 13
    assert quality_rules.clean(docs([])).count() == 0


CLEAN = [
    "the design includes a small assign up to four steps in each of them", "our catalog in print and a dialog in two parts were shown today",
    "they spread more butter on it and ate a cookie before the long walk home", "an essay on copyright law is read by every student in the first year",
    "she had to sign in at the front desk before the meeting could start", "self._a = b_c", "x = {k: v for k, v in d.items() if k != '_id'}",
    "if (a && b != c) { return a[i] * b[j] + c; }", "### Results", "**Note** and **more**", "cookie = get_cookie()", "user@host:/srv$ make",
    "Copyright 1998 was the year the court changed its mind about it", "(c) 2004 the tribunal held that the claim had no basis in law",
    "(c) the third claim is that the goods were late and had been paid", "their code, licensed under the MIT license, was later the subject of a long dispute",
    "the copyright of 1998 lapsed in the spring of that year and nobody asked", "a C# class ... !! and more words here", "it is read more often than not, we are told",
    "lorem ipsum is the text that printers have used for a very long time",
]
JUNK = [
    "Read more", "Click here to sign in", "© 2020 Acme Inc. All rights reserved.", "We use cookies, see our cookie policy.",
    "Subscribe to our newsletter!", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
    "so!! what,!! then!!", "And$$$ on.", "*** *** ***", "Copyright (c) 2019-2021 The Foo Authors", "(c) 2004 Acme and Sons", "click here click here", "© Acme Ltd.",
    "Home | News | About | Contact", "Lorem ipsum dolor sit amet, consectetur adipiscing elit", "Provided 'as is' without warranty of any kind",
]


def test_phrases_and_operators_inside_clean_lines(spark, docs):
    got = {r["doc_id"]: r for r in quality_rules.clean(docs(enumerate(CLEAN + JUNK))).collect()}
    assert [t for i, t in enumerate(CLEAN + JUNK) if got[i]["n_failed_lines"]] == JUNK
    long = [i for i, t in enumerate(CLEAN) if len(t.split()) >= 10]
    assert all(got[i]["kept"] for i in long) and got[0]["clean_text"] == CLEAN[0] and len(long) >= 10


def test_rules_and_their_sql_agree_line_by_line(spark):
    """Each line beside as many plain words: whether it stays decides whether the document does."""
    lines = [*CLEAN, *JUNK, "a!b!! x## y$$$", "!!a !!b !!c !!d", "one~~ two^^ three%% four", "x" * 50 + "!!!", "", "   ", "› a » b"]
    rows = [(2 * i + j, t + "\n" + " ".join(f"w{i}x{k}" for k in range(max(len(t.split()) - j, 1)))) for i, t in enumerate(lines) for j in (0, 1)]
    rows += [(1000 + i, " ".join([t] * 3)) for i, t in enumerate(lines)] + [(5000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    con = oracle.duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = quality_rules.clean(df).select("doc_id", *quality_rules.BASE, "base_failed", "kept")
    assert oracle.compare(got, con, llm.SQL["op6_quality_rules"]) is None


@pytest.mark.parametrize("limit,step", [(3000, 2), (20_000, 5)])
def test_shards_split_like_the_definition(spark, limit, step):
    df = sharding.shards(spark.read.parquet(f"{SF}/documents.parquet"), limit=limit, step=step)
    assert oracle.compare(df, oracle.connect(SF), llm.sharding_sql(limit)) is None


def test_shards_of_repeated_keys_overflow(spark):
    rows = spark.range(300).select((F.col("id") * 0).alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    more = spark.createDataFrame([(None, None), (1, None), (2, "y" * 1000), (0, "z" * 90)], "doc_id bigint, text string")
    got = sharding.shards(rows.union(more), limit=100)
    assert got.count() == 304
    assert [(r["doc_id"], r["n_bytes"]) for r in got.where("not fits").collect()] == [(2, 1000)]
    sums = got.groupBy("shard").agg(F.sum("n_bytes").alias("s"), F.max("shard_bytes").alias("t"), F.count("*").alias("n"), F.max("shard_docs").alias("m"))
    assert sums.where("s != t OR n != m").count() == 0
    assert sharding.shards(rows.limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n in llm.SQL])
def test_query_matches_sql(spark, name):
    assert oracle.compare(llm.QUERIES[name](spark, SF), oracle.connect(SF), llm.SQL[name]) is None


@pytest.mark.parametrize("name", ["op2_chat_formatting", "op6_quality_rules", "op7_sharding"])
def test_no_python_in_the_plan(spark, name):
    plan = llm.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop") if w in plan]
