"""Filter audit, lexical search and licence scans against brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from brigade.llm import filter_audit, lexical_search, licences
from brigade.llm import queries as llm
from brigade.session import shared_path
from tests import oracle
from tests.llm import reference

SF = "/root/testdata/sf0.001"


# ---- filter interaction audit


def audited(rows, labels):
    """{(part, order, step): figures} by applying every order to every row."""
    def mask(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        caps = sum("A" <= c <= "Z" for c in text)
        return (len(w) < 200) + 2 * (100 * len(set(w)) < 50 * len(w)) + 4 * (100 * caps > 2 * len(text)) + 8 * bool(re.search(r"[#$%&*|]", text))

    flags = []
    for i, text, part in rows:
        text = text or ""
        copy = any(j is not None and (i is None or j < i) for j, t, _ in rows if (t or "") == text)
        good, toxic = (any(x[k] == 1 for x in labels if x[0] is not None and x[0] == i) for k in (1, 2))
        flags.append((part or "", mask(text) + 16 * copy, good, toxic))
    out = {}
    for part in {f[0] for f in flags}:
        mine = [f[1:] for f in flags if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            bits = [1 << "ABCDE".index(x) for x in order]
            for s, bit in enumerate(bits):
                before = sum(bits[:s])
                gone = [x for x in mine if x[0] & bit and not x[0] & before]
                out[part, "".join(order), s + 1] = (
                    sum(not x[0] & (before | bit) for x in mine), len(gone), sum(bool(x[0] & bit and x[0] & before) for x in mine),
                    sum(x[0] == bit for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone),
                    sum(120 // bin(x[0]).count("1") for x in mine if x[0] & bit))
    return out


FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_of_files_in_any_order(spark, seed):
    rnd = random.Random(seed)
    texts = [None, "", "a", "Ab C$", "x " * 300, " ".join(map(str, range(250))), " ".join(map(str, range(250))) + " #", "plain words"]
    rows = [(rnd.choice([None, *range(30)]), rnd.choice(texts), rnd.choice([None, "", "p", "q"])) for _ in range(120)]
    rows += [(5, "a", "p")] * 3 + [(-7, "plain words", "q")] + [(None, "only without id", "p")] * 2
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 30, 2)] + [(4, 1, 1), (None, 1, 1)]
    path = shared_path(spark, "audit-docs")
    for k in range(7):  # larger ids first, so that smaller ones take back what was counted
        part = sorted(rows, key=lambda r: (r[0] is not None, -(r[0] or 0)))[k::7] if seed == 1 else rows[k::7]
        spark.createDataFrame(part, "doc_id bigint, text string, source string").withColumn("id", F.lit("x")).withColumn("MASK", F.lit("y")).coalesce(
            1).write.mode("append").parquet(path)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in FIGURES) for r in filter_audit.audit(spark, path, marks, batches=7).collect()}
    assert got == audited(rows, labels)


def test_audit_with_many_labels_is_spread(spark, monkeypatch):
    path = shared_path(spark, "audit-docs")
    rows = [(i % 40 if i % 3 else 7, f"text {i % 11}", "p") for i in range(200)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3).write.parquet(path)
    labels = [(i, 1, i % 2) for i in range(50)]
    monkeypatch.setattr(filter_audit, "BROADCAST_BYTES", 0)
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in FIGURES) for r in filter_audit.audit(
        spark, path, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert got == audited(rows, labels)


def test_audit_of_an_empty_table(spark):
    path = shared_path(spark, "audit-docs")
    spark.createDataFrame([], "doc_id bigint, text string, source string").write.parquet(path)
    assert filter_audit.audit(spark, path, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


# ---- ranked lexical search


def best(rows, items, k):
    """[(item, rank, doc, score)] by scoring every document for every item."""
    import math
    from collections import Counter

    docs = [(i, Counter(w), len(w)) for i, w in ((i, reference.words(t)) for i, t in rows) if w]
    n_docs, length = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in docs:
            m = 25 + 75 * n * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                    for t in reference.words(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("postings", [1, 40, 1 << 20])
@pytest.mark.parametrize("block", [1, 1 << 20])
def test_search_finds_the_best(spark, docs, postings, block):
    rnd = random.Random(3)
    vocabulary = [f"w{int(rnd.paretovariate(0.6)) % 400}" for _ in range(3000)]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(0, 60)))) for i in range(250)]
    rows += [(1000 - i, "same Text, again w1 w2 w3") for i in range(40)] + [(None, "same text w1"), (None, None), (3, "same text w1"), (3, "same text w1")]
    rows += [(2000, "long " * 20000), (2001, "Ünï w5 w5"), (2002, "!!! ,,,")]
    items = [(1, "same same text w1"), (2, " ".join(vocabulary[:40])), (2, "w5 Ünï"), (None, "long again"), (5, ""), (6, None), (7, "unknown"), (8, "w1")]
    queries = spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit("x"))
    if block == 1 and postings == 40:
        items = items[:3]
        queries = queries.limit(3)
    got = lexical_search.ranked(docs(rows).repartition(3), queries, k=10, shard_postings=postings, block_bytes=block).collect()
    assert sorted(map(tuple, got), key=str) == best(rows, [(i, t) for i, t in items if t], 10)


def test_search_in_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    one = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    for df, q in ((docs([]), one), (docs([(1, "a")]), none), (docs([(1, None)]), one)):
        got = lexical_search.ranked(df, q)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_scores_few_documents():
    """Whole lists are not walked: the bounds shut most documents out."""
    import numpy as np

    from brigade.llm.range_maxima import Best, Shard

    rnd = np.random.default_rng(1)
    n = 20_000
    lists = [np.sort(rnd.choice(n, size, replace=False)) for size in (15_000, 4000, 300, 40)]
    terms = np.repeat(np.arange(4), [len(x) for x in lists])
    impacts = np.concatenate([rnd.integers(1, top, len(x)) for x, top in zip(lists, (10, 100, 1000, 5000))])
    shard = Shard(np.arange(n), terms, np.concatenate(lists), impacts)
    found = Best(10)
    scored = shard.search(np.arange(4), np.array([1, 1, 1, 2]), found)
    total = np.zeros(n, np.int64)
    np.add.at(total, np.concatenate(lists), impacts * np.repeat([1, 1, 1, 2], [len(x) for x in lists]))
    order = np.lexsort((np.arange(n), -total))[:10]
    assert found.ids.tolist() == order.tolist() and found.scores.tolist() == total[order].tolist()
    assert scored < n // 20


# ---- licence scans


def weighed(text):
    """(labels, step) of an expression by recursive descent, another way than the parser's."""
    tokens = re.findall(r"[()]|[^\s()]+", text)

    def choice():
        found = both()
        while tokens and tokens[0] == "OR":
            tokens.pop(0)
            other = both()
            found = (found[0] | other[0], min(found[1], other[1]))
        return found

    def both():
        found = one()
        while tokens and tokens[0] == "AND":
            tokens.pop(0)
            other = one()
            found = (found[0] | other[0], max(found[1], other[1]))
        return found

    def one():
        token = tokens.pop(0)
        if token == "(":
            found = choice()
            tokens.pop(0)
            return found
        label = licences.family(token) or "other"
        step = licences.STEP[label]
        if tokens and tokens[0] == "WITH":
            del tokens[:2]
            step -= label in licences.COPYLEFT
        return {label}, step

    labels, step = choice()
    return tuple(sorted(labels)), step / licences.STEPS


def test_expressions_against_another_parser():
    rnd = random.Random(5)
    names = ["MIT", "Apache-2.0", "GPL-2.0-only", "AGPL-3.0-or-later", "LGPL-2.1+", "CC0-1.0", "CC-BY-SA-4.0", "Foo-1"]

    def made(depth):
        if depth == 0 or rnd.random() < 0.3:
            return rnd.choice(names) + (" WITH Classpath-exception-2.0" if rnd.random() < 0.2 else "")
        inner = f" {rnd.choice(['AND', 'OR'])} ".join(made(depth - 1) for _ in range(rnd.randrange(1, 4)))
        return f"({inner})" if rnd.random() < 0.5 else inner

    for _ in range(500):
        text = made(3)
        found = licences.parse(" " + text)
        assert found.text == text and (found.labels, found.weight) == weighed(text)


@pytest.mark.parametrize("line,text,labels,weight", [
    ("MIT", "MIT", ["mit"], 0.2), ("mit or Apache-2.0 */", "mit OR Apache-2.0", ["apache", "mit"], 0.2), ("MIT OR", "MIT", ["mit"], 0.2),
    ("(MIT OR GPL-3.0", "", ["unreadable"], 1.0), ("", "", ["unreadable"], 1.0), ("MIT and more to read", "MIT", ["mit"], 0.2),
    ("GPL-2.0 WITH a WITH b", "GPL-2.0 WITH a", ["gpl"], 0.4), ("(MIT) WITH a", "(MIT)", ["mit"], 0.2), ("Foo AND MIT", "Foo AND MIT", ["mit", "other"], 1.0),
    ("MIT) OR GPL-2.0", "MIT", ["mit"], 0.2), ("GPL-2.0-only OR MIT AND AGPL-3.0", "GPL-2.0-only OR MIT AND AGPL-3.0", ["agpl", "gpl", "mit"], 0.6),
])
def test_lines_behind_a_tag(line, text, labels, weight):
    _, _, found, _, _ = licences.Scanner().scan(f"// spdx-License-Identifier: {line}\nMIT License")
    assert found == [{"word": 0, "expression": text, "labels": labels, "weight": weight}]


def test_long_lines_take_linear_time():
    scanner = licences.Scanner()
    for line in ("(" * 300_000, "MIT OR (" * 100_000, "MIT AND " * 100_000):
        assert len(scanner.scan("SPDX-License-Identifier: " + line)[2]) == 1


def test_plain_license_fields():
    scan = licences.Scanner().scan
    assert scan("License: MIT")[3] == ["mit"] and scan("license: you get it here")[3] == [] and scan("the license of it: MIT")[3] == []
    assert scan("License-Expression: MIT OR Foo")[3] == ["mit", "other"] and scan("License: MIT or Foo")[3] == ["mit"]


def test_scan_of_rows(spark, docs):
    texts = [None, "", "CC-BY 4.0, cc by", "GNU Lesser General\nPublic License", "all rights re served. All Rights Reserved", "x " * 100_000 + "cc by",
             "accc by", "cc by" * 2, "SPDX-License-Identifier: (MIT OR GPL-2.0-only)", "CC by"]
    df = docs(enumerate([*texts, texts[2]])).withColumn("LABELS", F.lit("x"))
    got = {r["doc_id"]: r for r in licences.scan(df).collect()}
    assert len(got) == 11 and got[2]["labels"] == got[10]["labels"] == ["cc-by"] and got[0]["_q"] == "x"
    assert [(n["word"], n["label"], n["base"]) for n in got[3]["notices"]] == [(1, "lgpl", False), (2, "gpl", True)]
    assert [n["word"] for n in got[4]["notices"]] == [4] and got[5]["notices"][0]["word"] == 100_000
    assert got[6]["notices"] == got[7]["notices"] == [] and got[8]["labels"] == ["gpl", "mit"]
    assert [got[i]["n_words"] for i in (0, 1, 2)] == [0, 0, 6] and got[0]["score"] == 0.0 and got[4]["score"] == 1.0
    assert licences.scan(docs([])).count() == 0


BASE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT * FROM (VALUES (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')) x(phrase, label)),
found AS (
  SELECT doc_id, i - 1 AS at, label FROM (SELECT doc_id, w, phrase, label, unnest(range(1, len(w) + 1)) AS i FROM d, p)
  WHERE w[i:i + len(phrase) - 1] = phrase)
SELECT doc_id, any_value(len(w)) AS n_words, count(at) AS n_base, min(at) AS first_word, max(at) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM d LEFT JOIN found USING (doc_id) GROUP BY doc_id
"""


def test_base_columns_of_whole_tables(spark):
    got = llm.QUERIES["op13_license_scans"](spark, SF)
    assert oracle.compare(got.drop("labels", "score"), oracle.connect(SF), BASE_SQL) is None
    assert got.where("array_size(array_except(split(base_labels, ','), split(labels, ','))) > 0 AND base_labels != ''").count() == 0
    assert got.where("score < 0 OR score > 1 OR (n_base > 0 AND score = 0)").count() == 0
