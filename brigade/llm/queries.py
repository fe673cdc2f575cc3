"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brigade.llm import (
    byte_bpe, chat, decontaminate, filter_audit, language_id, lexical_search, licences, near_dedup, quality_rules, quality_score,
    sampling, sharding, suffix_dedup, token_counts,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenizer = token_counts.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.count_tokens(docs, tokenizer).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 512).alias("over_limit"),
    )


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    wanted = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return byte_bpe.encode(docs, ranks, outputs=wanted).select("doc_id", *wanted)


@query("op2_chat_formatting", """
WITH rows AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM rows),
prefixes AS (
  SELECT conv_id, pos, n_turns,
         md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY pos)) AS h
  FROM turns),
kept AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies FROM prefixes
  WHERE pos = n_turns AND (n_turns, h) NOT IN (SELECT (pos, h) FROM prefixes WHERE pos < n_turns)
  GROUP BY n_turns, h)
SELECT t.conv_id, (t.pos - 1) // 1000 AS page, k.n_turns, k.n_copies,
       string_agg('<|' || t.role || '|>' || chr(10) || t.text || chr(10), '' ORDER BY t.pos) AS rendered
FROM turns t JOIN kept k ON t.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY ALL
""")
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


WORD = r"[^\x20\x09-\x0D]+"
OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, regexp_extract_all(text, '{WORD}') AS words FROM d),
grams AS (
  SELECT row, i, words[i:i + 4] AS gram FROM (SELECT row, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, gram) AS n FROM grams) WHERE n > 1),
covered AS (SELECT row, count(DISTINCT i + j) AS n FROM (SELECT row, i, unnest(range(5)) AS j FROM twice) GROUP BY row),
lines AS (
  SELECT row, line, regexp_extract_all(line, '{WORD}') AS w, regexp_matches(line, '[\p{{L}}\p{{N}}]') AS wordlike,
         length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS ink,
         length(regexp_replace(line, '[\x20\x09-\x0D{quality_rules.MARKS}]', '', 'g')) AS unmarked,
         length(line) - length(regexp_replace(line, '[{quality_rules.SEPARATORS}]', '', 'g')) AS bars
  FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d)),
marked AS (
  SELECT *, len(w) AS n, CASE WHEN wordlike THEN list_sum([0] || list_transform(w, lambda x: CASE
           WHEN regexp_matches(x, '^[^{quality_rules.MARKS}]') AND length(regexp_extract(x, '[{quality_rules.MARKS}]+$')) >= 2
            AND regexp_extract(x, '[{quality_rules.MARKS}]+$') = repeat(right(x, 1), length(regexp_extract(x, '[{quality_rules.MARKS}]+$')))
           THEN length(regexp_extract(x, '[{quality_rules.MARKS}]+$')) ELSE 0 END)) ELSE ink - unmarked END AS marks,
         regexp_matches(line, '{quality_rules.BOILERPLATE}') AS said,
         len(regexp_extract_all(line, '[\p{{L}}\p{{N}}]+')) AS parts,
         len(regexp_extract_all(regexp_replace(line, '{quality_rules.BOILERPLATE}', ' ', 'g'), '[\p{{L}}\p{{N}}]+')) AS others
  FROM lines),
judged AS (
  SELECT row, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
         sum(n) FILTER (NOT (marks >= 3 AND marks * 10 > ink OR bars >= 2 AND bars * 4 >= n OR n <= 30 AND said AND others * 2 <= parts)) AS kept_words
  FROM marked GROUP BY row),
base AS (
  SELECT d.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(kept_words, 0) AS kept_words
  FROM d JOIN w USING (row) JOIN judged USING (row) LEFT JOIN covered c USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND kept_words * 100 >= n_words * 50 AS kept
FROM base
"""


@query("op6_quality_rules", OP6_SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.clean(docs).select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def sharding_sql(limit: int) -> str:
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(strlen(text), 0) AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
buckets AS (
  SELECT depth, h >> (60 - depth) AS prefix, sum(n_bytes)::BIGINT AS bytes, count(*) AS docs
  FROM d, range(61) r(depth) GROUP BY ALL),
placed AS (
  SELECT d.row, doc_id, n_bytes, h, b.* FROM d JOIN buckets b ON b.prefix = d.h >> (60 - b.depth)
  WHERE b.bytes <= {limit} OR b.docs = 1
  QUALIFY row_number() OVER (PARTITION BY d.row ORDER BY depth) = 1)
SELECT doc_id, n_bytes, CASE depth WHEN 0 THEN '' ELSE lpad(bin(prefix), depth::INT, '0') END AS shard,
       depth::BIGINT AS depth, docs AS shard_docs, bytes AS shard_bytes, bytes <= {limit} AS fits
FROM placed
"""


SHARD_BYTES = 256 << 10  # small enough that the sample's documents are split many times


@query("op7_sharding", sharding_sql(SHARD_BYTES))
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), limit=SHARD_BYTES)


@query("op10_minhash_near_dedup")
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n, words[i:i + least(len(words), 10) - 1] AS w
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, least(len(words), 1)) + 1)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT row, n, i, words[i:i + n - 1] AS w
  FROM (SELECT row, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, sizes)),
found AS (SELECT row, i, n, item_id FROM doc_windows JOIN item_windows USING (n, w)),
hit AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM found) GROUP BY row),
items AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM found) GROUP BY row)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN items USING (row)
"""


@query("op3_benchmark_decontamination", OP3_SQL)
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP1_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, hex(b) AS x, octet_length(b)::BIGINT AS n FROM d),
starts AS (SELECT doc_id, p, x[2 * p + 1:2 * p + 200] AS s FROM (SELECT *, unnest(range(0, n - 99)) AS p FROM h)),
later AS (
  SELECT doc_id, p FROM starts QUALIFY (doc_id, p) > min((doc_id, p)) OVER (PARTITION BY s)),
runs AS (
  SELECT doc_id, min(p) AS low, max(p) + 100 AS high
  FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run
        FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM later))
  GROUP BY doc_id, run),
cut AS (
  SELECT doc_id, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans,
         [0] || flatten(list([low, high] ORDER BY low)) AS edges
  FROM runs GROUP BY doc_id),
kept AS (
  SELECT h.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
         x, coalesce(edges, [0]) || [n] AS e
  FROM h LEFT JOIN cut USING (doc_id))
SELECT doc_id, n_bytes, n_removed, n_spans,
       sha256(unhex(list_aggregate(list_transform(range(1, len(e), 2), lambda i: x[2 * e[i] + 1:2 * e[i + 1]]), 'string_agg', ''))) AS kept_sha256
FROM kept
"""


@query("op1_suffix_array_dedup", OP1_SQL)
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = sampling.remainder(F.col("doc_id"), 3)
    model = language_id.fit(docs.select("doc_id", "text", "lang"), rest != 1)
    return language_id.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rest = sampling.remainder(F.col("doc_id"), 4)
    model = quality_score.fit(docs, table(spark, sf_dir, "labels"), rest != 2)
    return quality_score.score(docs, model).select(
        "doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
          'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
          'D': regexp_matches(text, '[#$%&*|]'),
          'E': coalesce(coalesce(doc_id, 9223372036854775807) > min(doc_id) OVER (PARTITION BY text), false)} AS bad
  FROM t LEFT JOIN l USING (doc_id)),
m AS (
  SELECT part, good, toxic, bad['A']::INT + 2 * bad['B']::INT + 4 * bad['C']::INT + 8 * bad['D']::INT + 16 * bad['E']::INT AS mask, count(*) AS n
  FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
         list_sum([0] || list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65)))::BIGINT AS done
  FROM orders, (SELECT unnest(range(1, 6)) AS step))
SELECT part, filter_order, step::INT AS step,
       sum(CASE WHEN mask & (bit | done) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
       sum(CASE WHEN mask & bit > 0 AND mask & done = 0 THEN n ELSE 0 END)::BIGINT AS removed,
       sum(CASE WHEN mask & bit > 0 AND mask & done > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
       sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
       sum(CASE WHEN mask & bit > 0 AND mask & done = 0 AND good = 1 THEN n ELSE 0 END)::BIGINT AS good_lost,
       sum(CASE WHEN mask & bit > 0 AND mask & done = 0 AND toxic = 1 THEN n ELSE 0 END)::BIGINT AS toxic_lost,
       sum(CASE WHEN mask & bit > 0 THEN n * 120 // bit_count(mask) ELSE 0 END)::BIGINT AS shapley
FROM steps, m GROUP BY ALL
"""


@query("op11_filter_interaction_audit", OP11_SQL)
def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
q AS (
  SELECT item, item_id, term, count(*) AS times
  FROM (SELECT row_number() OVER () AS item, item_id,
               unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
        FROM benchmark)
  GROUP BY ALL),
totals AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS length FROM d WHERE len(w) > 0),
postings AS (
  SELECT row, doc_id, n, term, count(*) AS tf
  FROM (SELECT row, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) SEMI JOIN q USING (term)
  GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals),
scores AS (
  SELECT item, item_id, row, doc_id,
         sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // length))))::BIGINT AS score
  FROM postings JOIN weights USING (term) JOIN q USING (term), totals
  GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


@query("op12_ranked_lexical_search", OP12_SQL)
def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_license_scans")
def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("notices", lambda x: x["base"])
    places = F.transform(base, lambda x: x["word"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda x: x["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")
