"""Text chunks and exact vector top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brigade.operators.spread import attach, running, top_within

# Rows and characters per chunk, and the reduced length.
ROWS_PER_CHUNK = 20
CHARS_PER_CHUNK = 1000
REDUCED_LENGTH = 1024


def row_text(df: DataFrame, columns: Sequence[str], name: str = "text") -> DataFrame:
    """'column: value column: value ...' of each row; nulls are left out."""
    parts = [F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in columns]
    return df.withColumn(name, F.concat_ws(" ", *parts))


def row_chunks(
    df: DataFrame, file_keys: Sequence[str], order: str, text: str = "text", rows: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Rows of a file, in order, joined into chunks of ``rows`` lines; a huge file is numbered in slices."""
    numbered = running(df.select(*file_keys, order, text), file_keys, [F.col(order)], rank="_pos")
    chunk = F.floor((F.col("_pos") - 1) / rows).cast("long")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("_pos", text))), lambda x: x[text])
    return numbered.groupBy(*file_keys, chunk.alias("chunk_id")).agg(
        F.array_join(lines, "\n").alias("text"), F.count(F.lit(1)).alias("rows")
    )


def text_chunks(df: DataFrame, keys: Sequence[str], text: str, size: int = CHARS_PER_CHUNK) -> DataFrame:
    """The whole text in pieces of ``size`` characters, the last one shorter."""
    last = F.ceil(F.length(text) / F.lit(size)).cast("int") - 1
    whole = df.where(F.length(text) > 0)
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col(text), i * size + 1, F.lit(size)))
    return whole.select(*keys, F.posexplode(pieces).alias("chunk_id", "chunk"))


def doubles(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column | str) -> Column:
    """Vector of length one; null for the zero vector."""
    v = doubles(v)
    norm = F.sqrt(dot(v, v))
    # the norm rides along as a second array, so that it is computed once and not per element
    return F.when(norm > 0, F.zip_with(v, F.array_repeat(norm, F.size(v)), lambda x, n: x / n))


def similar_chunks(
    chunks: DataFrame, queries: DataFrame, scope: Sequence[str], k: int = 5,
    chunk_id: str = "chunk_id", query_id: str = "query_id", **spread,
) -> DataFrame:
    """The k most similar chunks per query by cosine similarity, within the query's scope.

    Exact: each chunk is scored against the queries of its own scope only. Chunks are joined with
    ``attach``, so a scope with a third of all chunks is spread over many tasks, and each task keeps
    only k rows per query before the final ranking.
    """
    q = queries.select(query_id, *scope, unit("embedding").alias("_q")).where(F.col("_q").isNotNull())
    weights = chunks.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n"))
    q = q.join(weights, list(scope))
    c = chunks.select(chunk_id, *scope, unit("embedding").alias("_c")).where(F.col("_c").isNotNull())
    scored = attach(c, q, scope, "inner", weight="_n", spread_by=[chunk_id], **spread).select(
        query_id, *scope, chunk_id, dot(F.col("_c"), F.col("_q")).alias("similarity")
    )
    return top_within(scored, [query_id, *scope], [F.col("similarity").desc(), F.col(chunk_id)], k)


def centroids(chunks: DataFrame, key: str) -> DataFrame:
    """Mean vector per key; one short list per key, as long as the vectors are."""
    cells = chunks.select(key, F.posexplode("embedding").alias("_i", "_x"))
    means = cells.groupBy(key, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return means.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"]).alias("embedding")
    )


def catalog(chunks: DataFrame) -> DataFrame:
    """Files with their number of chunks and last update."""
    return chunks.groupBy("owner_id", "category", "filename").agg(
        F.count_distinct("chunk_id").alias("chunks"), F.max("created_at").alias("last_update")
    )


def resolve_names(asked: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Asked names matched as written, else ignoring case."""
    exact = known.select(F.col(name), F.col(name).alias("_exact")).distinct()
    loose = known.groupBy(F.lower(name).alias("_low")).agg(F.min(name).alias("_loose"))
    return (
        asked.withColumn("_low", F.lower(name))
        .join(exact, name, "left")
        .join(loose, "_low", "left")
        .select(name, F.coalesce("_exact", "_loose").alias("resolved"))
    )


def not_embedded(files: DataFrame, chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    return files.join(chunks.select(*keys).distinct(), list(keys), "left_anti")


def already_embedded(files: DataFrame, chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    return files.join(chunks.select(*keys).distinct(), list(keys), "left_semi")


def with_reduced(df: DataFrame, vector: str, name: str, length: int = REDUCED_LENGTH) -> DataFrame:
    """Means of consecutive triples, cut or zero-padded to ``length``, scaled to length one."""
    v = F.col("_v")
    groups = F.floor(F.size(v) / 3).cast("int")
    means = F.when(
        groups > 0,
        F.transform(
            F.sequence(F.lit(0), groups - 1),
            lambda i: (F.get(v, i * 3) + F.get(v, i * 3 + 1) + F.get(v, i * 3 + 2)) / 3,
        ),
    ).otherwise(F.array().cast("array<double>"))
    padded = F.slice(F.concat(means, F.array_repeat(F.lit(0.0), length)), 1, length)
    return (
        df.withColumn("_v", doubles(vector))
        .withColumn("_p", padded)
        .withColumn(name, F.coalesce(unit("_p"), F.col("_p")))
        .drop("_v", "_p")
    )


def conversations_newest_first(history: DataFrame, conversation: str, turn: str) -> DataFrame:
    """Messages with their place in the conversation, newest first, and the conversation's last turn.

    One row per message, so a conversation of any length stays spread out.
    """
    placed = running(history, [conversation], [F.col(turn).desc()], rank="position")
    last = history.groupBy(conversation).agg(F.max(turn).alias("last_turn"), F.count(F.lit(1)).alias("messages"))
    return attach(placed, last, [conversation], "inner", weight="messages")
