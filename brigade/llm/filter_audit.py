"""What filters take, alone and after each other, kept up to date on a stream of files with retractions.

Five conditions by which a document fails (null text: empty; words: maximal runs without white space; case counts):

* A: under 200 words; B: distinct words under half of the words; C: over 2 % of the code points are A-Z
* D: a character of ``#$%&*|``; E: the same text stands under a smaller id, whether that document is removed or not

A to D come from the text alone. E depends on the whole table, so a stream of files, read as micro-batches that end when all
files have been read, keeps state for every text: its smallest id and what was counted for the rows of that id. Each
document adds one to the counter of its part and mask (one bit for each condition it fails). When a smaller id of
a text arrives later, the rows that were counted as first are taken back and counted again with E. The counters are
sums of such changes and at the end do not depend on the order of files.

Rows are combined by text before they are shuffled, so a text in a third of all rows sends one row from each Arrow batch.
State lives in the session's state store under a bucket of the texts' SHA-256 (a cluster whose executors can't hold some hundred
bytes a text in memory sets the RocksDB provider); the number of buckets follows the table (BUCKET_TEXTS rows each) and must
stay the same for a checkpoint that goes on. A micro-batch writes its sums to a folder of its
own number, which a repeated batch overwrites.

Rows: a null id counts as larger than all others; rows of the same id and text are copies of each other, not of a smaller id. A
null part is the empty string. A document is good or toxic if any label of its id says so; rows without a label are neither.
Repeated rows count each. Columns beyond id, text and part are not read. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from brigade.llm.joins import BROADCAST_BYTES
from brigade.operators.spread import attach
from brigade.session import shared_path

FILTERS = "ABCDE"
COPY = 16  # the bit of E
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 200, 50, 2
BATCHES = 4
BUCKET_TEXTS = 64
_COUNTED = "part string, mask int, label int, change bigint"


def mask(text: Column) -> Column:
    """The bits of A to D."""
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def bits(w: Column) -> Column:
        capitals = F.length(whole) - F.length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
        tests = [
            F.size(w) < MIN_WORDS, F.size(F.array_distinct(w)) * 100 < F.size(w) * DISTINCT_PERCENT,
            capitals * 100 > F.length(whole) * CAPITALS_PERCENT, whole.rlike("[#$%&*|]"),
        ]
        return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))

    return F.transform(F.array(words), bits)[0]  # the words are found once


def marked(docs: DataFrame, labels: DataFrame, weights: DataFrame, buckets: int, key: str, text: str, part: str) -> DataFrame:
    """bucket, text's digest, id, part, mask and label (1: good, 2: toxic, 3: both) of each row."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        mask(F.col(f"`{text}`")).alias("mask"), digest.alias("digest"))
    bits = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        (F.max(F.when(F.col("quality") == 1, 1).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, 2).otherwise(0))).alias("label"))
    known = bits.where("label > 0").join(weights, "id")  # an id of the table and how many rows it has
    return attach(rows, known, ["id"], weight="n", spread_by=["digest"], broadcast_bytes=BROADCAST_BYTES).select(
        F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket"), "digest", "id", "part", "mask",
        F.coalesce("label", F.lit(0)).alias("label"))


_COMBINED = ("bucket bigint, digest binary, no_id boolean, id bigint, mask int, parts array<string>, labels array<int>, "
             "firsts array<bigint>, laters array<bigint>")
_COLUMNS = [c.split()[0] for c in _COMBINED.split(", ")]


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text of an Arrow batch: its smallest id, and the rows of that id and of larger ones by part and label."""
    types = [pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.string()), *[pa.list_(t) for t in (pa.int32(), pa.int64(), pa.int64())]]
    for batch in batches:
        texts: dict[bytes, tuple] = {}
        for bucket, digest, i, part, mask, label in zip(*[c.to_pylist() for c in batch.columns]):
            here = (i is None, i or 0)  # without an id behind all others
            if digest not in texts:
                texts[digest] = (bucket, here, mask, Counter({(part, label): 1}), Counter())
                continue
            _, low, _, firsts, laters = texts[digest]
            if here < low:
                texts[digest] = (bucket, here, mask, Counter({(part, label): 1}), laters + firsts)
            else:
                (firsts if here == low else laters)[part, label] += 1
        rows = []
        for digest, (bucket, low, mask, firsts, laters) in texts.items():
            kinds = list(firsts | laters)
            rows.append((bucket, digest, *low, mask, [p for p, _ in kinds], [x for _, x in kinds], [firsts[k] for k in kinds], [laters[k] for k in kinds]))
        columns = list(zip(*rows)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_COLUMNS)


_HELD = ("digests array<binary>, nulls array<boolean>, ids array<bigint>, masks array<int>, parts array<string>, labels array<int>, "
         "counts array<bigint>")  # parallel lists, an entry for each text, part and label


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Smallest id of each text of a bucket, with the rows counted under it; gives the changes of the counters."""
    texts: dict[bytes, tuple[tuple[bool, int], int, Counter]] = {}
    for digest, null, i, mask, part, label, n in zip(*(state.get if state.exists else ())):
        texts.setdefault(bytes(digest), ((null, i), mask, Counter()))[2][part, label] += n
    changes: Counter = Counter()

    def count(mask: int, kinds: Counter, sign: int = 1) -> None:
        for (part, label), n in kinds.items():
            changes[part, mask, label] += sign * n

    for frame in frames:
        for digest, null, i, mask, *kinds in zip(*[frame[c].tolist() for c in _COLUMNS[1:]]):
            firsts, laters = Counter(), Counter()
            for part, label, first, later in zip(*kinds):
                firsts[part, int(label)] += int(first)
                laters[part, int(label)] += int(later)
            count(mask | COPY, laters)
            here, old = (null, i), texts.get(digest)
            if old is None or here < old[0]:
                if old is not None:  # they were counted as first and are not
                    count(old[1], old[2], -1)
                    count(old[1] | COPY, old[2])
                texts[digest] = (here, mask, firsts)
                count(mask, firsts)
            elif here == old[0]:
                old[2].update(firsts)
                count(mask, firsts)
            else:
                count(mask | COPY, firsts)
    entries = [(d, *at, m, p, x, n) for d, (at, m, kinds) in texts.items() for (p, x), n in kinds.items() if n]
    state.update(tuple(list(c) for c in zip(*entries)))
    made = [(part, mask, label, n) for (part, mask, label), n in changes.items() if n]
    if made:
        yield pd.DataFrame(made, columns=["part", "mask", "label", "change"])


def count_stream(
    docs: DataFrame, labels: DataFrame, weights: DataFrame, counters: str, checkpoint: str, buckets: int,
    key: str = "doc_id", text: str = "text", part: str = "source",
) -> None:
    """Run a stream of documents to its end; the changes of each micro-batch are summed into a folder of ``counters``."""
    spark = docs.sparkSession
    combined = marked(docs, labels, weights, buckets, key, text, part).mapInArrow(_combine, _COMBINED)
    changes = combined.groupBy("bucket").applyInPandasWithState(_update, _COUNTED, _HELD, "update", "NoTimeout")

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("part", "mask", "label").agg(F.sum("change").alias("change"))
        sums.write.mode("overwrite").parquet(f"{counters}/batch={number}")

    changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def _paths(filters: str) -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, bits of those before) of all orders."""
    out = []
    for order in itertools.permutations(range(len(filters))):
        done = 0
        for step, f in enumerate(order):
            out.append(("".join(filters[i] for i in order), step + 1, 1 << f, done))
            done |= 1 << f
    return out


def report(counters: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order and step, from the counters' changes (part, mask, label, change)."""
    paths = _paths(filters)
    pairs = sorted({(bit, done) for _, _, bit, done in paths})
    orders = math.factorial(len(filters))
    now = counters.groupBy("part", "mask", "label").agg(F.sum("change").alias("n")).where("n != 0")
    # at most masks x labels entries for each part
    held = now.groupBy("part").agg(F.collect_list(F.struct("mask", "label", "n")).alias("held"))

    def total(test) -> Column:
        return F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + F.when(test(x), x["n"]).otherwise(0))

    def of(pair: Column) -> Column:
        bit, done = pair["bit"], pair["done"]

        def fails(x, bits):
            return x["mask"].bitwiseAND(bits) != 0

        def removed(x):
            return fails(x, bit) & ~fails(x, done)

        shares = F.aggregate(
            "held", F.lit(0).cast("long"),
            lambda a, x: a + F.when(fails(x, bit), x["n"] * F.lit(orders) / F.greatest(F.bit_count(x["mask"]), F.lit(1))).otherwise(0).cast("long"))
        return F.struct(
            total(lambda x: ~fails(x, bit.bitwiseOR(done))).alias("kept"), total(removed).alias("removed"),
            total(lambda x: fails(x, bit) & fails(x, done)).alias("redundant"), total(lambda x: x["mask"] == bit).alias("unique_fails"),
            total(lambda x: removed(x) & (x["label"].bitwiseAND(F.lit(1)) != 0)).alias("good_lost"),
            total(lambda x: removed(x) & (x["label"].bitwiseAND(F.lit(2)) != 0)).alias("toxic_lost"), shares.alias("shapley"))

    def fixed(rows, fields: str) -> Column:
        return F.from_json(F.lit("[" + ",".join(rows) + "]"), f"array<struct<{fields}>>")

    steps = fixed([f'{{"o":"{o}","s":{s},"p":{pairs.index((b, d))}}}' for o, s, b, d in paths], "o: string, s: int, p: int")
    figures = F.transform(fixed([f'{{"bit":{b},"done":{d}}}' for b, d in pairs], "bit: int, done: int"), of)
    rows = held.select("part", figures.alias("figures")).select("part", "figures", F.explode(steps).alias("at"))
    figure = F.get("figures", F.col("at.p"))
    return rows.select("part", F.col("at.o").alias("filter_order"), F.col("at.s").alias("step"), figure.alias("f")).select(
        "part", "filter_order", "step", "f.*")


def audit(
    spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES, key: str = "doc_id", text: str = "text", part: str = "source",
) -> DataFrame:
    """The report over all files of a parquet table, read in about so many micro-batches."""
    table = spark.read.parquet(path)
    weights = table.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    buckets = max(1, table.count() // BUCKET_TEXTS)
    files = max(1, math.ceil(len(table.inputFiles()) / batches))
    path = path.rstrip("/")
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream wants a folder or a pattern; this one also names a single file
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(pattern)
    counters = shared_path(spark, "audit")
    spark.createDataFrame([], _COUNTED).write.parquet(f"{counters}/batch=-1")  # a table without files has no batch
    count_stream(stream, labels, weights, counters, shared_path(spark, "audit-state"), buckets, key, text, part)
    return report(spark.read.schema(_COUNTED).parquet(counters))
