"""Near duplicates by ProbMinHash, banding and verification.

Texts are compared by their five-word shingles, weighted by how often they occur; two are near when their probability
Jaccard similarity is 0.8 or more, and near texts are joined into classes.

1. Texts with the same word sequence share one node; nothing below is done per copy.
2. Forty bands of six registers: a pair at 0.8 misses every band with a probability of 5e-6.
3. In every bucket all members are compared with one centre, the member that meets most others over all bands.
4. Buckets whose members are not all in one class afterwards: members of the centre's class need not meet each other, and
   those far from the centre cannot be near to those near it (one minus the similarity is a metric). So the centre's class
   meets the few others in blocks of bounded size, by signature. Others that fill more than a block get a centre of their
   own, and again; what three centres leave is compared in pairs of blocks.
5. A pair that agrees in 165 or more of its 240 registers (expected at 0.8: 192) is verified on the shingles themselves.

Words are runs of Unicode letters and digits, ASCII lower-cased; in scripts without blanks (Chinese, kana, Thai and the
like) every character is a word. Quotes, dashes and blanks beyond ASCII part words like those of ASCII.

A text without a word is near to nothing. Repeated rows share a class like any copies; null ids are kept, the class is
named by the smallest id that is not null. Only the id and the text column are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brigade.llm import arrow_text, probminhash, words
from brigade.llm.components import components
from brigade.llm.joins import attach
from brigade.operators.spread import settle

SHINGLE_WORDS = 5
THRESHOLD = 0.8
# Registers that must agree before a pair is verified (at 0.8 fewer do with a probability of 1e-5), and below which members
# count as far from a centre (0.6).
AGREE, FAR = 165, 108
# Members of a bucket that one task compares with each other; larger buckets go in pairs of blocks.
BLOCK = 1024
# Centres that a bucket gets one after the other.
CENTRES = 3
# Texts in a piece; ids of texts share 64 bits with 48 of a shingle.
PIECE_TEXTS = 1 << 15


def _runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per piece: rows, word hashes with each text's first word, shingle hashes with their text."""
    for low in range(0, len(column), PIECE_TEXTS):
        for row, end, data, at in arrow_text.pieces(column.slice(low, PIECE_TEXTS)):
            _, _, hashes, first = words.find(data, at, unicode=True)
            runs, text = words.windows(hashes, first, SHINGLE_WORDS)
            yield low + row, low + end, hashes, first, runs, text


def _nodes(hashes: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """Digest of each text's word sequence; none for a text without words."""
    whole, at = hashes.tobytes(), (first * 8).tolist()
    return [hashlib.blake2b(whole[a:b], digest_size=16).digest() if b > a else None for a, b in zip(at, at[1:])]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, hashes, first, runs, text in _runs(batch.column(1)):
            winners = probminhash.signatures(runs, text, end - row)
            keys = probminhash.band_keys(winners)
            small = (winners & np.uint64(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(row, end - row),
                    pa.array(_nodes(hashes, first), pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel())),
                    pa.array([x.tobytes() for x in small], pa.binary()),
                ],
                names=["id", "node", "bands", "sig"],
            )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, hashes, first, runs, text in _runs(batch.column(1)):
            sets = probminhash.multisets(runs, text, end - row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_nodes(hashes, first), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())],
                names=["node", "shingles"],
            )


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Registers in which the two signatures of a row agree."""
    for batch in batches:
        a, b = (arrow_text.flat_utf8(batch.column(c))[0].reshape(-1, probminhash.REGISTERS) for c in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a == b).sum(1), pa.int32())], names=["a", "b", "agree"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = []
        for c in (2, 3):
            data, at = arrow_text.flat_utf8(batch.column(c))
            sides.append([data[x:y].view(np.uint64) for x, y in zip(at, at[1:])])
        values = [probminhash.probability_jaccard(x, y) for x, y in zip(*sides)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], names=["a", "b", "similarity"])


def _block_links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Verified links between classes, of two blocks of a bucket (or within one), as few as join what is near.

    A pair that shares several buckets is looked at in the first of them only.
    """
    def rows(name: str, kind: type) -> np.ndarray:
        return arrow_text.flat_utf8(table.column(name).combine_chunks())[0].view(kind)

    side, band_key = np.array(table.column("side")), key[0].as_py()
    sig = rows("sig", np.uint8).reshape(-1, probminhash.REGISTERS)
    bands = np.array(table.column("bands").combine_chunks().flatten()).reshape(len(sig), -1)
    node = table.column("node").to_pylist()
    data, at = arrow_text.flat_utf8(table.column("shingles").combine_chunks())
    _, label = np.unique(np.array(table.column("label").to_pylist(), object), return_inverse=True)
    shingles = [data[x:y].view(np.uint64) for x, y in zip(at, at[1:])]
    left = np.nonzero(side == 0)[0]
    right = left if key[1].as_py() == key[2].as_py() else np.nonzero(side == 1)[0]
    found: list[tuple[bytes, bytes, float]] = []
    for i in left:
        agree = (sig[right] == sig[i]).sum(1)
        shared = bands[right] == bands[i]
        here = bands[i][shared.argmax(1)] == band_key
        near = np.nonzero((agree >= AGREE) & here & (label[right] != label[i]))[0]
        for j in right[near[np.argsort(-agree[near], kind="stable")]]:
            if label[j] == label[i]:
                continue
            similarity = probminhash.probability_jaccard(shingles[i], shingles[j])
            if similarity >= THRESHOLD:
                found.append((min(node[i], node[j]), max(node[i], node[j]), similarity))
                label[label == label[j]] = label[i]
    a, b, values = zip(*found) if found else ((), (), ())
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "similarity": pa.array(values, pa.float64())})


def _with_both(pairs: DataFrame, what: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) with the column of both nodes; ``what`` has one row per node.

    Plain equal joins: a centre with very many pairs is split at run time (adaptive skew join).
    """
    for side in ("b", "a"):
        pairs = pairs.join(what.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs


def _shingles(nodes: DataFrame, signed: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, shingles) of the given nodes, from one text of each."""
    # as a struct a null id equals itself
    wanted = signed.select("node", F.struct("id").alias("_id")).join(nodes, "node", "left_semi").groupBy("node").agg(F.min("_id").alias("_id"))
    ids = wanted.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"))
    texts = attach(docs.withColumn("_id", F.struct("id")), ids, ["_id"], "inner", weight="_n").select("id", "text")
    return texts.mapInArrow(_features, "node binary, shingles binary").join(nodes, "node", "left_semi").dropDuplicates(["node"])


def node_labels(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """(node, label) of every node that is near to another one; the label is the smallest node of the class."""
    laid = signed.where("node IS NOT NULL").select("node", F.explode("bands").alias("key"))
    token = F.xxhash64("node")
    shared = laid.groupBy("key").agg(F.min(token).alias("lo"), F.max(token).alias("hi"), F.count(F.lit(1)).alias("_n")).where("lo < hi")
    members = settle(
        attach(laid, shared.select("key", "_n"), ["key"], "inner", weight="_n", spread_by=["node"]).select("key", "node").distinct(),
        "members",
    )
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    sized = attach(members, sizes, ["key"], "inner", weight="size", spread_by=["node"])
    meets = sized.groupBy("node").agg(F.sum("size").alias("meets"), F.count(F.lit(1)).alias("_n"))
    weighted = attach(sized, meets, ["node"], "inner", weight="_n", spread_by=["key"])
    centre = weighted.groupBy("key").agg(F.max(F.struct("meets", "node"))["node"].alias("centre"), F.count(F.lit(1)).alias("size"))
    starred = settle(
        attach(members, centre, ["key"], "inner", weight="size", spread_by=["node"]).select("key", "centre", "node"), "starred")
    sigs = settle(
        signed.where("node IS NOT NULL").select("node", "sig", "bands").join(members.select("node").distinct(), "node", "left_semi")
        .dropDuplicates(["node"]), "sigs")
    shingles = settle(_shingles(sigs.select("node"), signed, docs), "shingles")
    agreeing, links = _compared(starred, sigs, shingles)
    labels = settle(components(links), "labels")
    known = sigs.join(shingles, "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return _merged(labels, settle(_unsettled(starred, agreeing, links, sigs, shingles, known), "more_links"))


def _merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels after further links: components of the classes that these join, not of all nodes again."""
    edges = more.select("a", "b")
    for side in ("a", "b"):
        own = labels.select(F.col("node").alias(side), F.col("label").alias("_class"))
        edges = edges.join(own, side, "left").withColumn(side, F.coalesce("_class", side)).drop("_class")
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    classes_ = components(edges).select(F.col("node").alias("label"), F.col("label").alias("_to"))
    joined = settle(classes_.join(sizes, "label", "left"), "joined")
    moved = attach(labels, joined.where("_n IS NOT NULL"), ["label"], "left", weight="_n", spread_by=["node"])
    # nodes that had no class before
    alone = joined.where("_n IS NULL").select(F.col("label").alias("node"), F.col("_to").alias("label"))
    return moved.select("node", F.coalesce("_to", "label").alias("label")).unionByName(alone)


def _compared(starred: DataFrame, sigs: DataFrame, shingles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registers that members (centre, node) share with their centre, and the verified links among them."""
    spokes = starred.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    agreeing = settle(
        _with_both(spokes, sigs, "sig").select("a", "b", "sig_a", "sig_b").mapInArrow(_agreeing, "a binary, b binary, agree int"), "agreeing")
    both = _with_both(agreeing.where(F.col("agree") >= AGREE).select("a", "b"), shingles, "shingles")
    similar = both.select("a", "b", "shingles_a", "shingles_b").mapInArrow(_similar, "a binary, b binary, similarity double")
    return agreeing, settle(similar.where(F.col("similarity") >= THRESHOLD), "links")


def _unsettled(
    starred: DataFrame, agreeing: DataFrame, links: DataFrame, sigs: DataFrame, shingles: DataFrame, known: DataFrame
) -> DataFrame:
    """Links between different classes in a shared bucket, beside the pairs already compared."""
    uses = starred.groupBy("node").agg(F.count(F.lit(1)).alias("_n"))
    of_node = known.select("node", "label").join(uses, "node")
    placed = settle(attach(starred, of_node, ["node"], "inner", weight="_n", spread_by=["key"]).drop("_n"), "placed")
    token = F.xxhash64("label")
    home = F.max(F.when(F.col("node") == F.col("centre"), F.col("label")))
    mixed_keys = placed.groupBy("key").agg(
        F.min(token).alias("lo"), F.max(token).alias("hi"), F.count(F.lit(1)).alias("_n"), home.alias("home")).where("lo < hi")
    at_stake = attach(placed, mixed_keys.select("key", "home", "_n"), ["key"], "inner", weight="_n", spread_by=["node"]).drop("_n")
    laid, more = [], []
    for turn in range(1, CENTRES + 1):
        rows, left = _laid(_roles(at_stake, agreeing, links), turn, turn == CENTRES)
        laid.append(rows)
        if left is None or left.isEmpty():
            break
        # any member may be the next centre; the same one in all its buckets, so that most spokes are met once
        first = F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "label"))
        centre = left.groupBy("key").agg(first.alias("c"), F.count(F.lit(1)).alias("_n")).select(
            "key", F.col("c.node").alias("centre"), F.col("c.label").alias("home"), "_n")
        at_stake = settle(attach(left, centre, ["key"], "inner", weight="_n", spread_by=["node"]).drop("_n"), "at_stake")
        agreeing, links = _compared(at_stake, sigs, shingles)
        more.append(links)
    whole = reduce(DataFrame.unionByName, laid).join(known.select("node", "label", "sig", "bands", "shingles"), "node")
    found = whole.groupBy("key", "i", "j", "step").applyInArrow(_block_links, "a binary, b binary, similarity double")
    return reduce(DataFrame.unionByName, more, found)


def _roles(at_stake: DataFrame, agreeing: DataFrame, links: DataFrame) -> DataFrame:
    """What members (key, node, label) are to their centre: near, home (not near, but of its class), far, or ring (between).

    Wants key, centre, home (the centre's class), node and label.
    """
    told = agreeing.join(links.select("a", "b", F.lit(True).alias("near")), ["a", "b"], "left").select(
        F.col("a").alias("centre"), F.col("b").alias("node"), "agree", "near")
    role = F.when(F.col("near"), "near").when(F.col("label") == F.col("home"), "home").when(F.col("agree") < FAR, "far").otherwise("ring")
    return at_stake.where("node != centre").join(told, ["centre", "node"]).select("key", "node", "label", role.alias("role"))


def _laid(told: DataFrame, turn: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Blocks (key, i, j, step, side, node) to be compared, and the members (key, node, label) left for a further centre.

    Near and home are one class. Near ones meet the ring, home ones the ring and the far ones; a member is laid once for each
    block of the other side. Ring and far meet among themselves, unless they are more than a block and a centre is to come.
    """
    told = settle(told, "told")
    other = F.col("role").isin("ring", "far")
    counts = [F.count_if(F.col("role") == r).alias(r) for r in ("near", "home", "ring")]
    per_key = told.groupBy("key").agg(*counts, F.count_if(other).alias("other"), F.count(F.lit(1)).alias("_n"))
    per_key = per_key.where("other > 1 OR ring > 0 OR (other > 0 AND home > 0)")
    sized = settle(attach(told, per_key.withColumn("size", F.col("_n")), ["key"], "inner", weight="_n", spread_by=["node"]).drop("_n"), "sized")
    small, hashed = F.col("size") <= BLOCK, F.xxhash64("node")

    def blocks(n: str) -> Column:
        return F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1)).cast("int")

    def own(n: str) -> Column:
        return F.pmod(hashed, blocks(n)).cast("int")

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), blocks(n) - 1))

    def across(step: int, kin: Column, n_kin: str, rest: Column, n_rest: str) -> list[DataFrame]:
        both = sized.where(~small & (F.col(n_kin) > 0) & (F.col(n_rest) > 0))
        # blocks of the centre's class are numbered downwards, so that none equals one of the others
        a = both.where(rest).withColumn("i", own(n_rest)).withColumn("j", each(n_kin))
        b = both.where(kin).withColumn("i", each(n_rest)).withColumn("j", own(n_kin))
        return [x.select("key", "i", (-1 - F.col("j")).alias("j"), F.lit(step).alias("step"), F.lit(side).alias("side"), "node")
                for side, x in enumerate((a, b))]

    is_ = F.col("role")
    one = sized.where(small & ((is_ != "near") | (F.col("ring") > 0)))
    one = one.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(3 * turn).alias("step"), F.lit(0).alias("side"), "node")
    rows = [one, *across(3 * turn + 1, is_ == "near", "near", is_ == "ring", "ring"), *across(3 * turn + 2, is_ == "home", "home", other, "other")]
    rest = sized.where(~small & other & (F.col("other") > 1))
    now = rest if last else rest.where(F.col("other") <= BLOCK)
    # a member meets its own block and every other one, once
    paired = now.withColumn("_own", own("other")).withColumn("_other", each("other"))
    rows.append(paired.select(
        "key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), F.lit(3 * turn).alias("step"),
        F.when(F.col("_own") <= F.col("_other"), 0).otherwise(1).alias("side"), "node"))
    left = None if last else settle(rest.where(F.col("other") > BLOCK).select("key", "node", "label"), "left")
    return reduce(DataFrame.unionByName, rows), left


def classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the key, class_id (smallest key of its class) and class_docs."""
    docs = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    signed = settle(docs.mapInArrow(_sign, f"id {id_type}, node binary, bands array<bigint>, sig binary"), "signed")
    labels = settle(node_labels(docs, signed), "labels")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    named = settle(nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    whole = named.groupBy("label").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_docs"), F.count(F.lit(1)).alias("_n"))
    of_node = attach(named, whole, ["label"], "inner", weight="_n", spread_by=["node"]).select("node", "n", "class_id", "class_docs")
    joined = attach(signed.select("id", "node"), of_node, ["node"], "left", weight="n", spread_by=["id"])
    alone = F.col("node").isNull()
    return joined.select(
        F.col("id").alias(key),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_docs")).cast("long").alias("class_docs"),
    )
