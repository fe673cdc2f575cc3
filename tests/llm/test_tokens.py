"""Byte-level BPE and token counts against the public libraries."""

import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import numpy as np
import pyarrow as pa
from brigade.llm import arrow_text, byte_bpe, pretokens, token_counts
from brigade.llm import queries as llm

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPEC = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", " ", "1", "²", "é", "ß", "漢", "😀", "!", "_", "'s", "\x1c", "\x85", "<|endoftext|>", "A", "'LL"]


def random_texts(n=3000):
    rng = random.Random(5)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(n)] + [
        "", "a" * 3000, " " * 2000, "'" * 500, "ab" * 1500, "word " * 3000]


@pytest.fixture(scope="module")
def library():
    codec = byte_bpe.Codec(byte_bpe.read_ranks(RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_boundaries_match_the_pattern():
    pattern, texts = regex.compile(public_tokenizers.PATTERN), random_texts()
    for row, end, data, at in arrow_text.pieces(pa.array(texts), 1 << 12):
        found, first = pretokens.slices(data, at)
        for k in range(end - row):
            assert found[first[k] : first[k + 1]] == [m.encode() for m in pattern.findall(texts[row + k])]


def test_every_code_point_has_the_class_of_the_pattern(library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assigned = [c for c in points if __import__("unicodedata").category(c) != "Cn"]
    kinds = pretokens.code_classes()[[ord(c) for c in assigned]]
    for name, kind in ((r"\p{L}", [pretokens.LETTER]), (r"\p{N}", [pretokens.DIGIT]), (r"\s", [pretokens.BLANK, pretokens.SPACE])):
        want = np.zeros(len(assigned), bool)
        want[[m.start() for m in regex.finditer(name, "".join(assigned))]] = True
        assert (np.isin(kinds, kind) == want).all()


def test_encode_and_decode(spark, docs, library):
    texts = random_texts()
    df = docs([*enumerate(texts), (90000, None), (90000, None), (None, "null id")])
    got = byte_bpe.encode(df, byte_bpe.read_ranks(RANKS), outputs=list(byte_bpe.OUTPUTS))
    assert set(df.columns) <= set(got.columns)
    for r in got.collect():
        ids = library.encode_ordinary(r["text"] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == (r["text"] or "").encode()
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert library.decode(ids).encode() == bytes(r["decoded"])
        assert len(r["offsets"]) == len(regex.findall(public_tokenizers.PATTERN, r["text"] or ""))
    assert got.limit(0).count() == 0


def test_counts(spark, docs):
    texts, counter = random_texts(), Tokenizer.from_file(SPEC)
    df = docs([*enumerate(texts), (90000, None)])
    want = [len(e.ids) for e in counter.encode_batch(texts, add_special_tokens=False)] + [0]
    got = token_counts.count_tokens(df, token_counts.read_tokenizer(SPEC)).select("doc_id", "n_tokens").orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == want


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 5)
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 5)
    texts, whole = random_texts(300), Tokenizer.from_file(SPEC)
    codec, counter = byte_bpe.Codec(byte_bpe.read_ranks(RANKS)), token_counts.Counter(byte_bpe.read_ranks(SPEC))
    for _, _, data, at in arrow_text.pieces(pa.array(texts), 1 << 8):
        byte_bpe._encode_piece(codec, data, at, ["ids"])
    got = np.concatenate([counter.count_texts(data, at) for _, _, data, at in arrow_text.pieces(pa.array(texts), 1 << 8)])
    assert got.tolist() == [len(e.ids) for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_queries_over_whole_tables(spark, library):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in llm.QUERIES["op9_byte_bpe"](spark, SF).collect():
        ids = library.encode_ordinary(rows[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest()
    whole = Tokenizer.from_file(SPEC)
    got = llm.QUERIES["op8_token_counts"](spark, SF)
    assert got.where(F.col("over_limit") != (F.col("n_tokens") > 512)).count() == 0
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == {
        i: len(whole.encode(t, add_special_tokens=False).ids) for i, t in rows.items()}
