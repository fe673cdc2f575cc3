"""Licence scan: an Aho-Corasick automaton finds tags and notices, a shunting-yard parser evaluates licence expressions.

The automaton runs once over the words of a text (A-Z lower-cased, parted by everything that is no letter, digit or byte
beyond ASCII), so a phrase is found whatever marks, blanks or line breaks stand between its words, and only as whole words;
overlapping phrases are all found. A tag ("SPDX-License-Identifier", "License-Expression", "License") is followed to the
raw text behind it, where an expression of identifiers, AND, OR, WITH and parentheses is read up to the end of its line or
to where it stops being one.

An expression is turned into postfix order by precedence (WITH before AND before OR) and evaluated: its labels are those of
all its identifiers; its weight says how much it restricts reuse, from 0 (public domain) to 1 (all rights reserved). A
choice (OR) weighs what its lightest branch weighs, a sum (AND) what its heaviest does, an exception (WITH) takes one step
off a copyleft licence. An unknown identifier has the label ``other`` and weight 1 behind an SPDX tag; behind the plain
``License:`` only known identifiers count. A tag without a readable expression gives the label ``unreadable``, weight 1.

The score of a document is the weight of its heaviest finding, 0 without any. Null and empty texts have no words and no
findings. Repeated rows get the same result each; nothing is compared across rows. Texts of any length are scanned whole,
in time linear in their length. All columns of the input are kept; one of the same name as an added column, whatever its
case, is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brigade.llm.joins import fresh

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Further notices, by the words they are known by.
NOTICES = {
    "mit license": "mit", "permission is hereby granted free of charge": "mit",
    "apache license": "apache", "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc", "mozilla public license": "mpl", "eclipse public license": "epl",
    "lesser general public license": "lgpl", "affero general public license": "agpl", "gnu gpl": "gpl", "gnu lgpl": "lgpl", "gnu agpl": "agpl",
    "creative commons attribution": "cc-by", "creative commons zero": "cc0", "released into the public domain": "public-domain",
    "dedicated to the public domain": "public-domain", "unlicense": "unlicense",
}
TAGS = {"spdx license identifier": True, "license expression": True, "license": False}  # is an unknown identifier taken?
# Families by the way their identifiers begin, the longest one wins; steps of restriction from 0 to 5.
FAMILIES = {
    "mit": "mit", "apache": "apache", "bsd": "bsd", "0bsd": "bsd", "isc": "isc", "zlib": "zlib", "unlicense": "unlicense", "cc0": "cc0",
    "cc-by": "cc-by", "cc-by-sa": "cc-by-sa", "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd", "mpl": "mpl", "epl": "epl",
    "lgpl": "lgpl", "gpl": "gpl", "agpl": "agpl", "proprietary": "reserved", "licenseref": "other", "public-domain": "public-domain",
}
STEPS = 5
STEP = {
    "public-domain": 0, "cc0": 0, "unlicense": 0, "mit": 1, "apache": 1, "bsd": 1, "isc": 1, "zlib": 1, "cc-by": 1, "mpl": 2, "epl": 2,
    "lgpl": 2, "cc-by-sa": 3, "gpl": 3, "agpl": 4, "cc-by-nc": 4, "cc-by-nd": 4, "reserved": 5, "other": 5, "unreadable": 5,
}
COPYLEFT = {"gpl", "agpl", "lgpl"}
PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BEHIND = re.compile(r"[ \t]*:([^\r\n]*)")
TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9](?:[A-Za-z0-9.:-]*[A-Za-z0-9])?\+?)")

ADDED = {
    "n_words": "bigint", "notices": "array<struct<word: bigint, phrase: string, label: string, base: boolean>>",
    "expressions": "array<struct<word: bigint, expression: string, labels: array<string>, weight: double>>",
    "labels": "array<string>", "score": "double",
}


class Expression(NamedTuple):
    text: str  # canonical: single blanks, operators in capitals
    labels: tuple[str, ...]
    weight: float


def family(identifier: str) -> str | None:
    """The family an identifier belongs to: the longest known beginning that ends at a mark, a digit or its end."""
    low = identifier.lower().removesuffix("+")
    for n in range(len(low), 0, -1):
        if low[:n] in FAMILIES and (n == len(low) or not low[n].isalpha()):
            return FAMILIES[low[:n]]
    return None


def _operator(token: str, follows: str | None) -> str | None:
    """AND, OR and WITH in capitals; in small letters only before a known identifier or a parenthesis."""
    if token in PRECEDENCE:
        return token
    if token.upper() in PRECEDENCE and token.islower() and follows and (follows == "(" or family(follows) or token == "with"):
        return token.upper()
    return None


def tokens_of(line: str, known_only: bool = False) -> list[str]:
    """The tokens of the longest beginning of a line that is an expression, operators in capitals; none if there is none.

    WITH stands between two identifiers. With ``known_only`` the expression ends before an unknown licence.
    """
    found, at = [], 0
    while m := TOKEN.match(line, at):
        found.append(m[1])
        at = m.end()
    out: list[str] = []
    whole = depth = 0
    before = ""  # the kind of token before: an operator, "id", "with id", "(" or ")"
    for k, token in enumerate(found):
        if before in ("id", "with id", ")"):
            operator = _operator(token, found[k + 1] if k + 1 < len(found) else None)
            if operator and (operator != "WITH" or before == "id"):
                before = token = operator
            elif token == ")" and depth:
                before, depth = ")", depth - 1
            else:
                break
        elif token == "(" and before != "WITH":
            before, depth = "(", depth + 1
        elif token not in "()" and (before == "WITH" or not known_only or family(token)):
            before = "with id" if before == "WITH" else "id"
        else:
            break
        out.append(token)
        if not depth and before in ("id", "with id", ")"):
            whole = len(out)
    return out[:whole]


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order; None if the tokens are no expression."""
    out: list[str] = []
    held: list[str] = []
    operand = False
    for token in tokens:
        if token == "(":
            if operand:
                return None
            held.append(token)
        elif token == ")":
            if not operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif token in PRECEDENCE:
            if not operand:
                return None
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[token]:
                out.append(held.pop())
            held.append(token)
            operand = False
        else:
            if operand:
                return None
            out.append(token)
            operand = True
    if not operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(order: list[str]) -> tuple[tuple[str, ...], float]:
    """Labels and weight of an expression in postfix order."""
    stack: list[tuple[frozenset[str], int]] = []
    for token in order:
        if token not in PRECEDENCE:
            label = family(token) or "other"
            stack.append((frozenset([label]), STEP[label]))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if token == "WITH":  # the exception is no licence of its own
            stack.append((a, left - 1 if a & COPYLEFT else left))
        else:
            stack.append((a | b, (min if token == "OR" else max)(left, right)))
    labels, step = stack.pop()
    return tuple(sorted(labels)), step / STEPS


def parse(line: str, known_only: bool = False) -> Expression | None:
    """The longest expression at the beginning of a line."""
    tokens = tokens_of(line, known_only)
    order = postfix(tokens)
    return order and Expression(" ".join(tokens).replace("( ", "(").replace(" )", ")"), *evaluate(order))


def _automaton() -> ahocorasick.Automaton:
    """Phrases and tags between blanks: each word of a text is followed by one, and the text begins with one."""
    made = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, **TAGS}:
        made.add_word(f" {phrase} ", phrase)
    made.make_automaton()
    return made


class Scanner:
    def __init__(self) -> None:
        self.phrases = _automaton()

    def scan(self, text: str | None) -> tuple[int, list[dict], list[dict], list[str], float]:
        folded = (text or "").translate(FOLD)
        words = WORD.findall(folded)
        notices: list[dict] = []
        expressions: list[dict] = []
        starts: list[int] | None = None
        ends: list[int] | None = None
        line = f" {' '.join(words)} " if words else ""
        for last, phrase in self.phrases.iter(line):
            if starts is None:
                starts = list(accumulate((len(w) + 1 for w in words), initial=0))
            word = bisect_right(starts, last - len(phrase) - 1) - 1
            if phrase not in TAGS:
                notices.append({"word": word, "phrase": phrase, "label": BASE.get(phrase) or NOTICES[phrase], "base": phrase in BASE})
                continue
            if ends is None:
                ends = [m.end() for m in WORD.finditer(folded)]
            found = self._behind(text, ends[word + phrase.count(" ")], word, TAGS[phrase])
            if found:
                expressions.append(found)
        labels = {n["label"] for n in notices}.union(*[e["labels"] for e in expressions])
        weights = [STEP[n["label"]] / STEPS for n in notices] + [e["weight"] for e in expressions]
        return len(words), notices, expressions, sorted(labels), max(weights, default=0.0)

    @staticmethod
    def _behind(text: str, at: int, word: int, any_identifier: bool) -> dict | None:
        """The finding of a tag whose words end at a place of the text."""
        rest = BEHIND.match(text, at)
        if not rest:
            return None
        found = parse(rest[1], not any_identifier)
        if found is None:
            found = Expression("", ("unreadable",), 1.0) if any_identifier else None
        return found and {"word": word, "expression": found.text, "labels": list(found.labels), "weight": found.weight}


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """The input with n_words, the notices and expressions found with the word they begin at, all labels and the score."""
    keep = [c for c in df.columns if c.lower() not in ADDED]
    source = df.select(*[f"`{c}`" for c in keep], F.col(f"`{text}`").alias(fresh("_text", keep)))
    schema = T.StructType([*source.schema.fields[:-1], *T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in ADDED.items())).fields])
    notice = pa.list_(pa.struct([("word", pa.int64()), ("phrase", pa.string()), ("label", pa.string()), ("base", pa.bool_())]))
    expression = pa.list_(pa.struct([("word", pa.int64()), ("expression", pa.string()), ("labels", pa.list_(pa.string())), ("weight", pa.float64())]))
    types = [pa.int64(), notice, expression, pa.list_(pa.string()), pa.float64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            made = list(zip(*[scanner.scan(x.as_py()) for x in batch.columns[-1]])) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(v, t) for v, t in zip(made, types)]], names=[*keep, *ADDED])

    return source.mapInArrow(work, schema)
