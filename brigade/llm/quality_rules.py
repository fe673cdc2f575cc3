"""Line-first cleaning with column expressions only.

Every line with a word meets three rules; lines that fail one go, and a document goes when that takes too much
of its words, or when it fails the base rule (too few words, or too many words inside repeated five-word windows).

* punctuation: three or more marks, and more than one mark in ten characters of ink; only a run of one mark behind a word
  that begins with none counts ("so!! what$$$"), or any mark on a line without letters and digits, so operators, braces and
  names of source code, headings and emphasis do not
* navigation: two or more separators, and one for every four words at least
* boilerplate: a short line of which set phrases (licences, cookies, sign-up and the like) make up half the words or more;
  a phrase is met as whole words, and a copyright or licence notice ends with the names behind it, so a sentence that mentions
  one, or goes on as prose behind one, stays

Null and empty texts have no words and are rejected; their clean text is null or empty. Repeated rows get the same
verdict each. All columns of the input are kept; an added column replaces one of the same name. Windows are compared
by a 64-bit hash within their own document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brigade.llm.joins import fresh

# Fixed values of the base rule.
WHITE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
# The line rules.
MARKS = "#*$%&|<>~^!"
# A word with a run of one mark behind it.
MARKED = rf"((?:^|[{WHITE}])[^{WHITE}{MARKS}](?:[^{WHITE}]*[^{WHITE}{MARKS}])?)([{MARKS}])\2+(?=[{WHITE}]|$)"
WORDLIKE = r"[\p{L}\p{N}]+"
SEPARATORS = "|»›•·"
_LICENCE = r"(?:licen[cs]e|cc|gnu|a?gpl|lgpl|mit|bsd|apache|mozilla|creative commons)"
# What follows a year or a licence as long as it looks like a name: words in capitals, numbers, a few small words between them.
_NAMES = r"(?:[ ,.-]+(?:(?-i:[\p{Lu}\d(])[^ ]*|of|and|by|for|&|inc\.?|licen[cs]e|version|public|general|international))*"
# A phrase takes its own words, a notice also the names behind it, the text of a grant or a disclaimer the rest of the line.
BOILERPLATE = (
    r"(?i)\b(?:"
    rf"(?:(?:this|the) \w+ is )?(?:dual[- ])?licensed under (?:[^.]*[ -])?{_LICENCE}\b{_NAMES}"
    r"|permission is hereby granted,? free of charge.*|spdx-license-identifier:.*"
    r"|(?:the software is |is )?(?:provided|distributed) \W*as is\W+without warranty.*|without warranty of any kind.*"
    r"|lorem ipsum(?: dolor sit amet.*)?"
    r"|(?:all rights reserved|permission is hereby granted|without warranty|copyright notice"
    r"|privacy policy|terms of (?:use|service)|cookie (?:policy|notice|settings|preferences|consent)"
    r"|(?:(?:this|our) (?:web)?site|we) uses? cookies|(?:accept|allow|reject|manage)(?: all)? cookies"
    r"|subscribe(?: now| today| to our \w+)|(?:sign (?:in|up)|log in)(?: now| here| to your account)?"
    r"|click here|read more|share this(?: (?:post|page|article|story))?|(?:please )?enable javascript)\b)"
    rf"|(?:\bcopyright *(?:\(c\)|©)?|\(c\)|©) *(?:19|20)\d\d{_NAMES}|© *(?-i:\p{{Lu}})[^ ]*{_NAMES}"
    r"|^\W*(?:subscribe|copyright|cookies)\W*$"
)
# A word of each phrase: a line without any has none of them.
HINT = (
    "(?i)licensed under|permission|spdx|warranty|lorem|rights reserved|copyright|privacy|terms of|cookie|subscribe|sign in|sign up|log in|click here"
    r"|read more|share this|javascript|\(c\)|©"
)
BOILERPLATE_WORDS = 30
KEPT_PERCENT = 50
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ADDED = [*BASE, "kept_words", "n_failed_lines", "clean_text", "base_failed", "kept"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: an expression inside a lambda would run for every element."""
    return F.transform(F.array(value), use)[0]


def without(text: Column, characters: str) -> Column:
    return F.regexp_replace(text, f"[{characters}]", "")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{WHITE}]+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside windows that occur twice or more."""
    def covered(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ranked, lambda r: let(
            F.array_sort(F.transform(
                F.filter(
                    F.transform(r, lambda x, k: F.struct(
                        x["i"].alias("i"),
                        (F.get(r, k - 1)["h"].eqNullSafe(x["h"]) | F.get(r, k + 1)["h"].eqNullSafe(x["h"])).alias("twice"))),
                    lambda x: x["twice"]),
                lambda x: x["i"])),
            # a window adds what the next one does not start before
            lambda at: F.aggregate(
                F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))),
                F.lit(0), lambda a, n: a + n)))

    hashes = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))),
        lambda w, i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]),
    )
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def _line(line: Column) -> Column:
    """The line, its words, whether it has one, and whether it fails a rule."""
    n_words = F.regexp_count(line, F.lit(rf"[^{WHITE}]+"))
    ink = F.length(without(line, WHITE))
    # every costly pattern has a cheap one before it
    runs = F.when(line.rlike(rf"([{MARKS}])\1"), F.length(line) - F.length(F.regexp_replace(line, MARKED, "$1"))).otherwise(0)
    marks = F.when(line.rlike(WORDLIKE), runs).otherwise(ink - F.length(without(line, WHITE + MARKS)))
    bars = F.when(line.rlike(f"[{SEPARATORS}]"), F.length(line) - F.length(without(line, SEPARATORS))).otherwise(0)
    # words beside the phrases
    others = F.regexp_count(F.regexp_replace(line, BOILERPLATE, " "), F.lit(WORDLIKE))
    phrases = line.rlike(HINT) & line.rlike(BOILERPLATE) & (others * 2 <= F.regexp_count(line, F.lit(WORDLIKE)))
    return let(F.struct(n_words.alias("n"), marks.alias("marks"), bars.alias("bars")), lambda x: F.struct(
        line.alias("line"),
        x["n"].alias("n"),
        (
            (x["n"] > 0)
            & (
                ((x["marks"] >= 3) & (x["marks"] * 10 > ink))
                | ((x["bars"] >= 2) & (x["bars"] * 4 >= x["n"]))
                | ((x["n"] <= BOILERPLATE_WORDS) & phrases)
            )
        ).alias("fails"),
    ))


def clean(df: DataFrame, text: str = "text", kept_percent: int = KEPT_PERCENT) -> DataFrame:
    """The input with the base counts, the words kept, the failed lines, the clean text and the verdict."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def total(values: Column, of: Callable[[Column], Column]) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + of(x))

    def judged(words: Column, lines: Column) -> Column:
        inked = F.filter(lines, lambda x: x["n"] > 0)
        kept = F.filter(lines, lambda x: ~x["fails"])
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            total(words, F.length).alias("word_chars"),
            (F.length(whole) - F.length(without(whole, SYMBOLS))).cast("long").alias("n_symbols"),
            (F.size(inked) - F.size(F.array_distinct(F.transform(inked, lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            total(kept, lambda x: x["n"]).alias("kept_words"),
            (F.size(lines) - F.size(kept)).cast("long").alias("n_failed_lines"),
            F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("clean_text"),
        )

    found = let(words_of(whole), lambda w: let(F.transform(F.split(whole, "\n"), _line), lambda x: judged(w, x)))
    keep = [c for c in df.columns if c.lower() not in ADDED]
    name = fresh("_q", keep)
    q = F.col(name)
    base_failed = (q["n_words"] < MIN_WORDS) | (q["n_repeat_words"] * 100 > q["n_words"] * MAX_REPEAT_PERCENT)
    return df.select(*[F.col(f"`{c}`") for c in keep], found.alias(name)).select(
        *[F.col(f"`{c}`") for c in keep],
        *[q[c].alias(c) for c in [*BASE, "kept_words", "n_failed_lines"]],
        F.when(F.col(f"`{text}`").isNotNull(), q["clean_text"]).alias("clean_text"),
        base_failed.alias("base_failed"),
        (~base_failed & (q["kept_words"] * 100 >= q["n_words"] * kept_percent)).alias("kept"),
    )
