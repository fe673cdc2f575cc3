"""Cleaning of raw text columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted date forms in order of precedence, free forms tried after them, the first two-digit year
# that means the last century, and words that mean true.
DATE_FORMS = ("yyyy-MM-dd", "d/M/yyyy", "M/d/yyyy")
FREE_FORMS = ("yyyy/M/d", "M-d-yyyy", "d-M-yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "d MMMM yyyy", "d MMM yyyy")
FIRST_OLD_YEAR = 69
SHORT_DATE_FORMS = ("M/d/yy",)
TIME_FORM = "HH:mm:ss"
TRUE_WORDS = ("TRUE", "1", "YES")


def header_name(raw: str) -> str:
    return re.sub(r" ", "_", raw.strip().lower())


def normal_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[header_name(c) for c in df.columns])


def first_present(df: DataFrame, synonyms: Mapping[str, Sequence[str]]) -> DataFrame:
    """Give each target name the first of its synonyms that the frame has."""
    for target, names in synonyms.items():
        found = next((n for n in names if n in df.columns), None)
        if found is not None and found != target:
            df = df.withColumn(target, F.col(found))
    return df


def aliased(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Pick and rename columns; those the frame lacks become null text."""
    return df.select(
        *[
            (F.col(f"`{raw}`") if raw in df.columns else F.lit(None).cast("string")).alias(to)
            for raw, to in names.items()
        ]
    )


def parse_date(c: Column | str, forms: Sequence[str] = DATE_FORMS) -> Column:
    """First form that fits; day before month when both fit; null when none does.

    Whatever no form takes is tried as free-form date text last.
    """
    c = F.trim(F.col(c) if isinstance(c, str) else c)

    def read(form: str) -> Column:
        day = F.try_to_date(c, form)
        if not re.search(r"(?<!y)yy(?!y)", form):
            return day
        return F.when(F.year(day) % 100 >= FIRST_OLD_YEAR, F.add_months(day, -1200)).otherwise(day)

    return F.coalesce(*[read(f) for f in forms], *[read(f) for f in FREE_FORMS], c.try_cast("date"))


def parse_hour(c: Column | str, form: str = TIME_FORM) -> Column:
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    padded = F.when(c.rlike(r"^\d:"), F.concat(F.lit("0"), c)).otherwise(c)
    return F.hour(F.try_to_timestamp(padded, F.lit(form)))


def parse_bool(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.upper(F.trim(c)).isin(*TRUE_WORDS), F.lit(False))


def text_or(c: Column | str, default: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(c), F.lit(default))


def position_or_role(position: Column | str, role: Column | str, default: str = "Unknown") -> Column:
    return F.coalesce(
        F.col(position) if isinstance(position, str) else position,
        F.col(role) if isinstance(role, str) else role,
        F.lit(default),
    )
