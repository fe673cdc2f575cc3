"""Named queries over the sample tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brigade.plans.views import PRELUDE, Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the views of the prelude."""
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = PRELUDE + sql.strip()
        return fn

    return keep


def tidy(df: DataFrame) -> DataFrame:
    """Plain column types, so that rows compare across engines: text, bigint, double, boolean."""
    def plain(f: T.StructField):
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        return c.alias(f.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def runnable(name: str) -> Callable:
    def run(spark, sf_dir: str) -> DataFrame:
        return tidy(QUERIES[name](Tables.of(spark, sf_dir)))

    run.__name__ = name
    return run
