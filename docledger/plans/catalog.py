"""The registered queries of the document-ledger operators, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docledger.plans import views

#: The day that date rules take for today.
AS_OF = "2026-06-01"

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, so that any reader compares alike."""
    def one(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double").alias(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return c.cast("string").alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("long").alias(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.array_join(c.cast("array<string>"), ",", "null").alias(f.name)
        return c

    return df.select(*[one(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None):
    """Registers a function of (view, spark): view(name) gives a derived or base table. sql: the same in DuckDB's SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            views.register(spark, sf_dir)
            return plain(f(spark.table, spark))

        _queries[name] = run
        if sql is not None:
            _oracles[name] = views.with_views(sql)
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["v28_validate"](spark, sf_dir)


def _load() -> None:
    from docledger.plans import queries_docs, queries_functions, queries_records, queries_relational, queries_rules  # noqa: F401


def queries() -> dict:
    _load()
    return dict(_queries)


def oracles() -> dict:
    _load()
    return dict(_oracles)
