"""Registry of runnable queries: name -> (Spark query over the given tables, oracle SQL or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_MODULES = ("mentions", "rollups", "series", "texts", "engagement", "ranking", "grouping", "market", "joins",
            "windows", "storage", "diagnostics", "streams", "remaining", "support", "profiles", "links", "roots", "fragments", "model_outputs")


def portable(df: DataFrame) -> DataFrame:
    """Values that compare the same in any engine: time text to the microsecond, six-digit doubles, joined arrays."""
    out = []
    for field in df.schema.fields:
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.DateType):
            col = col.cast("string")
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            col = F.round(col.cast("double") + F.lit(1e-9), 6) + F.lit(0.0)  # nudge keeps summation-order ties stable
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("long")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            col = F.concat_ws("|", col)
        elif isinstance(kind, T.ArrayType):
            col = F.concat_ws("|", F.transform(col, lambda x: x.cast("string")))
        out.append(col.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: portable(fn(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    for module in _MODULES:
        importlib.import_module(f"tidegauge.catalog.{module}")
