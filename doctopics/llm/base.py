"""Registry of the queries of this subpackage and helpers shared by its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctopics.runtime import materialise, shared_root

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pack_rest(df: DataFrame, *apart: str) -> DataFrame:
    """The columns ``apart`` and all others as one struct ``_rest``, so that their names cannot clash."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in apart]
    return df.select(*apart, (F.struct(*rest) if rest else F.struct(F.lit(0).alias("_none"))).alias("_rest"))


def unpack_rest(df: DataFrame, *made: str) -> DataFrame:
    """Undo ``pack_rest``; an input column named like one in ``made`` gives way."""
    names = [c for c in df.schema["_rest"].dataType.fieldNames() if c != "_none" and c not in made]
    return df.select(*[c for c in df.columns if c != "_rest"], *[F.col("_rest")[c].alias(c) for c in names])


__all__ = ["ORACLES", "QUERIES", "let", "materialise", "pack_rest", "register", "shared_root", "table", "unpack_rest"]
