"""Relational operators as thin functions over DataFrames; Catalyst picks how they run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Exprs = Sequence[Column | str]


def _col(x: Column | str) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def scan(df: DataFrame, columns: Exprs = ("*",), where: Column | str | None = None) -> DataFrame:
    """Columns of a table's rows that fulfil a predicate; both reach the Parquet reader."""
    return project(filtered(df, where) if where is not None else df, columns)


def project(df: DataFrame, columns: Exprs) -> DataFrame:
    return df.select(*[F.col("*") if isinstance(c, str) and c == "*" else _col(c) for c in columns])


def filtered(df: DataFrame, where: Column | str) -> DataFrame:
    return df.where(where)


def join(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """Join on a condition of any form or on shared columns; equality between expressions of either side is hashed or merged."""
    return left.join(right, F.expr(on) if isinstance(on, str) else on, how)


def aggregate(df: DataFrame, keys: Exprs, aggregates: Exprs, having: Column | str | None = None) -> DataFrame:
    out = df.groupBy(*[_col(k) for k in keys]).agg(*[_col(a) for a in aggregates]) if keys else df.agg(*[_col(a) for a in aggregates])
    return out.where(having) if having is not None else out


def aggregate_or_nothing(df: DataFrame, aggregates: Exprs) -> DataFrame:
    """Aggregates over all rows; over no rows, no row."""
    marked = df.agg(*[_col(a) for a in aggregates], F.count(F.lit(1)).alias("_rows"))
    return marked.where("_rows > 0").drop("_rows")


def ordered(df: DataFrame, keys: Exprs) -> DataFrame:
    return df.orderBy(*[_col(k) for k in keys])


def limited(df: DataFrame, n: int | None = None, offset: int = 0) -> DataFrame:
    """Skip ``offset`` rows, then at most ``n``; after ordered() Spark keeps only the top rows of each task."""
    df = df.offset(offset) if offset else df
    return df if n is None else df.limit(n)


def renamed(df: DataFrame, alias: str, names: Sequence[str | None]) -> DataFrame:
    """A derived table: columns without a name get ``unname_col<i>``."""
    return df.toDF(*[n or f"unname_col{i}" for i, n in enumerate(names)]).alias(alias)
