"""Tables from Parquet folders, from literals, and generated ones."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RELATIONAL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
CORPUS = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, folder: str, name: str, kind: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """A table of a folder; ``kind`` is parquet, orc, json or csv (with a header). Text formats are read once more for their types where no schema is given."""
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    return (reader.schema(schema) if schema else reader).load(f"{folder}/{name}.{kind}")


def save(df: DataFrame, folder: str, name: str, kind: str = "parquet") -> None:
    """What ``load`` reads."""
    df.write.mode("errorifexists").options(**({"header": "true"} if kind == "csv" else {})).format(kind).save(f"{folder}/{name}.{kind}")


def register(spark: SparkSession, folder: str, names: Iterable[str] = RELATIONAL + CORPUS) -> None:
    """Each table of the folder as a temporary view."""
    for name in names:
        load(spark, folder, name).createOrReplaceTempView(name)


def values(spark: SparkSession, rows: Sequence[Sequence], names: Sequence[str] | None = None) -> DataFrame:
    """Literal rows; the types of each position must agree over the rows."""
    if not rows:
        raise ValueError("VALUES needs a row")
    kinds = [{type(v) for v in column if v is not None} for column in zip(*rows, strict=True)]
    if any(len(k) > 1 for k in kinds):
        raise TypeError("the rows of VALUES differ in type")
    of = {int: T.IntegerType(), str: T.StringType(), float: T.DoubleType(), bool: T.BooleanType()}
    names = names or [f"col{i + 1}" for i in range(len(kinds))]
    fields = [T.StructField(n, of[next(iter(k))] if k else T.StringType()) for n, k in zip(names, kinds, strict=True)]
    return spark.createDataFrame([tuple(r) for r in rows], T.StructType(fields))


def generated(spark: SparkSession, thousands: int, seed: int = 0) -> DataFrame:
    """``thousands`` * 1000 rows (colA, colB int; colC, colD of 3 and colE, colF of 10 letters or digits), the same for the same seed.

    Each value is a hash of the row's number, so partitioning does not change it.
    """
    if not 0 < thousands <= 1000:
        raise ValueError("between 1 and 1000 thousands of rows")
    n = thousands * 1000
    number = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(n)).cast("int")
    text = lambda k, size: F.substring(F.sha2(F.concat_ws("-", "id", F.lit(seed), F.lit(k)), 256), 1, size)
    return spark.range(n).select(number(0).alias("colA"), number(1).alias("colB"), text(2, 3).alias("colC"), text(3, 3).alias("colD"), text(4, 10).alias("colE"), text(5, 10).alias("colF"))


def seed_table(spark: SparkSession) -> DataFrame:
    """The one-row table about this engine."""
    return values(spark, [("tessera", "the tessera developers", "none", "a relational analytics engine on Spark")], ["database_name", "author", "address", "description"])
