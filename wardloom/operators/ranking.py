"""Row numbers and neighbours within a key, when one key may hold much of the table.

Rows are dealt by key and range of a whole-number order column; what lies
before a range comes from one row per key and range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order column in a range.
WIDTH = 100_000


def _ranged(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("__range", F.floor(F.col(order) / width))


def numbered(df: DataFrame, keys: list[str], order: str, out: str = "n", width: int = WIDTH) -> DataFrame:
    """``df`` with ``out``: 1, 2, 3 ... within ``keys`` by ``order``, which must not repeat there."""
    rows = _ranged(df, order, width)
    sizes = rows.groupBy(*keys, "__range").agg(F.count("*").alias("__size"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(earlier), F.lit(0))).drop("__size")
    here = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(order))
    placed = rows.withColumn("__here", here).join(sizes, [*keys, "__range"])
    return placed.withColumn(out, F.col("__before") + F.col("__here")).drop("__range", "__here", "__before")


def with_previous(df: DataFrame, keys: list[str], order: str, out: str = "before", width: int = WIDTH) -> DataFrame:
    """``df`` with ``out``: the order column's value before each row's within ``keys``, null for the first."""
    rows = _ranged(df, order, width)
    tops = rows.groupBy(*keys, "__range").agg(F.max(order).alias("__top"))
    tops = tops.withColumn("__last", F.lag("__top").over(Window.partitionBy(*keys).orderBy("__range"))).drop("__top")
    near = F.lag(order).over(Window.partitionBy(*keys, "__range").orderBy(order))
    return rows.withColumn("__near", near).join(tops, [*keys, "__range"]).withColumn(out, F.coalesce("__near", "__last")).drop("__range", "__near", "__last")
