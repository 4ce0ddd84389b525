"""Neighbours in a global order and running sums within keys, without any group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_table, write_table


def neighbours(rows: DataFrame, order: list[str], carry: list[str], after: str = "after", before: str = "before") -> DataFrame:
    """rows plus the structs `after` and `before`: `carry` of the next and of the previous row by `order` (ascending).

    Rows are dealt into ranges and stored; windows then work within a range, and only the first and last row of each
    range (as many rows as there are ranges) are put in order together. Rows that agree in all of `order` come in any
    order; the first row has no predecessor and the last no successor.
    """
    ranged = write_table(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    own = F.struct(*carry)
    inside = Window.partitionBy("_range").orderBy(*order)
    edges = ranged.groupBy("_range").agg(F.min_by(own, F.struct(*order)).alias("_first"), F.max_by(own, F.struct(*order)).alias("_last"))
    across = Window.partitionBy(F.lit(0)).orderBy("_range")  # a row for each range
    edges = edges.select("_range", F.lead("_first").over(across).alias("_next"), F.lag("_last").over(across).alias("_prev"))
    near = ranged.withColumn(after, F.lead(own).over(inside)).withColumn(before, F.lag(own).over(inside))
    joined = near.join(F.broadcast(edges), "_range")
    out = joined.withColumn(after, F.coalesce(after, "_next")).withColumn(before, F.coalesce(before, "_prev")).drop("_range", "_next", "_prev")
    out._ranged = ranged
    return out


def release(rows: DataFrame) -> None:
    """Deletes what neighbours() stored, once nothing reads its result any more."""
    drop_table(rows._ranged)


def running(rows: DataFrame, key: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows plus, under each name of `sums`, the running sum of its column within `key`, by `order`, up to each row.

    Rows are dealt into ranges of (key, order) and stored, so a large key has several; sums run within a range, and what
    a key's earlier ranges hold is added: a row for each range that does not begin a key.
    """
    ranged = write_table(rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = ranged.groupBy("_range", key).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    by = Window.partitionBy(key).orderBy("_range")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(F.col("_range").alias("_r"), F.col(key).alias("_k"), F.row_number().over(by).alias("_n"), *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums]).filter("_n > 1")
    near = ranged.select("*", *[F.sum(c).over(inside).alias(f"_s_{n}") for n, c in sums.items()])
    joined = near.join(F.broadcast(carry), (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    return joined.select(*rows.columns, *[(F.col(f"_s_{n}") + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in sums])
