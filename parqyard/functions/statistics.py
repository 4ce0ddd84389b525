"""Statistics: of columns, of blocks of rows as a writer would record them, and of footers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.footer import footer


def _plain(t: T.DataType) -> bool:
    return not isinstance(t, (T.MapType, T.ArrayType, T.StructType))


def _measures(name: str, t: T.DataType) -> list[Column]:
    c = F.col(f"`{name}`")
    if isinstance(t, T.MapType):  # a null or empty map has one entry in its levels
        return [F.sum(F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(1)).cast("long")).alias(f"{name}.entries"), F.count_if(c.isNull()).alias(f"{name}.nulls")]
    out = [F.count_if(c.isNull()).alias(f"{name}.nulls")]
    if _plain(t):
        out += [F.count_distinct(c).alias(f"{name}.distinct"), F.min(c).alias(f"{name}.min"), F.max(c).alias(f"{name}.max")]
    return out


def column_statistics(df: DataFrame) -> DataFrame:
    """One row for each plain column: column, n, nulls, distinct, min and max (as strings)."""
    total = F.coalesce(F.sum("n"), F.lit(0))
    measures = {"n": total, "nulls": F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)), "distinct": F.count("v"), "min": F.min("v").cast("string"), "max": F.max("v").cast("string")}
    return by_value(df, lambda t: measures)


def by_value(df: DataFrame, measures: Callable[[T.DataType], dict[str, Column]]) -> DataFrame:
    """For each plain column its name and the measures, aggregates over its distinct values `v` and their counts `n`.

    Each column is counted by itself, reading nothing else, so no row is expanded once per column.
    """
    out = None
    for f in df.schema.fields:
        if _plain(f.dataType):
            counts = df.groupBy(F.col(f"`{f.name}`").alias("v")).agg(F.count("*").alias("n"))
            one = counts.agg(*[m.alias(k) for k, m in measures(f.dataType).items()]).select(F.lit(f.name).alias("column"), *measures(f.dataType))
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no plain columns")
    return out


def block_statistics(df: DataFrame, row: Column, rows: int = 1000) -> DataFrame:
    """What a writer records for each block of `rows` rows: nulls, distinct values, min and max of every column.

    `row` gives each row's number within its file. All-null columns have null bounds and no distinct values.
    """
    block = F.floor(row / rows).cast("long").alias("block")
    return df.groupBy(block).agg(F.count("*").alias("rows"), *[m for f in df.schema.fields for m in _measures(f.name, f.dataType)])


def footer_statistics(spark: SparkSession, path: str) -> DataFrame:
    """For each leaf over all row groups: values, nulls and others, and the first recorded bounds of the files' order."""
    c = footer(spark, path, "column_chunks")
    at = F.struct("file", "row_group")
    return c.groupBy("column", "path", "type").agg(
        F.sum("num_values").alias("total_values"), F.sum("null_count").alias("null_count"), (F.sum("num_values") - F.sum("null_count")).alias("non_null_count"),
        F.min_by("min", F.when(F.col("min").isNotNull(), at)).alias("first_min"), F.min_by("max", F.when(F.col("max").isNotNull(), at)).alias("first_max"),
    )


def row_group_sizes(spark: SparkSession, path: str) -> DataFrame:
    """For each row group: columns, compressed and uncompressed bytes and their ratio."""
    c = footer(spark, path, "column_chunks").groupBy("file", "row_group").agg(F.count("*").alias("columns"), F.sum("total_uncompressed_size").alias("uncompressed"), F.sum("total_compressed_size").alias("compressed"))
    return c.withColumn("ratio", F.when(F.col("compressed") > 0, F.col("uncompressed") / F.col("compressed")))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """For each file: rows, bytes, mean bytes of a row (0 without rows), overall ratio and bytes saved."""
    files = footer(spark, path, "files").select("file", F.col("num_rows").alias("rows"), F.col("size").alias("bytes"))
    sizes = row_group_sizes(spark, path).groupBy("file").agg(F.sum("uncompressed").alias("uncompressed"), F.sum("compressed").alias("compressed"))
    out = files.join(sizes, "file", "left").withColumn("mean_row", F.when(F.col("rows") > 0, F.col("bytes") / F.col("rows")).otherwise(0.0))
    return out.withColumn("ratio", F.when(F.col("compressed") > 0, F.col("uncompressed") / F.col("compressed"))).withColumn("saved", F.when(F.col("compressed") > 0, F.col("uncompressed") - F.col("compressed")))
