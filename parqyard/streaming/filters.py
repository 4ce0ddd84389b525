"""The filter algebra over streams of Parquet files: the same compiled condition, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.predicates import Predicate, compile_all
from ..schema import logical_of


def stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as a stream; `schema` may be a physical read schema."""
    source = spark.readStream.schema(schema)
    return (source.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else source).parquet(folder)


def matching(df: DataFrame, *predicates: Predicate) -> DataFrame:
    """Rows of a stream or table for which every predicate is met by some column."""
    condition = compile_all(predicates, logical_of(df.schema).columns)
    if isinstance(condition, bool):
        return df if condition else df.filter(F.lit(False))
    return df.filter(condition)
