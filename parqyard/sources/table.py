"""Opening Parquet tables in Spark's logical view or in the raw physical view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Schema, logical_of, physical
from .footer import footer, leaves, list_files, traits

#: The marker at both ends of a file.
MAGIC = b"PAR1"
#: Columns that give the file's order of rows.
ORDER = ("_file", "_row")


def read(spark: SparkSession, path: str, view: str = "physical", order: bool = False) -> tuple[DataFrame, Schema]:
    """The table as a DataFrame and its columns.

    The physical view shows stored values: timestamps, dates and decimals as the integers they are kept in, byte arrays
    as UTF-8 strings, structs as dotted columns. With `order`, `_file` and `_row` tell the place of each row. A table of which
    any row group uses BYTE_STREAM_SPLIT is read in a session of its own without the vectorised reader, which lacks it. Where
    row groups are smaller than a page, filters go by the groups' bounds alone, not by the page index: it could skip hardly more, and a look into it
    for each group fills the read buffer anew, twice 64 KB for a group of any size.
    """
    if view not in ("physical", "logical"):
        raise ValueError(f"no view {view!r}")
    files = list_files(spark, path, most=2)
    if not files:
        raise FileNotFoundError(f"no data files at {path}")
    name, found = leaves(spark, files[0])
    split, short = traits(spark, path, files[0] if len(files) == 1 else None)
    if split:
        spark = spark.newSession()
        spark.conf.set("spark.sql.parquet.enableVectorizedReader", "false")
    how = {"parquet.filter.columnindex.enabled": "false"} if short else {}
    inferred = spark.read.options(**how).parquet(path)
    place = [F.col("_metadata.file_path").alias(ORDER[0]), F.col("_metadata.row_index").alias(ORDER[1])] if order else []
    if view == "logical":
        return inferred.select("*", *place) if order else inferred, logical_of(inferred.schema)
    shape, columns, schema = physical(inferred.schema, found, name)
    return spark.read.options(**how).schema(shape).parquet(path).select(*columns, *place), schema


def row_groups(spark: SparkSession, path: str, view: str = "physical") -> DataFrame:
    """The rows of a table with `row_group`, their group's number within its file: one scan, joined with the footers."""
    df, _ = read(spark, path, view, order=True)
    groups = footer(spark, path, "row_groups").select(F.col("file").alias("_of"), "row_group", "first_row", (F.col("first_row") + F.col("num_rows")).alias("_end"))
    name = lambda c: F.regexp_replace(c, "^file:/*", "file:/")
    # a file's groups as one row: each row then finds its own by an equi-join
    groups = groups.groupBy(name(F.col("_of")).alias("_of")).agg(F.collect_list(F.struct("row_group", "first_row", "_end")).alias("_groups"))
    own = F.filter("_groups", lambda g: (F.col(ORDER[1]) >= g["first_row"]) & (F.col(ORDER[1]) < g["_end"]))[0]["row_group"]
    return df.join(groups, name(F.col(ORDER[0])) == F.col("_of")).withColumn("row_group", own).drop("_of", "_groups", *ORDER)


def row_group(spark: SparkSession, path: str, index: int, view: str = "physical") -> DataFrame:
    """The rows of one row group of a single file; IndexError if there is none."""
    groups = footer(spark, path, "row_groups").filter(F.col("row_group") == index).select("first_row", "num_rows").collect()
    if len(groups) != 1:
        raise IndexError(f"no row group {index}" if not groups else "a row group's number is for a single file")
    first, rows = groups[0]
    df, _ = read(spark, path, view, order=True)
    return df.filter(F.col(ORDER[1]).between(first, first + rows - 1)).drop(*ORDER)


def has_magic(spark: SparkSession, path: str) -> bool:
    """Whether the file begins with the format's marker."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(b & 0xFF for b in (stream.read() for _ in range(4)) if b >= 0) == MAGIC
    finally:
        stream.close()
