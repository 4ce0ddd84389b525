"""Writing Parquet: schema-conforming DataFrames, and rows one at a time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The codecs that can be written, by the format's name; LZO and BROTLI are not among them.
CODECS = {"UNCOMPRESSED": "uncompressed", "SNAPPY": "snappy", "GZIP": "gzip", "ZSTD": "zstd", "LZ4": "lz4", "LZ4_RAW": "lz4_raw"}
#: Rows of a row group, as the format's small writers have it.
GROUP_ROWS = 1000


def codec(name: str) -> str:
    try:
        return CODECS[name.upper()]
    except KeyError:
        raise ValueError(f"codec {name} can't be written; choose one of {', '.join(CODECS)}") from None


def write(df: DataFrame, path: str, compression: str = "SNAPPY", schema: T.StructType | None = None, group_rows: int | None = GROUP_ROWS, dictionary: bool = True, mode: str = "errorifexists", v2: bool = False) -> None:
    """Writes df in row groups of `group_rows` rows (None: by size), with its columns brought to `schema` if given.

    A null in a column that the schema requires is an error, as are columns that can't become what it says. Without
    rows, files with a footer and no row groups are written.
    """
    if schema is not None:
        df = conform(df, schema)
    out = df.write.mode(mode).option("compression", codec(compression)).option("parquet.enable.dictionary", str(dictionary).lower())
    if group_rows:
        out = out.option("parquet.block.row.count.limit", str(group_rows))
    if v2:
        out = out.option("parquet.writer.version", "PARQUET_2_0")
    out.parquet(path)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the schema's columns, by name; text and bytes become one another as it asks."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    columns = []
    for f in schema:
        c, have = F.col(f"`{f.name}`"), df.schema[f.name]
        if have.dataType != f.dataType:
            if isinstance(f.dataType, (T.StringType, T.BinaryType)):
                c = c.cast("string").cast(f.dataType) if not isinstance(have.dataType, T.BinaryType) else c.cast(f.dataType)
            else:
                c = c.cast(f.dataType)
        if have.nullable and not f.nullable:
            c = F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"null in required column {f.name}")))
        columns.append(c.alias(f.name))
    return df.select(*columns)


class RowWriter:
    """Rows one at a time into a folder of files: held up to `batch` rows, then appended by Spark.

    Use as a context manager. Closing without any row writes an empty file.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, compression: str = "SNAPPY", batch: int = 100_000):
        self.spark, self.path, self.schema, self.compression, self.batch = spark, path, schema, codec(compression), batch
        self._rows: list[tuple] = []
        self._written = self._closed = False

    def add(self, row: Mapping[str, Any] | Sequence[Any]) -> None:
        if self._closed:
            raise ValueError("the writer is closed")
        values = tuple(row.get(f.name) for f in self.schema) if isinstance(row, Mapping) else tuple(row)
        if len(values) != len(self.schema.fields):
            raise ValueError(f"{len(values)} values for {len(self.schema.fields)} columns")
        self._rows.append(tuple(_coerced(v, f.dataType) for v, f in zip(values, self.schema)))
        if len(self._rows) >= self.batch:
            self._flush()

    def _flush(self) -> None:
        df = self.spark.createDataFrame(self._rows, self.schema).coalesce(1)
        df.write.mode("append").option("compression", self.compression).option("parquet.block.row.count.limit", str(GROUP_ROWS)).parquet(self.path)
        self._rows.clear()
        self._written = True

    def close(self) -> None:
        if not self._closed:
            if self._rows or not self._written:
                self._flush()
            self._closed = True

    def __enter__(self) -> RowWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.close()


def _coerced(v: Any, t: T.DataType) -> Any:
    if v is None:
        return None
    if isinstance(t, T.StringType):
        return bytes(v).decode("utf-8", "replace") if isinstance(v, (bytes, bytearray, memoryview)) else v if isinstance(v, str) else str(v)
    if isinstance(t, T.BinaryType):
        return bytearray(v) if isinstance(v, (bytes, bytearray, memoryview)) else bytearray(str(v).encode())
    if isinstance(t, T.MapType):
        return {_coerced(k, t.keyType): _coerced(x, t.valueType) for k, x in v.items()} if isinstance(v, Mapping) else None
    return v
