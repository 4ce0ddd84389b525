"""Footers as tables: the metadata of Parquet files, and one file's leaves on the driver.

`footer(spark, path, table)` gives them; after `register(spark)`, so does `spark.read.format("parqyard_footer")` with the
options table and files (one path a line). Tables: files, row_groups, column_chunks. Files are dealt to tasks, and only
footers are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import Leaf

SCHEMAS = {
    "files": "file string, size long, version string, created_by string, num_rows long, num_row_groups int, num_columns int, key_values map<string,string>",
    "row_groups": "file string, row_group int, first_row long, num_rows long, total_byte_size long, num_columns int",
    "column_chunks": "file string, row_group int, column int, path string, type string, codec string, encodings array<string>, num_values long, total_compressed_size long, total_uncompressed_size long, "
    "first_page_offset long, data_page_offset long, dictionary_page_offset long, has_statistics boolean, null_count long, distinct_count long, min binary, max binary",
}
PER_TASK = 64
#: Bytes of a page, as most writers have it.
PAGE = 1 << 20


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, table: str, files: list[str]):
        self.table, self.files = table, files

    def partitions(self) -> list[InputPartition]:
        return [_Files(self.files[i : i + PER_TASK]) for i in range(0, len(self.files), PER_TASK)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from _rows(self.table, path)


class FooterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "parqyard_footer"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "files")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options.get("table", "files"), self.options["files"].split("\n"))


def is_local(path: str) -> bool:
    """Whether a Python worker can open the path by itself."""
    return path.startswith(("file:", "/")) or ":" not in path.split("/", 1)[0]


def _open(path: str):
    import pyarrow as pa
    import pyarrow.parquet as pq

    source = pa.OSFile("/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path)
    return pq.ParquetFile(source), source.size()


def tail(spark: SparkSession, path: str) -> tuple[int, bytes]:
    """A file's size and its footer with the marker behind it, read through Hadoop's FileSystem, whatever the store."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getFileStatus(p).getLen()
    if size < 12:
        raise ValueError(f"{path} is too small for a Parquet file")
    stream = fs.open(p)
    try:

        def read(n: int) -> bytes:
            stream.seek(size - n)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))

        end = read(8)
        length = int.from_bytes(end[:4], "little")
        if end[4:] != b"PAR1" or length + 12 > size:
            raise ValueError(f"{path} has no Parquet footer")
        return size, read(length + 8)
    finally:
        stream.close()


def _raw(kind: str, value) -> bytes | None:
    """A statistic in the format's own bytes: plain little-endian numbers, or the bytes themselves."""
    import struct

    if value is None:
        return None
    if isinstance(value, bytes):
        return value
    if isinstance(value, str):
        return value.encode()
    return struct.pack({"INT32": "<i", "INT64": "<q", "FLOAT": "<f", "DOUBLE": "<d", "BOOLEAN": "<?"}[kind], value)


def _rows(table: str, path: str, size: int | None = None, end: bytes | None = None) -> Iterator[tuple]:
    """The rows of one file, which is opened here unless its size and tail are given."""
    if end is None:
        file, size = _open(path)
    else:
        import pyarrow as pa
        import pyarrow.parquet as pq

        file = pq.ParquetFile(pa.BufferReader(b"PAR1" + end))
    meta = file.metadata
    if table == "files":
        kv = {k.decode("utf-8", "replace"): v.decode("utf-8", "replace") for k, v in (meta.metadata or {}).items()}
        yield path, size, str(meta.format_version), meta.created_by, meta.num_rows, meta.num_row_groups, meta.num_columns, kv
        return
    first = 0
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        if table == "row_groups":
            yield path, g, first, group.num_rows, group.total_byte_size, group.num_columns
        else:
            for i in range(group.num_columns):
                c = group.column(i)
                s = c.statistics
                kind = c.physical_type
                has = s is not None
                start = c.dictionary_page_offset if c.has_dictionary_page and c.dictionary_page_offset else c.data_page_offset
                low, high = (s.min_raw, s.max_raw) if has and s.has_min_max else (None, None)
                yield (
                    path, g, i, c.path_in_schema, kind, c.compression, list(c.encodings), c.num_values, c.total_compressed_size, c.total_uncompressed_size, start, c.data_page_offset,
                    c.dictionary_page_offset if c.has_dictionary_page else None, has, s.null_count if has and s.has_null_count else None, s.distinct_count if has and s.has_distinct_count else None, _raw(kind, low), _raw(kind, high),
                )
        first += group.num_rows


def list_files(spark: SparkSession, path: str, most: int | None = None) -> list[str]:
    """The data files of a file or folder in order of their names, or the first `most` that its listing gives."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found, out = fs.listFiles(p, True), []
    while found.hasNext() and (most is None or len(out) < most):
        at = found.next().getPath()
        if not at.getName().startswith(("_", ".")):
            out.append(at.toString())
    return sorted(out)


def footer(spark: SparkSession, path: str, table: str = "files") -> DataFrame:
    """One of the tables of SCHEMAS for a file or a folder of files.

    Where files are local paths to the workers, Spark lists them and deals them to tasks, which read nothing but
    footers: neither paths nor rows pass the driver. In any other store (hdfs, s3a, viewfs ...), which only the JVM can
    open, the driver's threads read the tails through Hadoop's FileSystem and tasks take them apart.
    """
    if table not in SCHEMAS:
        raise ValueError(f"no footer table {table!r}")
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(spark.createDataFrame([], SCHEMAS[table]).schema)

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for file in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                rows = list(_rows(table, *file))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([list(v.items()) if isinstance(v, dict) else v for v in c], f.type) for c, f in zip(zip(*rows), shape)], schema=shape)

    if is_local(next(iter(list_files(spark, path, most=1)), path)):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    else:
        paths = list_files(spark, path)
        with ThreadPoolExecutor(32) as pool:
            tails = list(pool.map(lambda f: (f, *tail(spark, f)), paths))
        files = spark.createDataFrame(tails, "path string, size long, tail binary")
    return files.mapInArrow(read, SCHEMAS[table])


def register(spark: SparkSession) -> None:
    """Lets spark.read.format("parqyard_footer") read the same tables of the files listed in its option `files`."""
    spark.dataSource.register(FooterSource)


def traits(spark: SparkSession, path: str, file: str | None = None) -> tuple[bool, bool]:
    """Whether any column chunk of a table uses BYTE_STREAM_SPLIT, and whether its row groups are smaller than a page, on average.

    Tasks look at the footers of all files, or the driver at that of `file`, if it is the only one.
    """
    if file is None:
        chunks = footer(spark, path, "column_chunks")
        split, size, groups = chunks.agg(F.max(F.array_contains("encodings", "BYTE_STREAM_SPLIT")), F.sum("total_compressed_size"), F.count_if(F.col("column") == 0)).first()
        return bool(split), (size or 0) < PAGE * groups
    import pyarrow as pa
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(pa.BufferReader(b"PAR1" + tail(spark, file)[1])).metadata
    groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
    chunks = [(c.encodings, c.total_compressed_size) for g in groups for c in map(g.column, range(g.num_columns))]
    return any("BYTE_STREAM_SPLIT" in e for e, _ in chunks), sum(n for _, n in chunks) < PAGE * len(groups)


def leaves(spark: SparkSession, file: str) -> tuple[str, list[Leaf]]:
    """The schema's name and the leaves of one file, by Spark's own Parquet library."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        message = reader.getFooter().getFileMetaData().getSchema()
        out = []
        for c in message.getColumns():
            kind = c.getPrimitiveType()
            note = kind.getLogicalTypeAnnotation()
            name = kind.getPrimitiveTypeName().toString().replace("BINARY", "BYTE_ARRAY")  # as the format calls it
            unsigned = note is not None and note.toString().startswith("INTEGER(") and note.toString().endswith("false)")
            wide = unsigned and note.toString().startswith(("INTEGER(32", "INTEGER(64"))
            out.append(Leaf(tuple(c.getPath()), name, c.getMaxDefinitionLevel(), c.getMaxRepetitionLevel(), kind.getTypeLength(), wide))
        return message.getName(), out
    finally:
        reader.close()
