"""Named queries over the test tables, one for each operator, and the DuckDB SQL that must give the same rows.

Queries return the logical columns of their tables: filters see the raw physical view (where a timestamp is
a long), so those on timestamps compare microseconds.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import decode, formatting
from ..functions.statistics import block_statistics, column_statistics, file_sizes, footer_statistics, row_group_sizes
from ..operators.predicates import Predicate, all_of, any_of, contains, custom, eq, gt, gte, is_not_null, is_null, lt, lte, named, neq, prefix, suffix
from ..operators.query import Table
from ..sources import sink
from ..sources.footer import footer, list_files
from ..sources.table import has_magic, read, row_groups
from ..streaming.filters import matching
from ..types import F32, F64, I32, I64, Bool, Str
from .report import HEADINGS, Inspector, export_json, json_rows, profile

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _filtered(name: str, table: str, columns: tuple[str, ...], *predicates: Predicate, sql: str) -> None:
    """A query of the rows of `table` that pass the filters over its whole physical view."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Table.open(spark, f"{sf_dir}/{table}.parquet").filter(*predicates).df.select(*columns)

    _QUERIES[name] = run
    _SQL[name] = f"select {', '.join(columns)} from {table} where {sql}"


LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
PART = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
_DOUBLES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_LONGS = ("l_orderkey", "l_partkey", "l_suppkey", "epoch_us(l_shipdate)")


def _some(columns: tuple[str, ...], test: str) -> str:
    return "(" + " or ".join(f"{c} {test}" for c in columns) + ")"


# one operator, met by any column of its kind
_filtered("eq_any_i32", "lineitem", LINE, eq(I32(4)), sql="l_linenumber = 4")
_filtered("eq_any_i64", "lineitem", LINE, eq(I64(7)), sql=_some(_LONGS, "= 7"))
_filtered("eq_any_f64", "lineitem", LINE, eq(F64(0.05)), sql=_some(_DOUBLES, "= 0.05::double"))
_filtered("eq_any_str", "orders", ORDERS, eq(Str("F")), sql=_some(("o_orderstatus", "o_orderpriority"), "= 'F'"))
_filtered("eq_no_such_kind", "lineitem", LINE, eq(Bool(True)), sql="false")
_filtered("eq_null", "orders", ORDERS, eq(None), sql="false")
_filtered("neq_any_str", "region", ("r_regionkey", "r_name"), neq(Str("ASIA")), sql="true")
_filtered("neq_type_mismatch", "nation", ("n_nationkey", "n_name", "n_regionkey"), neq(Bool(True)), sql="true")
for _op, _make, _sign in (("lt", lt, "<"), ("lte", lte, "<="), ("gt", gt, ">"), ("gte", gte, ">=")):
    _value = 0.03 if _op in ("lt", "lte") else 90000.0
    _filtered(f"{_op}_f64", "lineitem", LINE, _make(F64(_value)), sql=_some(_DOUBLES, f"{_sign} {_value}::double"))
_filtered("gt_i32", "part", PART, gt(I32(45)), sql="p_size > 45")
_filtered("gt_str", "orders", ORDERS, gt(Str("4")), sql=_some(("o_orderstatus", "o_orderpriority"), "> '4'"))
_filtered("gt_raw_ts", "orders", ORDERS, gt(I64(1_400_000_000_000_000)), sql=_some(("o_orderkey", "o_custkey", "epoch_us(o_orderdate)"), "> 1400000000000000"))
_filtered("gt_raw_ts_low", "orders", ORDERS, gt(I64(800_000_000_000_000)), sql=_some(("o_orderkey", "o_custkey", "epoch_us(o_orderdate)"), "> 800000000000000"))
_filtered("prefix_any", "part", PART, prefix("Brand#1"), sql="(starts_with(p_name, 'Brand#1') or starts_with(p_brand, 'Brand#1') or starts_with(p_type, 'Brand#1'))")
_filtered("prefix_empty", "part", PART, prefix(""), sql="true")
_filtered("suffix_any", "part", PART, suffix("5"), sql="(suffix(p_name, '5') or suffix(p_brand, '5') or suffix(p_type, '5'))")
_filtered("contains_any", "part", PART, contains("#2"), sql="(contains(p_name, '#2') or contains(p_brand, '#2') or contains(p_type, '#2'))")
_filtered("is_not_null_any", "region", ("r_regionkey", "r_name"), is_not_null(), sql="true")
# sets: one column meets all or any of the members
_filtered("set_all", "lineitem", LINE, all_of(gt(F64(0.02)), lt(F64(0.05))), sql="(" + " or ".join(f"({c} > 0.02::double and {c} < 0.05::double)" for c in _DOUBLES) + ")")
_filtered("set_all_disjoint", "lineitem", LINE, all_of(gt(F64(40.0)), lt(F64(0.01))), sql="(" + " or ".join(f"({c} > 40 and {c} < 0.01::double)" for c in _DOUBLES) + ")")
_filtered("set_any", "part", PART, any_of(eq(I32(1)), eq(I32(50))), sql="p_size in (1, 50)")
_filtered("set_nested", "part", PART, all_of(any_of(prefix("Brand#1"), prefix("Brand#2")), suffix("3")), sql="(" + " or ".join(f"((starts_with({c}, 'Brand#1') or starts_with({c}, 'Brand#2')) and suffix({c}, '3'))" for c in ("p_name", "p_brand", "p_type")) + ")")
_filtered("set_all_empty", "region", ("r_regionkey", "r_name"), all_of(), sql="true")
_filtered("set_any_empty", "region", ("r_regionkey", "r_name"), any_of(), sql="false")
# an array of filters: each is met by some column, not necessarily the same
_filtered("filters_array_and", "lineitem", LINE, gt(F64(40.0)), lt(F64(0.01)), sql=f"{_some(_DOUBLES, '> 40')} and {_some(_DOUBLES, '< 0.01::double')}")
_filtered("filters_array_none", "region", ("r_regionkey", "r_name"), sql="true")
# filters that name their column, or are the user's own
_filtered("named_column", "lineitem", LINE, named("l_quantity", gte(F64(49.0))), sql="l_quantity >= 49")
_filtered("named_neq", "orders", ORDERS, named("o_orderstatus", neq(Str("F"))), sql="o_orderstatus is distinct from 'F'")
_filtered("custom_filter", "customer", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), custom(lambda info, c: F.length(c) == 8 if info.name.endswith("segment") else False), sql="length(c_mktsegment) = 8")


# nulls, lists and maps, which the tables lack, are derived
def _derived(df: DataFrame, *predicates: Predicate) -> DataFrame:
    return Table.of(df).filter(*predicates).df


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr("nullif(o_orderstatus, 'F')").alias("st"), "o_custkey")


_GAPS = "(select o_orderkey, nullif(o_orderstatus, 'F') as st, o_custkey from orders)"
_NULLS = {
    "neq_null_matches": (named("st", neq(Str("O"))), "st is distinct from 'O'"),
    "neq_null_value": (named("st", neq(None)), "st is not null"),
    "eq_skips_null": (named("st", eq(Str("O"))), "st = 'O'"),
    "is_null": (is_null(), "o_orderkey is null or st is null or o_custkey is null"),
    "is_not_null": (named("st", is_not_null()), "st is not null"),
    "neq_any_with_null": (all_of(neq(Str("O")), neq(Str("P"))), "true"),
}
for _name, (_p, _where) in _NULLS.items():
    _query(_name, f"select * from {_GAPS} where {_where}")(lambda spark, sf_dir, p=_p: _derived(_gaps(spark, sf_dir), p))


def _float_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select("l_orderkey", F.array("l_linenumber", F.expr("nullif(cast(l_quantity as int), 7)")).alias("xs"))


_LIST = "(select l_orderkey, [l_linenumber, nullif(l_quantity::int, 7)] as xs from lineitem)"
_LISTS = {"contains_list": (contains(I32(3)), "list_contains(xs, 3)"), "eq_list": (eq([I32(1), I32(30)]), "xs = [1, 30]"), "eq_list_null": (eq([I32(1), None]), "xs[1] = 1 and xs[2] is null"), "neq_list": (all_of(named("xs", neq([I32(1), I32(30)]))), "not (coalesce(xs[1] = 1, false) and coalesce(xs[2] = 30, false))")}
for _name, (_p, _where) in _LISTS.items():
    _query(_name, f"select l_orderkey, xs[1] as a, xs[2] as b from {_LIST} where {_where}")(lambda spark, sf_dir, p=_p: _derived(_float_list(spark, sf_dir), p).select("l_orderkey", F.col("xs")[0].alias("a"), F.col("xs")[1].alias("b")))


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select("p_partkey", F.map_from_arrays(F.array(F.lit("brand"), F.lit("size")), F.array("p_brand", F.col("p_size").cast("string"))).alias("m"))


@_query("eq_map", "select p_partkey from part where p_brand = 'Brand#12' and p_size = 10")
def eq_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(_maps(spark, sf_dir), eq({Str("size"): Str("10"), Str("brand"): Str("Brand#12")})).select("p_partkey")


@_query("neq_map", "select p_partkey from part where not (p_brand = 'Brand#12' and p_size = 10)")
def neq_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(_maps(spark, sf_dir), named("m", neq({Str("size"): Str("10"), Str("brand"): Str("Brand#12")}))).select("p_partkey")


@_query("contains_map_is_false", "select p_partkey from part where false")
def contains_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(_maps(spark, sf_dir), named("m", contains(Str("10")))).select("p_partkey")


@_query("map_keys_string", "select p_partkey, p_brand as by_one, p_type as by_two from part")
def map_keys_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    m = decode.string_keys(F.map_from_arrays(F.array(F.lit(1), F.lit(2)), F.array("p_brand", "p_type")))
    return rows.select("p_partkey", m["1"].alias("by_one"), m["2"].alias("by_two"))


@_query("map_from_kv", "select p_partkey, p_type as last, p_name as other, 2::int as n from part")
def map_from_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists as a map: of equal keys the last value counts."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    m = decode.map_of(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.array("p_brand", "p_name", "p_type"))
    return rows.select("p_partkey", m.alias("m")).select("p_partkey", F.col("m")["a"].alias("last"), F.col("m")["b"].alias("other"), F.size("m").alias("n"))


@_query("decode_map", "select p_partkey, upper(p_brand) as brand, upper(p_size::varchar) as size from part")
def decode_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.decode_map(_maps(spark, sf_dir), "m", value=F.upper, keep=["p_partkey"]).select("p_partkey", F.col("m")["brand"].alias("brand"), F.col("m")["size"].alias("size"))


@_query("decode_list", "select l_orderkey, l_linenumber + 1 as a, nullif(l_quantity::int, 7) + 1 as b from lineitem")
def decode_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.decode_list(_float_list(spark, sf_dir), "xs", lambda x: x + 1, keep=["l_orderkey"]).select("l_orderkey", F.col("xs")[0].alias("a"), F.col("xs")[1].alias("b"))


@_query("assemble_struct", "select s_suppkey, s_name as nm, s_acctbal as bal from supplier")
def assemble_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return rows.select("s_suppkey", decode.struct_of(["s_name", "s_acctbal"], ["nm", "bal"]).alias("s")).select("s_suppkey", "s.nm", "s.bal")


@_query("flatten_struct", "select s_suppkey as k, s_name as \"s.name\", s_nationkey as \"s.at.nation\" from supplier")
def flatten_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    nested = rows.select(F.col("s_suppkey").alias("k"), F.struct(F.col("s_name").alias("name"), F.struct(F.col("s_nationkey").alias("nation")).alias("at")).alias("s"))
    return decode.leaves(nested)


# counts, limits, projections, typed columns
@_query("count_total", "select count(*) as n from lineitem")
def count_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footer(spark, f"{sf_dir}/lineitem.parquet", "files").agg(F.sum("num_rows").alias("n"))


@_query("count_matching", f"select count(*) as n from lineitem where {_some(_DOUBLES, '< 0.01::double')}")
def count_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table.open(spark, f"{sf_dir}/lineitem.parquet").filter(lt(F64(0.01))).df.agg(F.count("*").alias("n"))


@_query("matches_flag", "select p_partkey, p_size > 40 as matches from part")
def matches_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table.open(spark, f"{sf_dir}/part.parquet").matches(gt(I32(40))).df.select("p_partkey", "matches")


@_query("limit_head", "select c_custkey, c_name from customer order by c_custkey limit 10")
def limit_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the file, which has them by key."""
    return Table.open(spark, f"{sf_dir}/customer.parquet", order=True).limit(10).df.select("c_custkey", "c_name")


@_query("select_pruned", "select l_orderkey, l_tax from lineitem where l_tax > 0.07::double")
def select_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a projection, filters see its columns only."""
    return Table.open(spark, f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_tax").filter(gt(F64(0.07))).df


_TYPED = {"int32": ("lineitem", "l_linenumber"), "int64": ("orders", "o_custkey"), "double": ("lineitem", "l_tax"), "string": ("part", "p_brand")}
for _name, (_t, _c) in _TYPED.items():
    _query(f"typed_decode_{_name}", f"select {_c} from {_t}")(lambda spark, sf_dir, n=_name, t=_t, c=_c: getattr(decode, f"decode_{n}")(Table.open(spark, f"{sf_dir}/{t}.parquet").df, c))


@_query("typed_decode_bytes", "select hex(encode(p_brand)) as h from part")
def typed_decode_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.decode_bytes(Table.open(spark, f"{sf_dir}/part.parquet").df, "p_brand").select(F.hex("p_brand").alias("h"))


@_query("typed_decode_float", "select vec_id, embedding[1] as x from embeddings")
def typed_decode_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Table.open(spark, f"{sf_dir}/embeddings.parquet").df.select("vec_id", F.col("embedding")[0].alias("x"))
    return decode.decode_float(rows, "x", keep=["vec_id"])


@_query("typed_decode_floats", "select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as place from embeddings")
def typed_decode_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component of every vector."""
    rows = Table.open(spark, f"{sf_dir}/embeddings.parquet").df.select("vec_id", F.posexplode("embedding").alias("place", "x"))
    return decode.decode_float(rows.withColumn("place", (F.col("place") + 1).cast("long")), "x", keep=["vec_id", "place"])


@_query("typed_decode_boolean", "select l_orderkey, l_linenumber, l_tax > 0.04::double as high from lineitem")
def typed_decode_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boolean that is stored: bit-packed, as pages of version 1 have it."""
    return decode.decode_boolean(_stored_boolean(spark, sf_dir).df, "high", keep=["l_orderkey", "l_linenumber"])


def _stored_boolean(spark: SparkSession, sf_dir: str, v2: bool = False) -> Table:
    path = _scratch(spark)
    sink.write(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_tax") > 0.04).alias("high")), path, v2=v2)
    return Table.open(spark, path)


@_query("stored_boolean_rle", "select l_orderkey, l_linenumber, l_tax > 0.04::double as high from lineitem")
def stored_boolean_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boolean in runs, as pages of version 2 have it."""
    return decode.decode_boolean(_stored_boolean(spark, sf_dir, v2=True).df, "high", keep=["l_orderkey", "l_linenumber"])


@_query("eq_any_boolean", "select l_orderkey, l_linenumber from lineitem where l_tax > 0.04::double")
def eq_any_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_boolean(spark, sf_dir).filter(eq(Bool(True))).df.select("l_orderkey", "l_linenumber")


@_query("byte_stream_split", "select n_nationkey, n_nationkey / 4.0::double as quarter, (n_regionkey / 2.0)::float as half from nation")
def byte_stream_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles and floats in the encoding that Spark can't write: the 25 nations, by another writer, in two files."""
    import tempfile

    import pyarrow.parquet as pq

    to = _scratch(spark)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(to)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey", "n_nationkey / 4D as quarter", "cast(n_regionkey / 2 as float) as half").orderBy("n_nationkey").toArrow()
    with tempfile.TemporaryDirectory() as own:
        for name, part, kinds in (("a", rows.slice(0, 10), {}), ("b", rows.slice(10), {"quarter": "BYTE_STREAM_SPLIT", "half": "BYTE_STREAM_SPLIT"})):
            pq.write_table(part, f"{own}/{name}.parquet", use_dictionary=False, column_encoding=kinds or None)
            fs.copyFromLocalFile(jvm.org.apache.hadoop.fs.Path(f"file:{own}/{name}.parquet"), at)
    return Table.open(spark, to).df


@_query("delta_length_byte_array", "select n_nationkey, n_name from nation")
def delta_length_byte_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings by their lengths and bytes apart, in pages of either version, as another writer puts them."""
    import tempfile

    import pyarrow.parquet as pq

    to = _scratch(spark)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(to)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").orderBy("n_nationkey").toArrow()
    with tempfile.TemporaryDirectory() as own:
        for name, part, pages in (("a", rows.slice(0, 10), "1.0"), ("b", rows.slice(10), "2.0")):
            pq.write_table(part, f"{own}/{name}.parquet", use_dictionary=False, column_encoding={"n_name": "DELTA_LENGTH_BYTE_ARRAY", "n_nationkey": "DELTA_BINARY_PACKED"}, data_page_version=pages)
            fs.copyFromLocalFile(jvm.org.apache.hadoop.fs.Path(f"file:{own}/{name}.parquet"), at)
    return Table.open(spark, to).df


@_query("eq_f32_list", "select vec_id from embeddings where list_contains(embedding, (select embedding[1] from embeddings where vec_id = 3))")
def eq_f32_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table.open(spark, f"{sf_dir}/embeddings.parquet")
    x = t.df.filter("vec_id = 3").select(F.col("embedding")[0]).first()
    return t.filter(contains(F32(x[0] if x else 0.0))).df.select("vec_id")


@_query("physical_view", "select o_orderkey, epoch_us(o_orderdate) as o_orderdate from orders")
def physical_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, f"{sf_dir}/orders.parquet")[0].select("o_orderkey", "o_orderdate")


@_query("logical_view", "select o_orderkey, o_orderdate from orders")
def logical_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, f"{sf_dir}/orders.parquet", "logical")[0].select("o_orderkey", "o_orderdate")


@_query("scan_all", "select event_id, epoch_us(ts) as ts, user_id, event_type, value, props from events")
def scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table.open(spark, f"{sf_dir}/events.parquet").df


@_query("row_group_scan", "select c_custkey, c_name from customer")
def row_group_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row groups of all files, which together are the table."""
    return row_groups(spark, f"{sf_dir}/customer.parquet").filter("row_group >= 0").select("c_custkey", "c_name")


# footers and statistics
@_query("footer_files", "select count(*) as n from orders")
def footer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_sizes(spark, f"{sf_dir}/orders.parquet").agg(F.sum("rows").alias("n"))


@_query("footer_row_groups", "select count(*) as n from lineitem")
def footer_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footer(spark, f"{sf_dir}/lineitem.parquet", "row_groups").agg(F.sum("num_rows").alias("n"))


_CHUNKS = {"o_orderkey": "INT64", "o_custkey": "INT64", "o_orderstatus": "BYTE_ARRAY", "o_totalprice": "DOUBLE", "o_orderdate": "INT64", "o_orderpriority": "BYTE_ARRAY"}


@_query("footer_chunks", "\nunion all\n".join(f"select {i} as \"column\", '{c}' as path, '{t}' as type, count(*) as num_values, count(*) - count({c}) as null_count, true as sized, min({c})::varchar as low, max({c})::varchar as high from orders" if t != "DOUBLE" and c != "o_orderdate" else f"select {i}, '{c}', '{t}', count(*), count(*) - count({c}), true, null, null from orders" for i, (c, t) in enumerate(_CHUNKS.items())))
def footer_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column chunks of all row groups: values, nulls, recorded bounds of longs and strings, and whether their sizes make sense."""
    chunks = footer(spark, f"{sf_dir}/orders.parquet", "column_chunks")
    from_long = lambda c: F.conv(F.concat(*[F.hex(F.substring(c, i, 1)) for i in range(8, 0, -1)]), 16, -10).cast("long")
    by = chunks.groupBy("column", "path", "type")
    long, text = F.col("type") == "INT64", F.col("type") == "BYTE_ARRAY"
    got = by.agg(
        F.sum("num_values").alias("num_values"), F.sum("null_count").alias("null_count"), F.min((F.col("total_compressed_size") > 0) & (F.col("total_uncompressed_size") > 0) & (F.col("data_page_offset") >= 4)).alias("sized"),
        F.min(F.when(long, from_long(F.col("min")))).alias("low_n"), F.max(F.when(long, from_long(F.col("max")))).alias("high_n"), F.min(F.when(text, F.col("min").cast("string"))).alias("low_s"), F.max(F.when(text, F.col("max").cast("string"))).alias("high_s"),
    )
    shown = F.col("path") != "o_orderdate"
    return got.select("column", "path", "type", "num_values", "null_count", "sized", F.when(shown, F.coalesce(F.col("low_n").cast("string"), "low_s")).alias("low"), F.when(shown, F.coalesce(F.col("high_n").cast("string"), "high_s")).alias("high"))


@_query("row_group_ratios", "select count(*) as rows, 10 + 1 as columns, true as consistent from lineitem")
def row_group_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all row groups, columns of each, and whether every ratio is that of its bytes."""
    sizes = row_group_sizes(spark, f"{sf_dir}/lineitem.parquet")
    groups = footer(spark, f"{sf_dir}/lineitem.parquet", "row_groups").select("file", "row_group", "num_rows")
    fits = (F.abs(F.col("ratio") * F.col("compressed") - F.col("uncompressed")) < 1) & (F.col("compressed") > 0)
    return sizes.join(groups, ["file", "row_group"]).agg(F.sum("num_rows").alias("rows"), F.max("columns").cast("int").alias("columns"), F.min(fits).alias("consistent"))


@_query("footer_null_counts", "select column_name as path, count(*) as total_values, 0::bigint as null_count, count(*) as non_null_count from (unpivot (select n_nationkey::varchar as n_nationkey, n_name, n_regionkey::varchar as n_regionkey from nation) on n_nationkey, n_name, n_regionkey into name column_name value v) group by 1")
def footer_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footer_statistics(spark, f"{sf_dir}/nation.parquet").select("path", "total_values", "null_count", "non_null_count")


@_query("col_stats", "\nunion all\n".join(f"select '{c}' as \"column\", count(*) as n, count(*) - count({c}) as nulls, count(distinct {c}) as \"distinct\", min({c})::varchar as min, max({c})::varchar as max from orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")))
def col_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_statistics(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@_query("col_profile", "select 'p_size' as \"column\", count(p_size) as \"values\", count(*) - count(p_size) as nulls, count(distinct p_size) as \"distinct\", min(p_size)::varchar as min, max(p_size)::varchar as max, avg(p_size) as mean from part")
def col_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size"))


@_query("block_stats", "select (c_custkey - (select min(c_custkey) from customer)) // 1000 as block, count(*) as rows, count(distinct c_nationkey) as nations, min(c_acctbal) as low, max(c_acctbal) as high from customer group by 1")
def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a writer of 1000-row groups records; the key numbers the rows."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    low = rows.agg(F.min("c_custkey")).first()[0] or 0
    got = block_statistics(rows.select("c_custkey", "c_nationkey", "c_acctbal"), F.col("c_custkey") - low)
    return got.select("block", "rows", F.col("`c_nationkey.distinct`").alias("nations"), F.col("`c_acctbal.min`").alias("low"), F.col("`c_acctbal.max`").alias("high"))


# writing, JSON, streams
def _scratch(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root or 'file:/tmp/checkpoints'}/round-trip-{uuid.uuid4().hex}"


for _codec in sink.CODECS:

    def _round_trip(spark: SparkSession, sf_dir: str, codec: str = _codec) -> DataFrame:
        path = _scratch(spark)
        sink.write(spark.read.parquet(f"{sf_dir}/supplier.parquet"), path, codec)
        return spark.read.parquet(path)

    _query(f"write_roundtrip_{_codec.lower()}", "select * from supplier")(_round_trip)


@_query("write_row_groups", "select ceil(count(*) / 1000.0)::bigint as groups, count(*) as rows from customer")
def write_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row groups of 1000 rows."""
    path = _scratch(spark)
    sink.write(spark.read.parquet(f"{sf_dir}/customer.parquet").coalesce(1), path)
    return footer(spark, path, "row_groups").agg(F.count("*").alias("groups"), F.sum("num_rows").alias("rows"))


@_query("write_empty", "select 0::bigint as rows, 0::bigint as groups")
def write_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without rows: a footer and no row groups."""
    path = _scratch(spark)
    sink.write(spark.read.parquet(f"{sf_dir}/region.parquet").limit(0), path)
    return footer(spark, path, "files").agg(F.sum("num_rows").alias("rows"), F.sum("num_row_groups").cast("long").alias("groups"))


@_query("write_conformed", "select s_suppkey::varchar as s_suppkey, s_name, s_acctbal from supplier")
def write_conformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns brought to a schema: its names, order and types; numbers as text where it says so."""
    path = _scratch(spark)
    shape = T.StructType([T.StructField("s_suppkey", T.StringType()), T.StructField("s_name", T.StringType(), False), T.StructField("s_acctbal", T.DoubleType())])
    sink.write(spark.read.parquet(f"{sf_dir}/supplier.parquet"), path, schema=shape)
    return spark.read.parquet(path)


@_query("write_maps", "select p_partkey, p_brand as brand, p_size::varchar as size from part")
def write_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map columns written, and read back in the physical view."""
    path = _scratch(spark)
    sink.write(_maps(spark, sf_dir), path, "GZIP")
    return Table.open(spark, path).df.select("p_partkey", F.col("m")["brand"].alias("brand"), F.col("m")["size"].alias("size"))


@_query("gzip_map_scan", "select o_orderkey, o_orderstatus as status, o_orderpriority as priority from orders")
def gzip_map_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map for each order, written with GZIP and read back whole."""
    path = _scratch(spark)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority").alias("m"))
    sink.write(rows, path, "GZIP")
    return Table.open(spark, path).df.select("o_orderkey", F.col("m")["status"].alias("status"), F.col("m")["priority"].alias("priority"))


@_query("write_rows", "select * from region")
def write_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written one at a time."""
    path, table = _scratch(spark), Table.open(spark, f"{sf_dir}/region.parquet")
    with sink.RowWriter(spark, path, table.df.schema) as to:
        for row in table.rows():
            to.add(row.values)
    return spark.read.parquet(path)


@_query("write_encodings_v2", "select * from orders")
def write_encodings_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 2 pages without dictionaries: delta encodings."""
    path = _scratch(spark)
    sink.write(spark.read.parquet(f"{sf_dir}/orders.parquet"), path, "ZSTD", dictionary=False, v2=True)
    return spark.read.parquet(path)


# reports of one file
@_query("verify_magic", "select true as ok")
def verify_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = has_magic(spark, list_files(spark, f"{sf_dir}/nation.parquet", most=1)[0])
    return spark.createDataFrame([(ok,)], "ok boolean")


@_query("inspect_file", "select count(*) as total_rows, 3::bigint as physical_columns, 3::bigint as logical_columns from nation")
def inspect_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = Inspector(spark, f"{sf_dir}/nation.parquet").file_info()
    return spark.createDataFrame([(info["totalRows"], info["physicalColumns"], info["logicalColumns"])], "total_rows long, physical_columns long, logical_columns long")


@_query("inspect_schema", "select * from (values (0::bigint, 'n_nationkey', 'INT32'), (1, 'n_name', 'BYTE_ARRAY'), (2, 'n_regionkey', 'INT32')) as t(index, name, type)")
def inspect_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Inspector(spark, f"{sf_dir}/nation.parquet").schema_info()["physicalColumns"]
    return spark.createDataFrame([(c["index"], c["path"], c["physicalType"]) for c in found], "index long, name string, type string")


@_query("inspect_sample", "select n_nationkey, n_name from nation order by n_nationkey limit 10")
def inspect_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows a report shows: ten of the 25."""
    rows = Inspector(spark, f"{sf_dir}/nation.parquet").sampling()["samples"]
    return spark.createDataFrame([(r["values"]["n_nationkey"], r["values"]["n_name"]) for r in rows], "n_nationkey int, n_name string")


@_query("report_text", "select * from (values (0, 'PARQUET FILE INSPECTION'), (1, 'FILE INFORMATION'), (2, 'SCHEMA STRUCTURE'), (3, 'ROW GROUPS'), (4, 'COLUMN CHUNK DETAILS (First Row Group)'), (5, 'DATA SAMPLING'), (6, 'STATISTICS SUMMARY')) as t(place, heading)")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings of the text report and its summary, in order."""
    it = Inspector(spark, f"{sf_dir}/nation.parquet")
    lines = f"{it.as_text()}\n{it.summary()}".split("\n")
    return spark.createDataFrame(list(enumerate(x for x in lines if x in HEADINGS)), "place int, heading string")


@_query("metadata_text", "select 'Total rows: ' || count(*) as line from nation union all select '    Column ' || i || ' (' || n || '): ' || t || ', values=' || (select count(*) from nation) from (values (0, 'n_nationkey', 'INT32'), (1, 'n_name', 'BYTE_ARRAY'), (2, 'n_regionkey', 'INT32')) as c(i, n, t)")
def metadata_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the printed metadata: the number of rows and the chunks, without their codec."""
    lines = Inspector(spark, f"{sf_dir}/nation.parquet").metadata_text().split("\n")
    chosen = [x.replace(x[x.index(" codec=") : x.index(" values=")], "") if "codec=" in x else x for x in lines if x.startswith(("Total rows", "    Column"))]
    return spark.createDataFrame([(x,) for x in chosen], "line string")


@_query("inspect_row_groups", "select count(*) as rows, true as ratios from customer")
def inspect_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = Inspector(spark, f"{sf_dir}/customer.parquet").row_group_info()
    rows = sum(g["numRows"] for g in groups["groups"])
    good = groups["count"] == len(groups["groups"]) and all(abs(g["compressionRatio"] * g["compressedSize"] - g["uncompressedSize"]) < 1 for g in groups["groups"])
    return spark.createDataFrame([(rows, good)], "rows long, ratios boolean")


@_query("inspect_statistics", "select count(*) as rows, true as consistent from customer")
def inspect_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Inspector(spark, f"{sf_dir}/customer.parquet").statistics()
    good = s["bytesSaved"] == s["totalUncompressedSize"] - s["totalCompressedSize"] and abs(s["averageRowSize"] * s["totalRows"] - s["totalFileSize"]) < 1
    return spark.createDataFrame([(s["totalRows"], good)], "rows long, consistent boolean")


@_query("format_values", "select n_nationkey::varchar as key, n_name as name from nation")
def format_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as the report shows them."""
    rows = Table.open(spark, f"{sf_dir}/nation.parquet").df.select("n_nationkey", "n_name").collect()  # 25 nations
    return spark.createDataFrame([(formatting.value(k), formatting.value(n).strip('"')) for k, n in rows], "key string, name string")


@_query("tail_rows", "select c_custkey, c_name from customer order by c_custkey desc limit 5")
def tail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table.open(spark, f"{sf_dir}/customer.parquet", order=True).tail(5).df.select("c_custkey", "c_name")


@_query("iterate_rows", "select r_regionkey, r_name from region")
def iterate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows one by one, with a look ahead, by name and by type."""
    rows, out = Table.open(spark, f"{sf_dir}/region.parquet").rows(), []
    while rows.has_next():
        row = next(rows)
        out.append((row.get("r_regionkey", "INT32"), row["r_name"]))
    return spark.createDataFrame(out, "r_regionkey int, r_name string")


@_query("footer_sizes", "select count(*) as rows, true as consistent from orders")
def footer_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = file_sizes(spark, f"{sf_dir}/orders.parquet")
    fits = (F.col("saved") == F.col("uncompressed") - F.col("compressed")) & (F.abs(F.col("mean_row") * F.col("rows") - F.col("bytes")) < 1) & (F.abs(F.col("ratio") * F.col("compressed") - F.col("uncompressed")) < 1)
    return sizes.agg(F.sum("rows").alias("rows"), F.min(fits).alias("consistent"))


@_query("json_metadata", "select count(*) as n, max(n_name) as top from nation")
def json_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count and a recorded bound, as the JSON export has them."""
    found = Inspector(spark, f"{sf_dir}/nation.parquet").json_metadata()
    top = next(c for c in found["columns"] if c["name"] == "n_name")["statistics"]["max"]
    return spark.createDataFrame([(found["numRows"], top)], "n long, top string")


@_query("json_export", "select r_regionkey::bigint as r_regionkey, r_name from region")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's JSON export, parsed again."""
    out = io.StringIO()
    export_json(spark, list_files(spark, f"{sf_dir}/region.parquet", most=1)[0], out)
    return spark.createDataFrame([(r["r_regionkey"], r["r_name"]) for r in json.loads(out.getvalue())["rows"]], "r_regionkey long, r_name string")


@_query("json_rows", "select r_regionkey, r_name from region")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON objects, and back."""
    rows = spark.read.parquet(f"{sf_dir}/region.parquet")
    return json_rows(rows).select(F.from_json("json", rows.schema).alias("r")).select("r.*")


@_query("stream_filter", "select event_id, event_type, value from events where value > 50 and user_id > 20")
def stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The condition that a stream's filter compiles to, over the table."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return matching(rows, named("value", gt(F64(50.0))), named("user_id", gt(I64(20)))).select("event_id", "event_type", "value")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
