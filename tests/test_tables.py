"""Tables in files: views, rows, footers, decoding, writing, reports, JSON, streams and the command line."""

import datetime
import decimal
import io
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parqyard import F64, I32, I64, Table, eq, gt, is_null, lt, named, neq
from parqyard import types as P
from parqyard.cli import main
from parqyard.functions import decode, formatting, statistics
from parqyard.plans import report
from parqyard.schema import from_leaves, string_map_column
from parqyard.sources import sink
from parqyard.sources.footer import footer, list_files, register
from parqyard.sources.table import has_magic, row_group
from parqyard.streaming.filters import matching, stream


@pytest.fixture(scope="module")
def kinds(tmp_path_factory):
    """All kinds of columns, in three row groups."""
    n = 25
    t = pa.table(
        {
            "id": pa.array(range(n), pa.int32()), "big": pa.array([i * 10**10 for i in range(n)], pa.int64()), "tiny": pa.array([i % 5 for i in range(n)], pa.int8()), "f": pa.array([i / 2 for i in range(n)], pa.float32()),
            "d": pa.array([None if i == 3 else i / 4 for i in range(n)], pa.float64()), "ok": pa.array([i % 2 == 0 for i in range(n)]), "s": pa.array([None if i == 4 else f"v{i}" for i in range(n)]),
            "ts": pa.array([datetime.datetime(2020, 1, 1) + datetime.timedelta(days=i) for i in range(n)], pa.timestamp("us")), "day": pa.array([datetime.date(2020, 1, 1)] * n),
            "dec": pa.array([decimal.Decimal(i).scaleb(-2) for i in range(n)], pa.decimal128(9, 2)), "u64": pa.array([2**64 - 1 - i for i in range(n)], pa.uint64()), "u32": pa.array([2**32 - 1 - i for i in range(n)], pa.uint32()),
            "at": pa.array([{"x": i, "y": {"z": f"z{i}"}} for i in range(n)], pa.struct([("x", pa.int32()), ("y", pa.struct([("z", pa.string())]))])),
            "xs": pa.array([None if i == 1 else [] if i == 2 else [i, None] for i in range(n)], pa.list_(pa.int32())), "m": pa.array([None if i == 1 else [] if i == 2 else [("a", "1"), ("k", str(i))] for i in range(n)], pa.map_(pa.string(), pa.string())),
            "fix": pa.array([b"abcd"] * n, pa.binary(4)),
        }
    )
    path = tmp_path_factory.mktemp("kinds") / "kinds.parquet"
    pq.write_table(t, path, row_group_size=10, store_decimal_as_integer=True)
    return str(path)


def test_physical_view(spark, kinds):
    t = Table.open(spark, kinds, order=True)
    row = next(t.rows())
    assert [c.name for c in t.columns()] == ["id", "big", "tiny", "f", "d", "ok", "s", "ts", "day", "dec", "u64", "u32", "at.x", "at.y.z", "xs", "m", "fix"]
    assert row["ts"] == 1577836800000000 and row["day"] == 18262 and row["dec"] == 0 and row["u64"] == -1 and row["u32"] == -1 and row["at.y.z"] == "z0" and row["fix"] is None
    assert row.get("id", P.INT32) == 0 and len(row) == 17 and repr(row).startswith("Row{id=0, big=0")
    with pytest.raises(TypeError):
        row.get("id", P.INT64)
    with pytest.raises(KeyError):
        row["ID"]
    with pytest.raises(IndexError):
        row[17]
    assert t.filter(named("ts", gt(I64(1577836800000000)))).count() == 24 and t.filter(named("dec", gt(I32(20)))).count() == 4
    assert t.filter(eq("z7")).count() == 1 and t.select("at.x").filter(eq(I32(7))).count() == 1
    assert t.filter(named("fix", is_null())).count() == 25 and t.filter(named("fix", neq("abcd"))).count() == 25
    assert t.total_rows() == 25 and t.filter(lt(F64(1.0))).total_rows() == 25
    assert t.schema.with_prefix("at") == [12, 13] and t.schema.column_of_leaf(13).name == "at.y.z" and t.schema.column("none") is None
    rows = t.limit(2).rows()
    assert rows.has_next() and rows.has_next() and next(rows)["id"] == 0 and next(rows)["id"] == 1 and not rows.has_next()
    with pytest.raises(StopIteration):
        next(rows)
    assert [r["id"] for r in t.tail(2).rows()] == [23, 24]
    with pytest.raises(ValueError):
        Table.of(t.df.select("id")).tail(1)


def test_logical_view(spark, kinds):
    t = Table.open(spark, kinds, view="logical")
    assert t.df.schema["ts"].dataType == T.TimestampNTZType() and t.df.schema["dec"].dataType == T.DecimalType(9, 2)
    with pytest.raises(ValueError):
        Table.open(spark, kinds, view="other")
    with pytest.raises(Exception, match="no data files|does not exist|not exist"):
        Table.open(spark, kinds + ".none")


def test_row_groups_and_footers(spark, kinds):
    assert [r["id"] for r in row_group(spark, kinds, 1).orderBy("id").collect()] == list(range(10, 20))
    with pytest.raises(IndexError):
        row_group(spark, kinds, 3)
    assert has_magic(spark, kinds)
    file = footer(spark, kinds, "files").first()
    assert (file["num_rows"], file["num_row_groups"]) == (25, 3)
    assert [r["num_rows"] for r in footer(spark, kinds, "row_groups").orderBy("row_group").collect()] == [10, 10, 5]
    chunk = footer(spark, kinds, "column_chunks").filter("path = 'd' and row_group = 0").first()
    assert chunk["null_count"] == 1 and formatting.statistic(chunk["max"], "DOUBLE") == "2.25"
    own = statistics.footer_statistics(spark, kinds).filter("path = 's'").first()
    assert (own["total_values"], own["null_count"]) == (25, 1)
    assert statistics.file_sizes(spark, kinds).first()["rows"] == 25
    with pytest.raises(ValueError):
        footer(spark, kinds, "pages")
    register(spark)
    source = spark.read.format("parqyard_footer").option("table", "row_groups").option("files", kinds).load()
    assert sorted(map(str, source.drop("file").collect())) == sorted(map(str, footer(spark, kinds, "row_groups").drop("file").collect()))


def test_byte_stream_split(spark, tmp_path):
    path = str(tmp_path / "split.parquet")
    pq.write_table(pa.table({"f": pa.array([1.5, 2.5], pa.float32()), "d": [3.5, 4.5]}), path, use_dictionary=False, column_encoding={"f": "BYTE_STREAM_SPLIT", "d": "BYTE_STREAM_SPLIT"})
    assert [tuple(r) for r in Table.open(spark, path).df.collect()] == [(1.5, 3.5), (2.5, 4.5)]


def test_decode(spark):
    df = spark.createDataFrame([(1, 2, 1.5, 2.5, "a", True, bytearray(b"\xff"), [1, None], {"a": 1})], "i int, l long, f float, d double, s string, b boolean, y binary, xs array<int>, m map<string,int>")
    for name, f in (("i", decode.decode_int32), ("l", decode.decode_int64), ("f", decode.decode_float), ("d", decode.decode_double), ("s", decode.decode_string), ("b", decode.decode_boolean), ("y", decode.decode_bytes), ("s", decode.decode_bytes)):
        assert f(df, name).columns == [name]
    assert decode.decode_string(df, "y").first()[0] == "�"
    with pytest.raises(TypeError):
        decode.decode_int64(df, "i")
    with pytest.raises(KeyError):
        decode.decode_int32(df, "none")
    assert decode.decode_list(df, "xs", lambda x: x * 2).first()[0] == [2, None]
    assert decode.decode_map(df, "m", F.upper, lambda v: v + 1).first()[0] == {"A": 2}
    with pytest.raises(TypeError):
        decode.decode_list(df, "m")
    pair = spark.createDataFrame([([1, 2, 1], ["a", "b", "c"])], "k array<int>, v array<string>")
    assert pair.select(decode.map_of(F.col("k"), F.col("v"))).first()[0] == {"1": "c", "2": "b"}
    with pytest.raises(Exception, match="as many values"):
        pair.select(decode.map_of(F.col("k"), F.array(F.lit("x")))).collect()
    assert decode.leaves(df.select(decode.struct_of(["i", "s"], ["p", "q"]).alias("t"))).columns == ["t.p", "t.q"]


@pytest.mark.parametrize("codec", list(sink.CODECS))
def test_round_trip(spark, tmp_path, codec):
    path = str(tmp_path / "t")
    df = spark.range(2500).select(F.col("id").cast("int").alias("id"), F.expr("if(id % 7 = 0, null, concat('n', id))").alias("s"), F.expr("map('k', cast(id as string), 'e', null)").alias("m"), F.expr("array(id, null)").alias("xs")).coalesce(1)
    sink.write(df, path, codec)
    assert sorted(map(str, spark.read.parquet(path).collect())) == sorted(map(str, df.collect()))
    assert [r["num_rows"] for r in footer(spark, path, "row_groups").orderBy("row_group").collect()] == [1000, 1000, 500]


def test_sink_rules(spark, tmp_path):
    for bad in ("LZO", "BROTLI"):
        with pytest.raises(ValueError):
            sink.codec(bad)
    need = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("s", T.StringType())])
    with pytest.raises(Exception, match="null in required column"):
        sink.conform(spark.createDataFrame([(None, "a")], "id int, s string"), need).collect()
    with pytest.raises(ValueError):
        sink.conform(spark.createDataFrame([(1,)], "id int"), need)
    with sink.RowWriter(spark, str(tmp_path / "rows"), need, batch=2) as w:
        for i in range(5):
            w.add({"id": i, "s": b"x" if i % 2 else i})
        with pytest.raises(ValueError):
            w.add((1,))
    assert spark.read.parquet(str(tmp_path / "rows")).orderBy("id").collect()[1]["s"] == "x"
    with pytest.raises(ValueError):
        w.add((1, "a"))
    with sink.RowWriter(spark, str(tmp_path / "none"), need):
        pass
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0 and footer(spark, str(tmp_path / "none"), "row_groups").count() == 0
    field, leaves = string_map_column("m")
    assert field.dataType == T.MapType(T.StringType(), T.StringType(), True) and [x.max_def for x in leaves] == [2, 3]
    assert from_leaves("s", leaves).columns[0].name == "m.key_value.key"


def test_reports(spark, kinds, tmp_path, capsys):
    it = report.Inspector(spark, kinds)
    d = it.as_dict()
    assert set(d) == {"fileInfo", "schema", "rowGroups", "columnChunks", "dataSampling", "statistics"} and d["dataSampling"]["sampledRows"] == 10 and d["rowGroups"]["count"] == 3
    assert json.loads(it.as_json())["fileInfo"]["totalRows"] == 25
    text = it.as_text() + it.summary()
    assert all(h in text for h in report.HEADINGS) and "optional int32 id (maxDef=1, maxRep=0)" in text and "m: MAP<BYTE_ARRAY, BYTE_ARRAY>" in text
    assert "Row Group 2: 5 rows" in it.metadata_text()
    out = io.StringIO()
    report.export_json(spark, kinds, out)
    whole = json.loads(out.getvalue())
    assert len(whole["rows"]) == 25 and whole["rows"][3]["d"] is None and whole["rows"][0]["m"] == {"a": "1", "k": "0"} and whole["metadata"]["columns"][0]["statistics"]["max"] == "9"
    assert main(["inspect", kinds, "--stats-only"], spark) == 0 and "Average Row Size" in capsys.readouterr().out
    assert main(["inspect", kinds, "--json"], spark) == 0 and main(["rows", kinds, "-n", "2"], spark) == 0
    assert main(["json", kinds, str(tmp_path / "o.json")], spark) == 0 and json.load(open(tmp_path / "o.json"))["metadata"]["numRows"] == 25
    report.export_json_lines(Table.open(spark, kinds), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 25
    assert list_files(spark, kinds)[0].endswith("kinds.parquet")


def test_formatting():
    assert formatting.value({str(i): i for i in range(7)}).endswith("... (2 more)}") and formatting.value(list(range(12))).endswith("... (2 more)]") and formatting.value("x" * 101).endswith('..."')
    assert formatting.value(None) == "NULL" and formatting.value([]) == "[]" and formatting.value(True) == "true"
    assert formatting.statistic(b"", "INT32") == "N/A" and formatting.statistic(b"\x01\x00\x00\x00", "INT32") == "1" and formatting.statistic(b"ab", "BYTE_ARRAY") == '"ab"'
    assert formatting.statistic(bytes(range(128, 148)), "BYTE_ARRAY") == "0x" + bytes(range(128, 144)).hex() + "..." and formatting.statistic(b"\x01", "BOOLEAN") == "true" and formatting.statistic(b"x" * 60, "BYTE_ARRAY").endswith('..."')
    assert formatting.statistic_json(b"\xff", "FIXED_LEN_BYTE_ARRAY") == "0xff" and formatting.statistic_json(None, "INT32") is None


def test_block_statistics(spark):
    rows = spark.range(2500).select("id", F.expr("if(id % 2 = 0, null, id % 5)").alias("v"), F.expr("if(id = 0, null, map('a', 1, 'b', 2))").alias("m"))
    got = statistics.block_statistics(rows, F.col("id")).orderBy("block").collect()
    assert [r["rows"] for r in got] == [1000, 1000, 500] and got[0]["v.nulls"] == 500 and got[0]["v.distinct"] == 5 and got[0]["m.entries"] == 1999 and got[1]["id.min"] == 1000


def test_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (5, "b")], "i int, s string").write.parquet(folder)
    q = matching(stream(spark, folder, T.StructType([T.StructField("i", T.IntegerType()), T.StructField("s", T.StringType())])), gt(I32(3))).writeStream.format("memory").queryName("kept").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from kept").collect()] == [(5, "b")]


def test_footers_in_any_store(spark, tmp_path):
    """A store that only the JVM can open has the same footers as the files themselves."""
    from parqyard.sources.footer import SCHEMAS, footer, tail

    spark.range(2500).selectExpr("id", "cast(id as string) as s").repartition(3).write.parquet(str(tmp_path / "t"))
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.kept.link./in", f"file://{tmp_path}")
    for table in SCHEMAS:
        own, far = (footer(spark, p, table).drop("file", "key_values") for p in (str(tmp_path / "t"), "viewfs://kept/in/t"))
        assert sorted(own.collect(), key=str) == sorted(far.collect(), key=str) and own.count() > 0
    assert Table.open(spark, "viewfs://kept/in/t").total_rows() == 2500
    (tmp_path / "bad").write_bytes(b"PAR1 but no footer here")
    with pytest.raises(ValueError, match="no Parquet footer"):
        tail(spark, f"file:{tmp_path}/bad")


def test_row_groups_of_all_files(spark, tmp_path):
    from parqyard.sources.table import row_groups

    spark.range(2500).repartition(2).write.option("parquet.block.row.count.limit", "300").parquet(str(tmp_path / "t"))
    got = row_groups(spark, str(tmp_path / "t"))
    assert sorted(r["id"] for r in got.collect()) == list(range(2500))
    assert {r["row_group"]: r["n"] for r in got.groupBy("row_group").count().withColumnRenamed("count", "n").collect()}[0] == 600


def test_equal_keys_of_long_maps(spark):
    """Of equal keys the last counts; without any, a long map takes linear time."""
    df = spark.range(1).selectExpr("map_from_arrays(sequence(1, 20000), sequence(1, 20000)) as m", "map('a', 1, 'A', 2) as n", "id as k")
    assert decode.decode_map(df, "m", value=lambda v: v + 1).selectExpr("size(m) as n", "m[7] as x").first() == (20000, 8)
    assert decode.decode_map(df, "n", key=F.upper, keep=["k"]).first().asDict() == {"k": 0, "n": {"A": 2}}
