"""The filter algebra on single values: one-row tables, one assertion each."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parqyard import F32, F64, I32, I64, Bool, Str, Table, all_of, any_of, contains, custom, eq, gt, gte, is_not_null, is_null, lt, lte, named, neq, predicate, prefix, suffix

TYPES = {
    "i": T.IntegerType(), "l": T.LongType(), "f": T.FloatType(), "d": T.DoubleType(), "s": T.StringType(), "b": T.BooleanType(),
    "xs": T.ArrayType(T.IntegerType()), "ss": T.ArrayType(T.StringType()), "m": T.MapType(T.StringType(), T.StringType()),
}

CASES = [
    # eq: exact kind, null never
    ("i", 4, eq(I32(4)), True), ("i", 4, eq(I64(4)), False), ("l", 4, eq(I64(4)), True), ("l", 4, eq(I32(4)), False), ("i", 5, eq(I32(4)), False),
    ("f", 1.5, eq(F32(1.5)), True), ("f", 1.5, eq(F64(1.5)), False), ("d", 1.5, eq(F64(1.5)), True), ("f", 3.14, eq(F32(3.14)), True), ("s", "a", eq("a"), True), ("s", "A", eq("a"), False),
    ("s", "", eq(""), True), ("b", True, eq(True), True), ("b", False, eq(Bool(True)), False), ("i", None, eq(I32(4)), False), ("i", None, eq(None), False), ("s", "x", eq(None), False),
    ("s", "1", eq(I32(1)), False), ("d", float("nan"), eq(F64(float("nan"))), True),
    # neq: null matches any value but null; another kind always differs
    ("i", 5, neq(I32(4)), True), ("i", 4, neq(I32(4)), False), ("i", None, neq(I32(4)), True), ("i", None, neq(None), False), ("i", 4, neq(None), True), ("i", 4, neq(I64(4)), True), ("s", "4", neq(I32(4)), True),
    # order: null and other kinds never
    ("i", 3, lt(I32(4)), True), ("i", 4, lt(I32(4)), False), ("i", 4, lte(I32(4)), True), ("i", 5, gt(I32(4)), True), ("i", 4, gt(I32(4)), False), ("i", 4, gte(I32(4)), True), ("i", None, lt(I32(4)), False),
    ("i", 3, lt(I64(4)), False), ("l", 3, lt(F64(4)), False), ("s", "apple", lt("banana"), True), ("s", "b", gte("b"), True), ("d", 2.5, gt(F64(2.4)), True), ("b", True, gt(False), True), ("xs", [1], lt(I32(4)), False),
    ("m", {"a": "1"}, gt("0"), False), ("i", 2147483647, gt(I32(2147483647)), False),
    # strings
    ("s", "hello world", contains("lo w"), True), ("s", "hello", contains("HE"), False), ("s", None, contains("a"), False), ("s", "abc", contains(""), True), ("i", 12, contains("1"), False), ("s", "12", contains(I32(1)), False),
    ("s", "hello", prefix("he"), True), ("s", "hello", prefix("el"), False), ("s", "hello", prefix(""), True), ("s", None, prefix(""), False), ("s", "a", prefix("ab"), False), ("i", 12, prefix("1"), False),
    ("s", "hello", suffix("lo"), True), ("s", "hello", suffix("hel"), False), ("s", "x%", suffix("%"), True), ("s", "a_b", contains("_"), True), ("s", "héllo", prefix("hé"), True),
    # nulls: empty is not null
    ("s", None, is_null(), True), ("s", "", is_null(), False), ("i", 0, is_null(), False), ("xs", [], is_null(), False), ("m", {}, is_null(), False), ("xs", None, is_null(), True), ("m", None, is_not_null(), False), ("s", "", is_not_null(), True),
    # lists
    ("xs", [1, 2], eq([I32(1), I32(2)]), True), ("xs", [1, 2], eq([I32(2), I32(1)]), False), ("xs", [1, None], eq([I32(1), None]), True), ("xs", [1], eq([I64(1)]), False), ("xs", [], eq([]), True), ("xs", None, eq([]), False),
    ("xs", [1, 2], contains(I32(2)), True), ("xs", [1, None], contains(I32(2)), False), ("xs", [1, 2], contains(I64(2)), False), ("ss", ["a"], contains("a"), True), ("xs", None, contains(I32(1)), False), ("xs", [1], neq([I32(1)]), False),
    ("xs", [1], neq([I32(2)]), True), ("xs", None, neq([I32(2)]), True), ("xs", [1], neq(I32(1)), True), ("xs", [1], eq(I32(1)), False), ("xs", [None], neq([None]), False),
    # maps
    ("m", {"a": "1", "b": "2"}, eq({"b": "2", "a": "1"}), True), ("m", {"a": "1"}, eq({"a": "2"}), False), ("m", {"a": None}, eq({"a": None}), True), ("m", {}, eq({}), True), ("m", None, eq({}), False), ("m", {"a": "1"}, neq({"a": "1"}), False),
    ("m", {"a": "1"}, neq({"a": "2"}), True), ("m", None, neq({"a": "2"}), True), ("m", {"a": "1"}, contains("a"), False), ("m", {"a": "1"}, eq("a"), False), ("m", {"a": "1"}, neq("a"), True), ("m", {"a": "1"}, eq({"a": I32(1)}), False),
    # sets look at one column
    ("i", 5, all_of(gt(I32(3)), lt(I32(6))), True), ("i", 7, all_of(gt(I32(3)), lt(I32(6))), False), ("i", 7, any_of(lt(I32(3)), gt(I32(6))), True), ("i", 5, any_of(lt(I32(3)), gt(I32(6))), False), ("i", 1, all_of(), True), ("i", 1, any_of(), False),
    ("i", 5, all_of(any_of(eq(I32(5)), eq(I32(6))), neq(I32(6))), True), ("i", None, all_of(neq(I32(1)), is_null()), True), ("s", "ab", all_of(prefix("a"), suffix("b"), contains("ab")), True),
    # named and custom
    ("i", 5, named("i", eq(I32(5))), True), ("i", 5, named("I", eq(I32(5))), False), ("s", "abc", custom(lambda info, c: F.length(c) == 3), True), ("i", 5, custom(lambda info, c: info.kind == "INT64"), False),
]


def test_cases(spark):
    """All cases in one job: a column for each."""
    wrong, parts = [], []
    for kind, value, p, _ in CASES:
        parts.append((kind, value, p))
    by_kind = {}
    for i, (kind, value, p) in enumerate(parts):
        by_kind.setdefault((kind, repr(value)), (kind, value, []))[2].append((i, p))
    for kind, value, ps in by_kind.values():
        df = spark.createDataFrame([(value,)], T.StructType([T.StructField(kind, TYPES[kind])]))
        table = Table.of(df)
        flags = df
        for i, p in ps:
            got = p.on(table.schema.columns[0])
            flags = flags.withColumn(f"r{i}", F.lit(got) if isinstance(got, bool) else F.coalesce(got, F.lit(False)))
        row = flags.first()
        wrong += [CASES[i] for i, _ in ps if row[f"r{i}"] is not CASES[i][3]]
    assert not wrong


def test_factory_errors():
    for op, value in (("lt", None), ("gte", [F64(1.0)]), ("prefix", None), ("suffix", 1.5), ("prefix", I32(1)), ("near", 1.0), ("eq", 4)):
        with pytest.raises(ValueError):
            predicate(op, value)
    for bad in (1 << 31, True, 1.5):
        with pytest.raises(ValueError):
            I32(bad)


def test_any_column_against_set(spark):
    """An array of filters may be met by different columns, a set only by one."""
    df = spark.createDataFrame([(50.0, 0.001), (50.0, 30.0), (1.0, 0.001)], "a double, b double")
    t = Table.of(df)
    assert t.filter(gt(F64(40.0)), lt(F64(0.01))).count() == 1
    assert t.filter(all_of(gt(F64(40.0)), lt(F64(0.01)))).count() == 0
    assert t.filter().count() == 3
    assert [r["matches"] for r in t.matches(gt(F64(40.0))).df.collect()] == [True, True, False]


def test_pushdown(spark, tmp_path):
    """Comparisons reach the scan, and legs of other kinds leave no trace."""
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 2.0)], "i int, s string, d double").write.parquet(path)
    plan = Table.open(spark, path).filter(gt(I32(3)), neq("x")).df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(i,3)" in plan
    plan = Table.open(spark, path).select("s").filter(prefix("a")).df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(s,a)" in plan and "ReadSchema: struct<s:string>" in plan
