"""Filters over many small row groups read about what the files hold."""

import os

from parqyard import I64, Table, eq, gt, named
from parqyard.sources import footer, sink
from parqyard.types import Bool


def bytes_read(spark):
    done = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(done.apply(i).totalInputBytes() for i in range(done.size()))


def test_filter_reads_small_groups_once(spark, tmp_path):
    rows = spark.range(0, 30000, 1, 2).selectExpr("id", "id % 7 as k", "id % 3 = 0 as high")
    for n in (1, 2):  # files
        path = f"{tmp_path}/{n}"
        sink.write(rows.coalesce(n), path, group_rows=20)
        size = sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".parquet"))
        t = Table.open(spark, path)
        for p, want in ((eq(Bool(True)), 10000), (named("id", gt(I64(29989))), 10), (named("k", eq(I64(7))), 0)):
            before = bytes_read(spark)
            assert t.filter(p).df.agg({"id": "count"}).first()[0] == want
            assert bytes_read(spark) - before < 4 * size, (n, p)


def test_page_index_stays_for_large_groups(spark, tmp_path):
    rows = spark.range(0, 400_000, 1, 2).selectExpr("id", "uuid() as s")
    for n in (1, 2):
        for group_rows, short in ((None, False), (1000, True)):
            path = f"{tmp_path}/{n}-{group_rows}"
            sink.write(rows.coalesce(n), path, group_rows=group_rows)
            files = footer.list_files(spark, path)
            assert footer.traits(spark, path, files[0] if n == 1 else None) == (False, short)
            assert Table.open(spark, path).filter(named("id", gt(I64(399_989)))).count() == 10
