"""The row group scan covers every file of the table."""

from parqyard.plans import catalogue


def test_row_group_scan_of_several_files(spark, tmp_path):
    spark.range(30).selectExpr("id as c_custkey", "concat('c', id) as c_name").repartition(3).write.parquet(str(tmp_path / "customer.parquet"))
    got = catalogue.queries()["row_group_scan"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(i, f"c{i}") for i in range(30)]
