"""Every catalogue query against its SQL, at the smallest scale."""

import os

import pytest

from parqyard.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
def test_queries_match_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    wrong = []
    for name, run in catalogue.queries().items():
        run(spark, DIR).coalesce(1).write.parquet(str(tmp_path / name))
        sql = catalogue.oracle_sql().get(name)
        if sql is None:
            continue
        ours, theirs = db.execute(f"select * from read_parquet('{tmp_path / name}/*.parquet')").df(), db.execute(sql).df()
        columns = sorted(theirs.columns)
        a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) if sorted(x.columns) == columns else x for x in (ours, theirs))
        if not a.equals(b):
            wrong.append(name)
    assert not wrong


def test_entry(spark):
    import __spark_entry__

    if os.path.isdir(DIR):
        assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
