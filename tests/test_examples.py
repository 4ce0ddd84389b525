"""The examples, the profile and the generated test of a table."""

import importlib.util
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from parqyard.cli import main
from parqyard.plans.template import test_source as source_of


def _example(name: str):
    spec = importlib.util.spec_from_file_location(name, Path(__file__).parent.parent / "examples" / f"{name}.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    t = pa.table(
        {
            "id": pa.array([1, 2, 3], pa.int32()), "x": pa.array([float("nan"), 0.5, None]), "s": ["it's \"a\"\n", None, "c"], "b": pa.array([b"\xff", b"", None]), "ok": [True, None, False],
            "m": pa.array([[("k", "1"), ("l", None)], [], None], pa.map_(pa.string(), pa.string())), "xs": pa.array([[1, None], [], None], pa.list_(pa.int32())),
        }
    )
    path = str(tmp_path_factory.mktemp("t") / "a small-table.parquet")
    pq.write_table(t, path)
    pq.write_table(t.slice(0, 0), f"{path}.empty.parquet")
    return path


def test_examples(spark, small, capsys):
    _example("rows").main(small, 2, spark)
    out = capsys.readouterr().out
    assert "3 rows of" in out and out.count("Row{") == 2 and "Row{id=2," in out
    _example("maps").main(small, 3, spark)
    out = capsys.readouterr().out
    assert "row 0, m: 2 entries" in out and "k = 1" in out and "l = None" in out and "row 2, m: null" in out and "m: 2 entries in 3 rows" in out


def test_generated_test_holds_the_table(spark, small, capsys):
    for path, rows in ((small, 3), (f"{small}.empty.parquet", 0)):
        source = source_of(spark, path)
        assert f"total_rows() == {rows}" in source and ("first" in source) == (rows > 0)
        space: dict = {}
        exec(source, space)
        made = [f for k, f in space.items() if k.startswith("test_")]
        made[0](spark)
    wrong = source_of(spark, small).replace("first[0] == 1", "first[0] == 2")
    exec(wrong, space := {})
    with pytest.raises(AssertionError):
        next(f for k, f in space.items() if k.startswith("test_"))(spark)
    assert main(["template", small], spark) == 0 and "def test_a_small_table(spark)" in capsys.readouterr().out


def test_profile(spark, small, capsys):
    assert main(["profile", small, "-n", "1"], spark) == 0
    out = capsys.readouterr().out
    assert "Rows: 3" in out and out.count("Row{") == 2 and out.index("Row{id=1,") < out.index("Row{id=3,") and "distinct=3" in out
