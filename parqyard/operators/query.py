"""A table with filters, projections, limits, counts and rows; all lazy until counted or read."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as P
from ..schema import Logical, Schema, logical_of
from ..sources import table as source
from ..sources.footer import footer
from .predicates import Predicate, Result, compile_all, compile_any


class RowView:
    """One row: values by place, by exact name, or with a type to hold them to."""

    def __init__(self, values: Sequence[Any], schema: Schema):
        self.values, self.schema = values, schema

    def __getitem__(self, at: int | str) -> Any:
        if isinstance(at, int):
            if not 0 <= at < len(self.values):
                raise IndexError(f"no column {at}")
            return self.values[at]
        i = self.schema.by_name.get(at)
        if i is None:
            raise KeyError(f"no column {at!r}")
        return self.values[i]

    def get(self, at: int | str, kind: str) -> Any:
        """The value of a primitive column of that kind; TypeError for another, never a conversion."""
        c = self.schema.column(at)
        if c is None:
            raise KeyError(f"no column {at!r}")
        if c.category != P.PRIMITIVE or P.kind_of(c.data_type) != kind:
            raise TypeError(f"{c.name} holds {c.kind or c.category}, not {kind}")
        return self[at]

    def __len__(self) -> int:
        return len(self.values)

    def __repr__(self) -> str:
        return "Row{" + ", ".join(f"{c.name}={v}" for c, v in zip(self.schema.columns, self.values)) + "}"


class Rows(Iterator[RowView]):
    """Rows with a look ahead: has_next may be asked any number of times."""

    def __init__(self, rows: Iterator[Row], schema: Schema):
        self._rows, self.schema, self._held = rows, schema, []

    def has_next(self) -> bool:
        if not self._held:
            row = next(self._rows, None)
            if row is None:
                return False
            self._held.append(RowView(tuple(row)[: len(self.schema.columns)], self.schema))
        return True

    def __next__(self) -> RowView:
        if not self.has_next():
            raise StopIteration
        return self._held.pop()


@dataclass(frozen=True)
class Table:
    df: DataFrame
    schema: Schema
    path: str | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, view: str = "physical", order: bool = False) -> Table:
        """A table by its path. With `order`, rows come in the order of files and of rows in them."""
        df, schema = source.read(spark, path, view, order)
        return cls(df, schema, path)

    @classmethod
    def of(cls, df: DataFrame) -> Table:
        """Any DataFrame, with its own columns as logical columns."""
        return cls(df, logical_of(df.schema))

    def _where(self, condition: Result) -> Table:
        if condition is True:
            return self
        return replace(self, df=self.df.filter(F.lit(False) if condition is False else condition))

    def filter(self, *predicates: Predicate) -> Table:
        """Rows for which every predicate is met by some column, not necessarily the same."""
        return self._where(compile_all(predicates, self.schema.columns))

    def matches(self, *predicates: Predicate) -> Table:
        """All rows, with `matches` telling whether filter() would let each through."""
        condition = compile_all(predicates, self.schema.columns)
        flag = F.lit(condition) if isinstance(condition, bool) else F.coalesce(condition, F.lit(False))
        return replace(self, df=self.df.withColumn("matches", flag))

    def any_column(self, predicate: Predicate) -> Table:
        return self._where(compile_any(predicate, self.schema.columns))

    def select(self, *names: str | int) -> Table:
        """The given columns only, by name or place; filters then see no others."""
        chosen = []
        for n in names:
            c = self.schema.column(n)
            if c is None:
                raise KeyError(f"no column {n!r}")
            chosen.append(c)
        order = [c for c in source.ORDER if c in self.df.columns]
        return Table(self.df.select(*[c.column() for c in chosen], *order), Schema(self.schema.name, self.schema.leaves, tuple(chosen)), self.path)

    def limit(self, n: int) -> Table:
        """The first n rows: in the order of the file if it was asked for."""
        return replace(self, df=self._ordered().limit(n))

    def tail(self, n: int) -> Table:
        """The last n rows in the order of the file, which open() must have been asked for."""
        by = [F.col(c).desc() for c in source.ORDER if c in self.df.columns]
        if not by:
            raise ValueError("open the table with order=True")
        return replace(self, df=self.df.orderBy(*by).limit(n))

    def _ordered(self) -> DataFrame:
        by = [c for c in source.ORDER if c in self.df.columns]
        return self.df.orderBy(*by) if by else self.df

    def count(self) -> int:
        """Rows that pass the filters so far."""
        return self.df.count()

    def total_rows(self) -> int:
        """Rows of the files, before any filter, from their footers."""
        if self.path is None:
            return self.df.count()
        return footer(self.df.sparkSession, self.path, "files").agg(F.coalesce(F.sum("num_rows"), F.lit(0))).first()[0]

    def rows(self) -> Rows:
        """The rows one by one on the driver, a partition at a time."""
        return Rows(self._ordered().toLocalIterator(), self.schema)

    def columns(self) -> tuple[Logical, ...]:
        return self.schema.columns

    def column(self, name: str, kind: type[T.DataType] | str) -> DataFrame:
        """One column, of exactly that type; see functions.decode."""
        from ..functions.decode import typed

        return typed(self.df, name, kind)
