"""Shows a table's columns and its first rows, one by one.

python examples/rows.py FILE [N]
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from parqyard import Table


def main(path: str, n: int = 10, spark: SparkSession | None = None) -> None:
    table = Table.open(spark or SparkSession.builder.appName("rows").getOrCreate(), path, order=True)
    print(f"{table.total_rows()} rows of", *table.columns(), sep="\n  ")
    for row in table.limit(n).rows():
        print(row)


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:3]))
