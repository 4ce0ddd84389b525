"""Shows the entries of the map columns in a table's first rows, and how many entries each column has in all.

python examples/maps.py FILE [N]
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from parqyard import Table
from parqyard import types as P


def main(path: str, n: int = 10, spark: SparkSession | None = None) -> None:
    table = Table.open(spark or SparkSession.builder.appName("maps").getOrCreate(), path, order=True)
    maps = [c for c in table.columns() if c.category == P.MAP]
    print("Map columns:", *maps, sep="\n  ")
    for i, row in enumerate(table.limit(n).rows()):
        for c in maps:
            held = row[c.name]
            print(f"row {i}, {c.name}: {'null' if held is None else f'{len(held)} entries'}")
            for key, value in (held or {}).items():
                print(f"    {key} = {value}")
    if maps:
        total = table.df.agg(*[F.coalesce(F.sum(F.greatest(F.size(c.column()), F.lit(0))), F.lit(0)) for c in maps]).first()
        print(*[f"{c.name}: {k} entries in {table.total_rows()} rows" for c, k in zip(maps, total)], sep="\n")


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:3]))
