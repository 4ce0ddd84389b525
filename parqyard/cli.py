"""Command line: inspect a file, export it as JSON, show its first rows, profile its columns, or write a test of it.

python -m parqyard.cli inspect FILE [--stats-only | --json | --json-pretty]
python -m parqyard.cli json FILE [OUT]
python -m parqyard.cli rows FILE [-n N]
python -m parqyard.cli profile FILE [-n N]
python -m parqyard.cli template FILE
"""

from __future__ import annotations

import argparse
import sys


def main(args: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser("parqyard", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("inspect")
    one.add_argument("file")
    how = one.add_mutually_exclusive_group()
    for flag in ("--stats-only", "--json", "--json-pretty"):
        how.add_argument(flag, action="store_true")
    two = commands.add_parser("json")
    two.add_argument("file")
    two.add_argument("out", nargs="?")
    three = commands.add_parser("rows")
    three.add_argument("file")
    three.add_argument("-n", type=int, default=10)
    four = commands.add_parser("profile")
    four.add_argument("file")
    four.add_argument("-n", type=int, default=10)
    commands.add_parser("template").add_argument("file")
    got = parser.parse_args(args)

    from pyspark.sql import SparkSession

    from .operators.query import Table
    from .plans import report, template

    spark = spark or SparkSession.builder.appName("parqyard").getOrCreate()
    try:
        if got.command == "inspect":
            it = report.Inspector(spark, got.file)
            print(it.summary() if got.stats_only else it.as_json(got.json_pretty) if got.json or got.json_pretty else f"{it.as_text()}\n{it.summary()}")
        elif got.command == "json":
            if got.out:
                with open(got.out, "w", encoding="utf-8") as to:
                    report.export_json(spark, got.file, to)
            else:
                report.export_json(spark, got.file, sys.stdout)
        elif got.command == "profile":
            table = Table.open(spark, got.file, order=True)
            print("Columns:", *table.columns(), sep="\n  ")
            print(f"Rows: {table.total_rows()}\nProfile:")
            for p in report.profile(Table.open(spark, got.file).df).collect():  # a row for each column
                print("  " + ", ".join(f"{k}={v}" for k, v in p.asDict().items()))
            print("First rows:", *table.limit(got.n).rows(), sep="\n  ")
            print("Last rows:", *reversed([*table.tail(got.n).rows()]), sep="\n  ")
        elif got.command == "template":
            print(template.test_source(spark, got.file), end="")
        else:
            for row in Table.open(spark, got.file, order=True).limit(got.n).rows():
                print(row)
    except (OSError, ValueError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
