"""Entry point for spark-submit: run registered queries over a folder of tables.

    spark-submit groundwork/cli.py NAME... --data FOLDER [--out FOLDER] [--format parquet|json|csv]
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Sequence

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description="Run registered queries over a folder of tables.")
    out.add_argument("names", nargs="*", help="queries; without any, their names are listed")
    out.add_argument("--data", help="folder of the tables")
    out.add_argument("--out", help="folder to write to, one folder a query; without it, the first rows are shown")
    out.add_argument("--format", default="parquet", choices=("parquet", "json", "csv"))
    out.add_argument("--rows", type=int, default=20, help="rows to show")
    return out


def main(args: Sequence[str] | None = None) -> int:
    told = parser().parse_args(args)
    known = importlib.import_module("__spark_entry__").queries()
    if not told.names:
        print("\n".join(sorted(known)))
        return 0
    if wrong := [n for n in told.names if n not in known]:
        print(f"no such query: {', '.join(wrong)}")
        return 2
    if not told.data:
        print("--data is needed")
        return 2
    spark = SparkSession.builder.appName("groundwork").getOrCreate()
    for name in told.names:
        rows = known[name](spark, told.data)
        if told.out:
            rows.write.mode("overwrite").format(told.format).save(f"{told.out}/{name}")
        else:
            rows.show(told.rows, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
