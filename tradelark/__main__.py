"""python -m tradelark --out FOLDER --input customers=PATH --input orders=PATH ..."""

from __future__ import annotations

import argparse

from tradelark.contract import TABLES
from tradelark.plans.refresh import Refresh
from tradelark.session import build_session


def main() -> None:
    parser = argparse.ArgumentParser(prog="tradelark", description="Build every table from raw CSV files.")
    parser.add_argument("--out", required=True, help="folder for the written tables")
    parser.add_argument("--folder", help="folder with one <table>.csv per table")
    parser.add_argument("--input", action="append", default=[], metavar="TABLE=PATH", help="file of one table")
    parser.add_argument("--reports", default="parquet", choices=["parquet", "csv"], help="format of the reports")
    parser.add_argument("--master", help="Spark master, when not set by spark-submit")
    options = parser.parse_args()

    paths = {table: f"{options.folder}/{table}.csv" for table in TABLES} if options.folder else {}
    paths.update(dict(pair.split("=", 1) for pair in options.input))
    spark = build_session(master=options.master)
    Refresh(spark, options.out, report_format=options.reports).run(paths)
    spark.stop()


if __name__ == "__main__":
    main()
