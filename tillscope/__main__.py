"""Load the standard data set, then run reports on it, from the command line.

    python -m tillscope load ROOT [--customers N] [--orders N]
    python -m tillscope run ROOT NAME... --as-of YYYY-MM-DD [--out DIR]
    python -m tillscope list
"""

from __future__ import annotations

import argparse
from datetime import date
from inspect import signature

from pyspark.sql import SparkSession

from tillscope.catalog import OPERATORS, run
from tillscope.operators.counts import g7_row_counts
from tillscope.session import durable, prepare
from tillscope.sources.generate import CUSTOMERS, ORDERS, gen_model
from tillscope.sources.tables import read_tables, write_tables


def _arguments(words: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tillscope")
    commands = parser.add_subparsers(dest="command", required=True)
    load = commands.add_parser("load", help="generate the six tables and write them")
    load.add_argument("root")
    load.add_argument("--customers", type=int, default=CUSTOMERS)
    load.add_argument("--orders", type=int, default=ORDERS)
    report = commands.add_parser("run", help="run reports on written tables")
    report.add_argument("root")
    report.add_argument("names", nargs="+", choices=OPERATORS, metavar="NAME")
    report.add_argument("--as-of", type=date.fromisoformat, required=True)
    report.add_argument("--out", help="write Parquet here instead of printing every row")
    report.add_argument(
        "--unordered", action="store_true", help="write listings without their order, which saves a sort"
    )
    commands.add_parser("list", help="list the reports")
    return parser.parse_args(words)


def main(words: list[str] | None = None) -> None:
    arguments = _arguments(words)
    if arguments.command == "list":
        print("\n".join(OPERATORS))
        return
    spark = prepare(SparkSession.builder.appName("tillscope").getOrCreate())
    if arguments.command == "load":
        write_tables(gen_model(spark, arguments.customers, arguments.orders), arguments.root)
        g7_row_counts(read_tables(spark, arguments.root)).show()
        return
    model = read_tables(spark, arguments.root)
    listings = [n for n in arguments.names if "ordered" in signature(OPERATORS[n]).parameters]
    if listings and not arguments.out:
        raise SystemExit(f"as large as the tables, so --out is needed: {', '.join(listings)}")
    for name in arguments.names:
        if arguments.out:
            frame = run(model, name, as_of=arguments.as_of, ordered=not arguments.unordered)
            frame.write.mode("overwrite").parquet(f"{arguments.out}/{name}")
        else:
            print(name)
            report = durable(run(model, name, as_of=arguments.as_of))
            report.show(max(1, report.count()), truncate=False)


if __name__ == "__main__":
    main()
