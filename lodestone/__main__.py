"""python -m lodestone list | methods | run QUERY FOLDER [OUT]: the queries, the searches, one query over a folder of tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lodestone import catalog
from lodestone.plans import registry, search  # noqa: F401


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone")
    sub = parser.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    sub.add_parser("methods")
    run = sub.add_parser("run")
    run.add_argument("query", choices=sorted(catalog.QUERIES))
    run.add_argument("folder")
    run.add_argument("out", nargs="?")
    args = parser.parse_args(argv)
    if args.what == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if args.what == "methods":
        registry.listing(spark).show(truncate=False)
    else:
        found = catalog.QUERIES[args.query](spark, args.folder)
        if args.out:
            found.write.parquet(args.out)
        else:
            found.show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
