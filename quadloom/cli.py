"""Command line: python -m quadloom.cli [--data FILE ...] [--format csv|tsv|json|nq] QUERY"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from quadloom.engine import Engine
from quadloom.sources import rdf


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quadloom")
    parser.add_argument("query")
    parser.add_argument("--data", action="append", required=True, help="N-Triples or N-Quads file")
    parser.add_argument("--format", choices=["csv", "tsv", "json", "nq"], default="csv")
    parser.add_argument("--config", help="JSON file of engine options")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quadloom").getOrCreate()
    quads = reduce(DataFrame.unionByName, [rdf.read(spark, path) for path in args.data])
    engine = Engine.from_config(spark, quads, args.config) if args.config else Engine(spark, quads)
    found = engine.query(args.query)
    if isinstance(found, bool):
        print(str(found).lower())
        return 0
    if "s_kind" in found.columns:
        out = rdf.to_lines(found)
    else:
        out = {"csv": rdf.results_csv, "tsv": rdf.results_tsv, "json": rdf.results_json, "nq": rdf.results_tsv}[args.format](found)
        if args.format in ("csv", "tsv"):
            print(("," if args.format == "csv" else "\t").join(found.columns if args.format == "csv" else [f"?{c}" for c in found.columns]))
    for row in out.toLocalIterator():
        print(row[0])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
