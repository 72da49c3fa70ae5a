"""Command line: python -m vellumine inspect|extract|convert PATH [--format F] [--pages P] [--out FOLDER]."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from . import api

FORMATS = {"markdown": api.to_markdown, "latex": api.to_latex, "json": api.to_json}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vellumine", description="Documents to blocks, Markdown, LaTeX or JSON.")
    p.add_argument("command", choices=("inspect", "extract", "convert"), help="formats and sizes; blocks; one text a file")
    p.add_argument("path", help="a file or a folder that Spark can read")
    p.add_argument("--format", choices=sorted(FORMATS), default="markdown", help="of convert")
    p.add_argument("--pages", help='such as "45", "43-45" or "1,5,9-12"')
    p.add_argument("--out", help="folder for Parquet; without it rows are printed as JSON lines")
    return p


def result(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.command == "inspect":
        return api.inspect(spark, args.path)
    blocks = api.read_documents(spark, args.path)
    if args.pages:
        blocks = api.only_pages(blocks, args.pages)
    return blocks if args.command == "extract" else FORMATS[args.format](blocks)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    rows = result(SparkSession.builder.appName("vellumine").getOrCreate(), args)
    if args.out:
        rows.write.mode("errorifexists").parquet(args.out)
        return
    for line in rows.toJSON().toLocalIterator():  # a partition at a time
        print(line)


if __name__ == "__main__":
    main()
