"""python -m kindred: list and run queries, run a linkage from a configuration, profile a table."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kindred", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("query", help="run a query over a folder of tables")
    run.add_argument("name")
    run.add_argument("data")
    link = commands.add_parser("link", help="block, score and cluster a table as a configuration says")
    link.add_argument("config", help="a JSON or YAML file")
    link.add_argument("table")
    check = commands.add_parser("check", help="say what is wrong with a configuration")
    check.add_argument("config")
    profile = commands.add_parser("profile", help="profile columns of a table")
    profile.add_argument("table")
    profile.add_argument("columns", nargs="+")
    for c in (run, link, profile):
        c.add_argument("--out", help="a folder for the result; without one twenty rows are shown")
    for c in (link, profile):
        c.add_argument("--format", default="parquet", help="the table's format")
    return top


def _give(df, out: str | None) -> None:
    if out:
        df.write.mode("overwrite").parquet(out)
    else:
        df.show(20, truncate=False)


def main(arguments: list[str] | None = None) -> int:
    from .operators import profile
    from .plans import pipeline
    from .queries import queries
    from .sources import readers

    a = parser().parse_args(arguments)
    if a.command == "list":
        print("\n".join(sorted(queries())))
        return 0
    if a.command == "check":
        try:
            pipeline.Config.from_text(Path(a.config).read_text())
        except (TypeError, ValueError) as e:
            print(e)
            return 1
        return 0
    spark = SparkSession.builder.appName(f"kindred {a.command}").getOrCreate()
    if a.command == "query":
        if a.name not in queries():
            print(f"no query {a.name}")
            return 1
        _give(queries()[a.name](spark, a.data), a.out)
        return 0
    table = readers.read_table(spark, a.table, a.format)
    if a.command == "profile":
        _give(profile.field_profile(table, a.columns), a.out)
        return 0
    found = pipeline.run(table, pipeline.Config.from_text(Path(a.config).read_text()))
    for name in ("edges", "members", "quality", "golden"):
        df = getattr(found, name)
        if df is not None:
            _give(df, f"{a.out}/{name}" if a.out else None)
    print(json.dumps(found.metrics()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
