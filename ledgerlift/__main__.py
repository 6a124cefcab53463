"""Command line: python -m ledgerlift [--config FILE] --roster FILE (--documents DIR | --files DIR) --output PATH --report PATH --work DIR [--year ...] [--force].

With --documents, DIR holds the tables documents, pages and words as Parquet. With --files, DIR holds document files, which
are read by the plug-in that the configuration names (reader: module:function); what has been read is kept below the work folder. The
roster is CSV, Parquet or a workbook. All paths but the configuration's may lie in any store that Spark reads."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .operators.report import summary, write_report
from .plans.pipeline import Tables, read_files, run
from .sources import config, roster


def parsed(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="ledgerlift", description="Fill a roster of companies with figures from their statements.")
    for name in ("config", "roster", "output", "report", "work"):
        parser.add_argument(f"--{name}", required=name != "config")
    given = parser.add_mutually_exclusive_group(required=True)
    given.add_argument("--documents", help="folder of tables that have been read")
    given.add_argument("--files", help="folder of document files")
    parser.add_argument("--year", choices=("current", "previous"), help="column to read, over the configuration's")
    parser.add_argument("--force", action="store_true", default=None, help="overwrite cells that hold values")
    return parser.parse_args(argv)


def plug_in(name: str | None):
    """The reader that a configuration names as module:function."""
    if not name or ":" not in name:
        raise ValueError("the configuration must name a reader of files, as module:function")
    module, function = name.split(":", 1)
    return getattr(importlib.import_module(module), function)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parsed(argv)
    try:
        overrides = {"year_preference": given.year, "overwrite_nonempty": given.force}
        settings = config.load(given.config, **overrides) if given.config else config.settings(overrides)
        spark = spark or SparkSession.builder.appName("ledgerlift").getOrCreate()
        sheet = roster.sheet(spark, given.roster)
        if given.files:
            tables = read_files(spark, given.files, plug_in(settings.options.get("reader")), settings, given.work)
        else:
            tables = Tables(*(spark.read.parquet(f"{given.documents}/{name}") for name in ("documents", "pages", "words")), None)
        done = run(roster.from_table(sheet), *tables[:3], config=settings, work=given.work, failures=tables.failures)
    except (OSError, ValueError, ImportError, AttributeError) as error:
        print(error, file=sys.stderr)
        return 2
    roster.write(roster.filled(sheet, done.roster), given.output)
    write_report(done.report, given.report)
    print(summary(done.counters.first().asDict()))
    done.unclassified.write.mode("overwrite").csv(f"{given.work}/unclassified", header=True)
    if unknown := done.unclassified.count():
        print(f"No company is told in {unknown} files, listed in {given.work}/unclassified", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
