"""python -m strata.cli check|inspect|backup|restore DIR [TARGET]"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from strata.schema import StrataError
from strata.sources.store import Store


def run(args: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strata", description="Operations on a store.")
    parser.add_argument("command", choices=["check", "inspect", "backup", "restore"])
    parser.add_argument("store")
    parser.add_argument("target", nargs="?")
    given = parser.parse_args(args)
    if (given.command in ("backup", "restore")) != (given.target is not None):
        parser.error("backup and restore take a target, the others do not")
    spark = spark or SparkSession.builder.appName("strata").getOrCreate()
    try:
        with Store(spark, given.store) as store:
            if given.command == "check":
                out = store.check_integrity()
            elif given.command == "inspect":
                out = store.stats()
            else:  # a restore is a backup of the backup
                store.backup(given.target)
                out = {"written": given.target}
        print(json.dumps(out, default=str))
        return 0
    except StrataError as e:
        print(json.dumps({"error": type(e).__name__, "message": str(e)}), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
