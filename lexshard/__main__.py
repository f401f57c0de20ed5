"""python -m lexshard inspect <shard>: print a shard's summary."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .plans.summary import shard_report


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] != "inspect":
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("lexshard inspect").getOrCreate()
    print(shard_report(spark, args[1]))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
