"""Indexes a source tree: python -m lodestone ROOT OUT [fixed]."""

import sys

from pyspark.sql import SparkSession

from lodestone.plans.catalog import CodeCatalog


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    catalog = CodeCatalog.index(spark, args[0], "fixed" if "fixed" in args[2:] else "semantic").save(args[1])
    for r in catalog.counts().collect():
        print(f"{r['relation']:<16}{r['n']:>10}")
    print(f"{'chunks':<16}{catalog.chunks.count():>10}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
