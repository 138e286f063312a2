"""``python -m quillspan QUERY FOLDER [--out PATH] [--format parquet|csv|json] [--explain]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> None:
    from quillspan.plans import registry
    from quillspan.session import ship

    p = argparse.ArgumentParser(prog="quillspan", description="Run a query of the register over a folder of Parquet tables.")
    p.add_argument("query", help="a query's name, or 'list'")
    p.add_argument("folder", nargs="?", help="the folder of the tables")
    p.add_argument("--out", help="where to write; without it the first rows are shown")
    p.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"))
    p.add_argument("--explain", action="store_true", help="show the plan in place of running it")
    o = p.parse_args(args)
    found = dict(registry.QUERIES)
    if o.query == "list":
        print("\n".join(sorted(found)))
        return
    if o.query not in found or not o.folder:
        p.error("no such query" if o.query not in found else "a folder is needed")
    spark = SparkSession.builder.appName("quillspan").getOrCreate()
    ship(spark)
    df = found[o.query](spark, o.folder)
    if o.explain:
        df.explain("formatted")
    elif o.out:
        df.write.mode("overwrite").format(o.format).option("header", True).save(o.out)
    else:
        df.show(40, truncate=80)


if __name__ == "__main__":
    main()
