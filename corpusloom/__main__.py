"""python -m corpusloom list | run QUERY FOLDER OUT | stage NAME CONFIG: registered queries over a folder of tables, and stages from files to files."""

from __future__ import annotations

import argparse

from corpusloom.plans.catalogue import ORACLES, QUERIES
from corpusloom.plans.stages import STAGES
from corpusloom.sources.records import load_config


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list")
    run = verbs.add_parser("run")
    run.add_argument("query", choices=sorted(QUERIES))
    run.add_argument("folder")
    run.add_argument("out")
    step = verbs.add_parser("stage")
    step.add_argument("name", choices=sorted(STAGES))
    step.add_argument("config")
    a = parser.parse_args(argv)
    if a.verb == "list":
        print("\n".join(f"{n}{'' if n in ORACLES else ' (no SQL)'}" for n in QUERIES))
        return
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    if a.verb == "stage":
        STAGES[a.name](spark, load_config(a.config))
        return
    QUERIES[a.query](spark, a.folder).write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
