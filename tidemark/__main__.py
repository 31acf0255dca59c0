"""The batch workflows from a shell: python -m tidemark prepare|intelligence INPUT OUTPUT [...].

prepare reads posts (a headerless CSV of the fixed schema, or Parquet with tweet_id, text, timestamp and sentiment) and writes
sample, preprocessed and features; lines of a CSV that don't fit go to OUTPUT/rejects. intelligence reads posts as Parquet and
a dictionary as JSON, and writes every table of the workflow. Spark's settings are those of spark-submit.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidemark.operators import entity
from tidemark.plans import workflows
from tidemark.sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    jobs = top.add_subparsers(dest="job", required=True)
    prepare = jobs.add_parser("prepare", help="quality, sample, preprocessing and features of posts")
    prepare.add_argument("--format", choices=("csv", "parquet"), default="parquet")
    prepare.add_argument("--fraction", type=float, help="a balanced sample of this share")
    prepare.add_argument("--word2vec", action="store_true")
    prepare.add_argument("--restart", action="store_true", help="make stages anew that OUTPUT has already")
    market = jobs.add_parser("intelligence", help="brands, share of voice, momentum, forecasts and anomalies")
    market.add_argument("--dictionary", required=True, help="JSON of industries and brands")
    market.add_argument("--target", help="a brand for insights")
    for job in (prepare, market):
        job.add_argument("input")
        job.add_argument("output")
    return top


def main(argv: list[str] | None = None) -> dict[str, int]:
    """Run a job; the rows of each table that was written."""
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"tidemark-{args.job}").getOrCreate()
    if args.job == "prepare":
        posts = spark.read.parquet(args.input) if args.format == "parquet" else None
        if posts is None:
            scan = readers.scan_posts(spark, args.input)
            sinks.save(readers.rejects(scan), f"{args.output}/rejects")
            posts = readers.accepted(scan)
        tables = workflows.prepare(spark, posts, args.output, args.fraction, args.word2vec, not args.restart)
    else:
        tables = workflows.intelligence(spark, spark.read.parquet(args.input), entity.load_dictionary(spark, args.dictionary), args.output, target=args.target)
        for name in sorted(set(tables) - {"brands", "brand_sentiment"}):  # these are stored by the workflow
            sinks.save(tables[name], f"{args.output}/{name}")
    return {name: df.count() for name, df in tables.items()}


if __name__ == "__main__":
    for table, n in main().items():
        print(f"{table}: {n} rows")
