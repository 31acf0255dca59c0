"""Sinks: partitioned Parquet, several formats, stage checkpoints, statistics as JSON, batches as pandas."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by_month(df: DataFrame, path: str, partitions: int = 10) -> None:
    """Parquet by year and month; rows of a month meet in few tasks, so there are few files."""
    df.repartition(partitions, "year", "month").write.mode("overwrite").partitionBy("year", "month").parquet(path)


def update_months(df: DataFrame, path: str, partitions: int = 10) -> None:
    """write_by_month for the months that df has: their files are replaced, and those of all other months stay as they are."""
    writer = df.repartition(partitions, "year", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("year", "month").parquet(path)


def save(df: DataFrame, path: str, format: str = "parquet", files: int | None = None) -> None:
    out = (df.coalesce(files) if files else df).write.mode("overwrite")
    if format == "parquet":
        out.parquet(path)
    elif format == "csv":
        out.option("header", True).csv(path)
    elif format == "json":
        out.json(path)
    else:
        raise ValueError(f"unknown format {format!r}; known: parquet, csv, json")


class Stages:
    """Stage outputs under one folder that a later process finds again: a Parquet table and its metadata each."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, name: str, df: DataFrame, **metadata) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/data")
        meta = json.dumps({"stage": name, "columns": df.columns, **metadata})
        self.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{name}/metadata")
        return self.load(name)

    def has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/metadata/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/data")

    def metadata(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/{name}/metadata").first()[0])


def write_statistics(statistics: DataFrame, path: str) -> None:
    """A small table as JSON lines in one file."""
    statistics.coalesce(1).write.mode("overwrite").json(path)


def write_insight(insight: DataFrame, path: str) -> None:
    """Each row of an insight table as one JSON document."""
    insight.select(F.to_json(F.struct(*insight.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def _packed(batches: Iterator) -> Iterator:
    """Each Arrow batch as one row that holds its stream."""
    import pyarrow as pa

    for b in batches:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, b.schema) as stream:
            stream.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["batch"])


def pandas_batches(df: DataFrame, rows: int = 10_000) -> Iterator[pd.DataFrame]:
    """The rows as pandas frames of `rows` rows at most, in Arrow batches, one partition at a time on the driver."""
    import pyarrow as pa

    held: list = []
    size = 0
    for r in df.mapInArrow(_packed, "batch binary").toLocalIterator():
        table = pa.ipc.open_stream(bytes(r["batch"])).read_all()
        held.append(table)
        size += table.num_rows
        while size >= rows:
            every = pa.concat_tables(held)
            yield every.slice(0, rows).to_pandas()
            held, size = [every.slice(rows)], size - rows
    if size:
        yield pa.concat_tables(held).to_pandas()
