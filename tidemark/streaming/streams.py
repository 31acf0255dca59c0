"""Structured Streaming forms of the windowed aggregates.

Counts and sums by event-time window run in append mode behind a watermark; what needs neighbouring windows (lags,
ranks, rolling means) runs on each finished batch of windows through foreachBatch.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def work_folder(spark: SparkSession, name: str = "stream") -> str:
    """A new path for a stream's state and output in spark.checkpoint.dir; in local mode without it, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tidemark-stream-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str, schema: StructType, files: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def windowed(df: DataFrame, keys: list[str] | None = None, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes", ts: str = "timestamp", label: str = "sentiment") -> DataFrame:
    """Counts, label sums and means by window and keys; also works on a table, with the same result."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    y = F.col(label)
    rows = df.withWatermark(ts, late) if df.isStreaming else df
    out = rows.groupBy(w.alias("w"), *(keys or [])).agg(F.count("*").alias("mention_count"), F.count(y).alias("labelled"), F.sum(y).alias("sentiment_sum"), F.avg(y).alias("avg_sentiment"), F.count_if(y == 1).alias("positive_count"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(keys or []), "mention_count", "labelled", "sentiment_sum", "avg_sentiment", "positive_count")


def sessions(df: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "timestamp") -> DataFrame:
    """Activity sessions of a key, closed after `gap` without a row."""
    rows = df.withWatermark(ts, late) if df.isStreaming else df
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all that is there to Parquet and stop."""
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return q


def each_batch(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Run `work(batch, number)` on each batch; a batch that is repeated after a failure has the same number."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(work).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
