"""Stateful streams against the same operators over a table."""

import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import TESTDATA
from tidemark.operators import timeseries
from tidemark.sources import readers
from tidemark.streaming import stateful, streams


def _table(spark):
    return readers.event_series(spark, TESTDATA).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def _files(df, folder, days):
    for i in range(0, len(days), 6):
        df.where(F.to_date("timestamp").isin(days[i : i + 6])).coalesce(1).write.mode("append").parquet(folder)


def _want(df, metric, threshold):
    """The table's answer by the batch operators, a bucket of six hours."""
    rows = df.groupBy("topic", F.window("timestamp", "6 hours").alias("w")).agg(F.count("sentiment").alias("tweet_count"), F.avg("sentiment").alias("avg_sentiment"))
    rows = rows.select("topic", F.col("w.start").alias("window_start"), "tweet_count", "avg_sentiment")
    a = timeseries.rolling_anomalies(rows, metric, 24, threshold, ["topic"])
    return timeseries.momentum(a, 7, metric, ["topic"])


def _same(got, want):
    names = "tweet_count avg_sentiment rolling_mean rolling_std z_score is_anomaly anomaly_type sentiment_ma roc momentum acceleration trend".split()
    got, want = ({(r.topic, r.window_start): r for r in df.collect()} for df in (got, want))
    last = max(at for _, at in got)
    assert got and got.keys() == {k for k in want if k[1] <= last}
    for k, r in got.items():
        for n in names:
            a, b = r[n], want[k][n]
            assert a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9)), (k, n, a, b)


@pytest.mark.parametrize(("metric", "threshold"), [("avg_sentiment", 2.0), ("tweet_count", 3.0)])
def test_stream_equals_table_over_triggers_and_a_restart(spark, tmp_path, metric, threshold):
    stateful.use_state_store(spark)
    df = _table(spark)
    days = [r[0] for r in df.select(F.to_date("timestamp").alias("d")).distinct().orderBy("d").collect()]
    folder, half = str(tmp_path / "in"), len(days) // 2

    def run():
        stream = stateful.rolling_stream(streams.read_stream(spark, folder, df.schema, files=1), ["topic"], minutes=360, metric=metric, threshold=threshold)
        streams.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))

    _files(df, folder, days[:half])
    run()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    _files(df, folder, days[half:])
    # Rows that the watermark has passed are dropped: they'd change the first buckets.
    df.limit(50).withColumn("timestamp", F.lit("2000-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)
    run()  # a new query from the checkpoint
    got = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < first < got.count()
    _same(got, _want(df, metric, threshold))


def test_compared_with_missing_values():
    r = stateful.compared(None, [1.0, None, 3.0], 24, 2.0, 2)
    assert (r["rolling_mean"], r["z_score"], r["momentum"], r["trend"]) == (2.0, None, None, "neutral")
    assert stateful.compared(1.0, [], 24, 2.0, 7)["sentiment_ma"] == 1.0
