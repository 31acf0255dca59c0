from pyspark.sql import functions as F

from tests.conftest import TESTDATA
from tidemark.sources import readers
from tidemark.streaming import streams


def _table(spark):
    return readers.event_series(spark, TESTDATA).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def _source(spark, tmp_path):
    """The events as files in time order, as a stream would bring them."""
    df = _table(spark)
    days = [r[0] for r in df.select(F.to_date("timestamp").alias("d")).distinct().orderBy("d").collect()]
    for i in range(0, len(days), 10):
        df.where(F.to_date("timestamp").isin(days[i : i + 10])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return streams.read_stream(spark, str(tmp_path / "in"), df.schema, files=1)


def test_stream_equals_table(spark, tmp_path):
    streamed = streams.windowed(_source(spark, tmp_path), ["topic"])
    streams.run_available(streamed, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = streams.windowed(_table(spark), ["topic"])
    # Append mode keeps back the windows that the watermark hasn't passed.
    last = got.agg(F.max("window_end")).first()[0]
    want = want.where(F.col("window_end") <= F.lit(last))
    assert got.count() > 0 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_each_batch_and_sessions(spark, tmp_path):
    seen = []
    q = streams.windowed(_source(spark, tmp_path), ["topic"])
    streams.each_batch(q, lambda b, k: seen.append((k, b.count())), str(tmp_path / "cp2"))
    assert sum(n for _, n in seen) >= streams.windowed(_table(spark), ["topic"]).count()
    got = streams.sessions(_table(spark), "user_id", "12 hours")
    assert got.agg(F.sum("events")).first()[0] == _table(spark).count()
