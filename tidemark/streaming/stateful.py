"""Rolling means, anomalies and momentum as a stream, by state and event-time timers.

Each key keeps the counts of its open buckets and the metric of its last closed ones. A bucket's timer fires once the
watermark has passed its end, so that later rows can't change it (the engine drops them); it is then closed, compared
with those before it, and written. The result of a stream is that of timeseries.rolling_anomalies and
timeseries.momentum over a table of the same rows, but for buckets that the watermark hasn't passed.

State needs the RocksDB store, which `use_state_store` chooses. A key's state is its open buckets, at most those within
the watermark's delay, and max(past, lookback + 2) numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

OUT = (
    "start_ms long, tweet_count long, avg_sentiment double, rolling_mean double, rolling_std double, z_score double, is_anomaly int, anomaly_type string, "
    "sentiment_ma double, roc double, momentum double, acceleration double, trend string"
)


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _known(values: list) -> list[float]:
    return [v for v in values if v is not None]


def _mean(values: list) -> float | None:
    known = _known(values)
    return math.fsum(known) / len(known) if known else None


def _less(a: float | None, b: float | None) -> float | None:
    return None if a is None or b is None else a - b


def compared(x: float | None, before: list, past: int, threshold: float, lookback: int) -> dict:
    """A bucket's metric against those before it, oldest first; None stands for a metric that is missing."""
    window = _known(before[-past:])
    mean = _mean(window)
    std = math.sqrt(math.fsum((v - mean) ** 2 for v in window) / (len(window) - 1)) if len(window) > 1 else None
    z = (x - mean) / std if x is not None and std else None
    far = z is not None and abs(z) > threshold
    series = [*before, x]
    back = lambda k: series[k - lookback] if len(series) + k - lookback >= 0 else None
    change, earlier = _less(x, back(-1)), _less(series[-2], back(-2)) if len(series) > 1 else None
    rate = change * 100 / back(-1) if change is not None and back(-1) else None
    trend = "neutral" if change is None or abs(change) <= 0.05 else "improving" if change > 0 else "declining"
    return {
        "rolling_mean": mean, "rolling_std": std, "z_score": z, "is_anomaly": int(far), "anomaly_type": "normal" if not far else "positive_spike" if z > 0 else "negative_spike",
        "sentiment_ma": _mean(series[-lookback - 1 :]), "roc": rate, "momentum": change, "acceleration": _less(change, earlier), "trend": trend,
    }


class RollingBuckets(StatefulProcessor):
    def __init__(self, keys: list[str], width_ms: int, metric: str, past: int, threshold: float, lookback: int):
        self.keys, self.width, self.metric, self.past, self.threshold, self.lookback = keys, width_ms, metric, past, threshold, lookback

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "start long", "n long, labelled long, total double")
        self.closed = handle.getValueState("closed", "metrics array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            start = batch["row_ms"] // self.width * self.width
            for at, own in batch.groupby(start, sort=False)["row_y"]:
                at = int(at)
                n, labelled, total = self.open.getValue((at,)) if self.open.containsKey((at,)) else (0, 0, 0.0)
                self.open.updateValue((at,), (n + len(own), labelled + int(own.notna().sum()), total + float(own.sum())))
                self.handle.registerTimer(at + self.width)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs() - self.width
        n, labelled, total = self.open.getValue((at,))
        self.open.removeKey((at,))
        mean = total / labelled if labelled else None
        x = float(labelled) if self.metric == "tweet_count" else mean
        before = list(self.closed.get()[0]) if self.closed.exists() else []
        row = compared(x, before, self.past, self.threshold, self.lookback)
        self.closed.update(([*before, x][-max(self.past, self.lookback + 2) :],))
        yield pd.DataFrame([{**dict(zip(self.keys, key, strict=True)), "start_ms": at, "tweet_count": labelled, "avg_sentiment": mean, **row}])

    def close(self) -> None:
        pass


def rolling_stream(df: DataFrame, keys: list[str], ts: str = "timestamp", label: str = "sentiment", minutes: int = 60, metric: str = "avg_sentiment", past: int = 24, threshold: float = 2.0, lookback: int = 7, late: str = "10 minutes") -> DataFrame:
    """The stream df's buckets of `minutes`, by keys, each once it is closed: count and mean of the label, and the metric
    (avg_sentiment or tweet_count) against the `past` buckets before it and that of `lookback` buckets before."""
    width = minutes * 60_000
    rows = df.withWatermark(ts, late).select(*keys, ts, F.unix_millis(ts).alias("row_ms"), F.col(label).cast("double").alias("row_y"))
    schema = StructType([df.schema[k] for k in keys] + list(StructType.fromDDL(OUT)))
    found = rows.groupBy(*keys).transformWithStateInPandas(RollingBuckets(keys, width, metric, past, threshold, lookback), schema, "append", "EventTime")
    return found.select(*keys, F.timestamp_millis("start_ms").alias("window_start"), *[f.name for f in StructType.fromDDL(OUT)][1:])
