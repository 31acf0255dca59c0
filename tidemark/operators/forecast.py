"""Per-series models in numpy behind applyInPandas: additive regression forecasts, unit-root test, isolation forest.

A group is one series of one row a time bucket, so its size is bounded by the calendar, not by the raw rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timeseries import sentiment_by_time


def _design(days: np.ndarray, origin: float, span: float, monthly: bool) -> np.ndarray:
    """Trend and the Fourier terms of a week and, on wish, of a month."""
    t = (days - origin) / span
    cols = [np.ones_like(t), t]
    for period, order in ((7.0, 3), *(((30.5, 3),) if monthly else ())):
        for k in range(1, order + 1):
            cols += [np.sin(2 * np.pi * k * days / period), np.cos(2 * np.pi * k * days / period)]
    return np.stack(cols, 1)


def fit_series(stamps: pd.Series, values: pd.Series, ahead: int, step_days: float = 1.0) -> pd.DataFrame:
    """ds, yhat, yhat_lower, yhat_upper over the series and `ahead` steps after it: ridge regression with an 80 % band."""
    ok = values.notna().to_numpy() & stamps.notna().to_numpy()
    days = stamps.astype("datetime64[ns]").astype("int64").to_numpy() / 86_400e9
    d, y = days[ok], values.to_numpy(float)[ok]
    span = max(d.max() - d.min(), step_days)
    monthly = len(y) > 30
    a = _design(d, d.min(), span, monthly)
    penalty = np.diag([1e-9, 1e-6, *[0.1] * (a.shape[1] - 2)])
    w = np.linalg.solve(a.T @ a + penalty, a.T @ y)
    rest = y - a @ w
    spread = 1.2816 * math.sqrt(float(rest @ rest) / max(1, len(y) - 2))
    future = np.concatenate([d, d.max() + step_days * np.arange(1, ahead + 1)])
    yhat = _design(future, d.min(), span, monthly) @ w
    far = np.maximum(0, future - d.max()) / span
    band = spread * np.sqrt(1 + far)
    ds = pd.to_datetime((future * 86_400e9).round().astype("int64"))
    return pd.DataFrame({"ds": ds, "yhat": yhat, "yhat_lower": yhat - band, "yhat_upper": yhat + band})


def forecast(df: DataFrame, key: str, value: str, ts: str = "window_start", ahead: int = 7, step_days: float = 1.0, least: int = 11) -> DataFrame:
    """(key, ds, yhat, yhat_lower, yhat_upper) for each series of `least` points or more; shorter ones have no rows."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna().sort_values("t")
        if len(g) < least:
            return pd.DataFrame({"k": [], "ds": [], "yhat": [], "yhat_lower": [], "yhat_upper": []}).astype({"k": "str", "ds": "datetime64[ns]"})
        out = fit_series(g["t"], g["v"], ahead, step_days)
        out.insert(0, "k", g["k"].iloc[0])
        return out

    rows = df.select(F.col(key).cast("string").alias("k"), F.col(ts).cast("timestamp_ntz").alias("t"), F.col(value).cast("double").alias("v"))
    out = rows.groupBy("k").applyInPandas(run, "k string, ds timestamp_ntz, yhat double, yhat_lower double, yhat_upper double")
    return out.withColumnRenamed("k", key)


def forecast_metrics(df: DataFrame, metrics: list[str], ts: str = "window_start", ahead: int = 7) -> DataFrame:
    """One series a metric."""
    long = df.unpivot([ts], metrics, "metric", "value") if len({df.schema[m].dataType for m in metrics}) == 1 else df.select(ts, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([ts], metrics, "metric", "value")
    return forecast(long, "metric", "value", ts, ahead)


def forecast_sentiment(df: DataFrame, ahead: int = 7, grain: str = "daily", ts: str = "timestamp", label: str = "sentiment") -> DataFrame:
    """The sentiment series by hour or day, carried on in steps of the same length."""
    rows = sentiment_by_time(df, grain, ts, label).withColumn("series", F.lit("sentiment"))
    return forecast(rows, "series", "avg_sentiment", ahead=ahead, step_days=1 / 24 if grain == "hourly" else 1.0)


def forecast_topics(df: DataFrame, topic: str, ahead: int = 7, ts: str = "timestamp") -> DataFrame:
    """Daily counts of each topic with more than five days."""
    rows = df.groupBy(F.window(ts, "1 day").alias("w"), topic).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), topic, "n")
    return forecast(rows, topic, "n", ahead=ahead, least=6)


def _c(n: np.ndarray | float) -> np.ndarray | float:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def isolation_scores(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 42) -> np.ndarray:
    """Anomaly scores in (0, 1) (Liu, Ting and Zhou 2008), higher for odder rows."""
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    top = math.ceil(math.log2(max(size, 2)))
    depth = np.zeros(len(x))

    def walk(rows: np.ndarray, inside: np.ndarray, level: int) -> None:
        if not len(rows):
            return
        low, high = (x[inside].min(0), x[inside].max(0)) if len(inside) else (None, None)
        open_ = np.flatnonzero(high > low) if len(inside) > 1 else []
        if level >= top or not len(open_):
            depth[rows] += level + float(_c(len(inside)))
            return
        f = rng.choice(open_)
        cut = rng.uniform(low[f], high[f])
        left = x[rows, f] < cut
        inner = x[inside, f] < cut
        walk(rows[left], inside[inner], level + 1)
        walk(rows[~left], inside[~inner], level + 1)

    for _ in range(trees):
        walk(np.arange(len(x)), rng.choice(len(x), size, replace=False), 0)
    return 2 ** (-(depth / trees) / max(float(_c(size)), 1e-9))


def isolation_anomalies(df: DataFrame, key: str, features: list[str], ts: str = "window_start", contamination: float = 0.05, least: int = 11) -> DataFrame:
    """(key, ts, anomaly_score, is_anomaly) for series of `least` rows or more: the oddest share of each."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna().sort_values("t")
        if len(g) < least:
            return pd.DataFrame({"k": [], "t": [], "s": [], "a": []}).astype({"k": "str", "t": "datetime64[ns]", "s": "float64", "a": "int32"})
        s = isolation_scores(g[[f"f{i}" for i in range(len(features))]].to_numpy(float))
        return pd.DataFrame({"k": g["k"].to_numpy(), "t": g["t"].to_numpy(), "s": s, "a": (s > np.quantile(s, 1 - contamination)).astype("int32")})

    rows = df.select(F.col(key).cast("string").alias("k"), F.col(ts).cast("timestamp_ntz").alias("t"), *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    out = rows.groupBy("k").applyInPandas(run, "k string, t timestamp_ntz, s double, a int")
    return out.select(F.col("k").alias(key), F.col("t").alias(ts), F.col("s").alias("anomaly_score"), F.col("a").alias("is_anomaly"))


def unit_root(df: DataFrame, key: str, value: str, ts: str = "window_start", lags: int = 1) -> DataFrame:
    """(key, statistic, stationary): the augmented Dickey-Fuller t with a constant, against the 5 % value for its length."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        y = g.sort_values("t")["v"].dropna().to_numpy(float)
        n = len(y) - 1 - lags
        if n < lags + 4 or np.ptp(y) == 0:
            return pd.DataFrame({"k": [g["k"].iloc[0]], "statistic": [np.nan], "stationary": [False]})
        d = np.diff(y)
        a = np.stack([np.ones(n), y[lags:-1], *[d[lags - i : len(d) - i] for i in range(1, lags + 1)]], 1)
        w, *_ = np.linalg.lstsq(a, d[lags:], rcond=None)
        e = d[lags:] - a @ w
        cov = np.linalg.pinv(a.T @ a) * (e @ e) / max(1, n - a.shape[1])
        t = float(w[1] / math.sqrt(max(cov[1, 1], 1e-300)))
        # MacKinnon's response surface for the 5 % point with a constant (fixed values).
        return pd.DataFrame({"k": [g["k"].iloc[0]], "statistic": [t], "stationary": [bool(t < -2.8615 - 2.738 / n - 8.36 / n**2)]})

    rows = df.select(F.col(key).cast("string").alias("k"), F.col(ts).cast("timestamp_ntz").alias("t"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("k").applyInPandas(run, "k string, statistic double, stationary boolean").withColumnRenamed("k", key)
