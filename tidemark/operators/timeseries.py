"""Event-time aggregation, rolling anomalies, momentum and decomposition.

Windows without a key are only laid over tables that are already one row a bucket. Pass `key` to keep several series
apart; then each series is one task's work and nothing meets in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import bucket, calendar, has


def _over(key: list[str], order: str = "window_start"):
    return (Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))).orderBy(order)


def sentiment_by_time(df: DataFrame, grain: str = "hourly", ts: str = "timestamp", label: str = "sentiment") -> DataFrame:
    """Counts, mean, spread and shares a bucket, with calendar columns; unknown grains are hours.

    tweet_count counts rows with a label; positive_ratio is null where there is none.
    """
    y = F.col(label)
    aggs = [F.count(y).alias("tweet_count"), F.avg(y).alias("avg_sentiment"), F.stddev(y).alias("sentiment_stddev"), F.count_if(y == 1).alias("positive_count"), F.count_if(y == 0).alias("negative_count")]
    aggs += [F.avg(c).alias(f"avg_{c}") for c in ("vader_compound", "emoji_sentiment") if has(df, c)]
    out = df.groupBy(bucket(F.col(ts), grain).alias("w")).agg(*aggs).withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")}).drop("w")
    return out.withColumns({"positive_ratio": F.try_divide("positive_count", "tweet_count"), **calendar(F.col("window_start"))})


def sentiment_by_part(df: DataFrame, part: str, ts: str = "timestamp", label: str = "sentiment") -> DataFrame:
    """Mean and count by hour of day ('hour') or day of week ('day_of_week', with the day's name)."""
    key = F.hour(ts) if part == "hour" else F.dayofweek(ts)
    out = df.groupBy(key.alias(part)).agg(F.avg(label).alias("avg_sentiment"), F.count(label).alias("tweet_count"))
    if part == "day_of_week":
        names = F.array(*[F.lit(d) for d in "Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split()])
        out = out.withColumn("day_name", F.get(names, F.col(part) - 1))
    return out


def sentiment_trends(df: DataFrame, **names) -> dict[str, DataFrame]:
    """The five trend tables by name; each is lazy."""
    grains = {g: sentiment_by_time(df, g, **names) for g in ("hourly", "daily", "weekly")}
    return grains | {"by_hour": sentiment_by_part(df, "hour", **names), "by_day_of_week": sentiment_by_part(df, "day_of_week", **names)}


def trend_cube(df: DataFrame, ts: str = "timestamp", label: str = "sentiment") -> DataFrame:
    """The five trend tables of sentiment_trends as one, from one scan and one shuffle: (grain, window_start or part, ...).

    grain is hourly, daily or weekly with a window_start, hour or day_of_week (1 for Sunday) with a part.
    """
    at, day = F.col(ts), F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
    kind = df.schema[ts].dataType
    grains = {
        "hourly": F.date_trunc("hour", at).cast(kind), "daily": F.date_trunc("day", at).cast(kind), "weekly": F.date_add(F.lit("1970-01-01").cast("date"), day - F.pmod(day, F.lit(7))).cast(kind),
        "hour": F.hour(at), "day_of_week": F.dayofweek(at),
    }
    names, y = list(grains), F.col("_y")
    rows = df.select(*[c.alias(n) for n, c in grains.items()], F.col(label).alias("_y"))
    aggs = [F.count(y).alias("tweet_count"), F.avg(y).alias("avg_sentiment"), F.stddev(y).alias("sentiment_stddev"), F.count_if(y == 1).alias("positive_count"), F.count_if(y == 0).alias("negative_count")]
    out = rows.groupingSets([[n] for n in names], *names).agg(F.grouping_id(*names).alias("g"), *aggs)
    # A bit of the grouping id is 0 for the column that is grouped by.
    grain = F.coalesce(*[F.when(F.col("g") == (1 << len(names)) - 1 - (1 << len(names) - 1 - i), n) for i, n in enumerate(names)])
    return out.select(grain.alias("grain"), F.coalesce("hourly", "daily", "weekly").alias("window_start"), F.coalesce("hour", "day_of_week").alias("part"), *[c for c in out.columns if c not in {*names, "g"}], F.try_divide("positive_count", "tweet_count").alias("positive_ratio"))


def rolling_anomalies(df: DataFrame, metric: str = "avg_sentiment", window: int = 24, threshold: float = 2.0, key: list[str] | None = None) -> DataFrame:
    """Distance of each bucket's metric from the `window` buckets before it, in standard deviations; null counts as normal."""
    past = _over(key or []).rowsBetween(-window, -1)
    out = df.withColumns({"rolling_mean": F.avg(metric).over(past), "rolling_std": F.stddev(metric).over(past)})
    out = out.withColumn("z_score", F.try_divide(F.col(metric) - F.col("rolling_mean"), "rolling_std"))
    far = F.coalesce(F.abs("z_score") > threshold, F.lit(False))
    kind = F.when(far & (F.col("z_score") > 0), "positive_spike").when(far, "negative_spike").otherwise("normal")
    return out.withColumns({"is_anomaly": far.cast("int"), "anomaly_type": kind})


def momentum(df: DataFrame, lookback: int = 7, metric: str = "avg_sentiment", key: list[str] | None = None) -> DataFrame:
    """Moving mean, change, rate of change and acceleration against `lookback` buckets before."""
    w = _over(key or [])
    x = F.col(metric)
    out = df.withColumns({"sentiment_ma": F.avg(x).over(w.rowsBetween(-lookback, 0)), "prev": F.lag(x, lookback).over(w)})
    out = out.withColumns({"roc": F.try_divide((x - F.col("prev")) * 100, "prev"), "momentum": x - F.col("prev")}).drop("prev")
    out = out.withColumn("acceleration", F.col("momentum") - F.lag("momentum", 1).over(w))
    return out.withColumn("trend", F.when(F.col("momentum") > 0.05, "improving").when(F.col("momentum") < -0.05, "declining").otherwise("neutral"))


def volume_by_hour(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.groupBy(F.window(ts, "1 hour").alias("w")).agg(F.count("*").alias("tweet_count")).select(F.col("w.start").alias("window_start"), "tweet_count")


def volume_anomalies(df: DataFrame, ts: str = "timestamp", window: int = 24, threshold: float = 3.0) -> DataFrame:
    """Hourly volume against the hours before; a spread of zero or null gives a distance of 0."""
    out = rolling_anomalies(volume_by_hour(df, ts), "tweet_count", window, threshold)
    z = F.when(F.col("rolling_std") > 0, F.col("z_score")).otherwise(0.0)
    far = F.coalesce(F.abs(z) > threshold, F.lit(False))
    return out.withColumns({"z_score": z, "is_anomaly": far.cast("int"), "anomaly_type": F.when(far & (z > 0), "spike").when(far, "drop").otherwise("normal")})


def general_series(df: DataFrame, ts: str = "timestamp", label: str = "sentiment", brand: str = "general") -> DataFrame:
    """An hourly series under one brand's name."""
    out = df.groupBy(F.window(ts, "1 hour").alias("w")).agg(F.count("*").alias("mention_count"), F.avg(label).alias("sentiment_score"), F.try_divide(F.count_if(F.col(label) == 1), F.count("*")).alias("positive_ratio"))
    return out.select(F.lit(brand).alias("brand"), F.col("w.start").alias("window_start"), "mention_count", "sentiment_score", "positive_ratio")


def decompose(df: DataFrame, metric: str, period: int = 24, key: list[str] | None = None) -> DataFrame:
    """Additive trend (centred moving mean), season (mean by phase less the grand mean) and rest, as in classical decomposition.

    The ends, where the centred mean lacks rows, have a null trend and rest.
    """
    k = key or []
    w = _over(k)
    x, half = F.col(metric), period // 2
    whole = F.count(x).over(w.rowsBetween(-half, half)) == 2 * half + 1
    inner = F.avg(x).over(w.rowsBetween(-half, half - 1)) if period % 2 == 0 else None
    outer = F.avg(x).over(w.rowsBetween(-half + 1, half)) if period % 2 == 0 else F.avg(x).over(w.rowsBetween(-half, half))
    trend = F.when(whole, (inner + outer) / 2 if inner is not None else outer)
    out = df.withColumns({"trend": trend, "phase": (F.row_number().over(w) - 1) % period})
    by_phase, by_all = Window.partitionBy(*k, "phase"), Window.partitionBy(*k) if k else Window.partitionBy(F.lit(0))
    out = out.withColumn("detrended", x - F.col("trend"))
    out = out.withColumn("phase_mean", F.avg("detrended").over(by_phase))
    # The grand mean is over phases, each once.
    first = F.row_number().over(by_phase.orderBy("window_start")) == 1
    out = out.withColumn("one", F.when(first, F.col("phase_mean")))
    out = out.withColumn("seasonal", F.col("phase_mean") - F.avg("one").over(by_all))
    return out.withColumn("residual", x - F.col("trend") - F.col("seasonal")).drop("detrended", "phase_mean", "one")


def weekday_pivot(df: DataFrame, ts: str = "timestamp", label: str = "sentiment") -> DataFrame:
    """Mean by week (rows) and day of week (columns), the table behind a heat map."""
    rows = df.select(F.weekofyear(ts).alias("week_of_year"), F.dayofweek(ts).alias("d"), F.col(label).alias("y"))
    out = rows.groupBy("week_of_year").pivot("d", [1, 2, 3, 4, 5, 6, 7]).agg(F.avg("y"))
    return out.select("week_of_year", *[F.col(str(d)).alias(f"day_{d}") for d in range(1, 8)])


def lagged_change(x: Column, w) -> Column:
    return x - F.lag(x, 1).over(w)
