"""Column contracts and small expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, *names: str) -> DataFrame:
    """df, or an error that names the missing columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def calendar(start: Column) -> dict[str, Column]:
    """Calendar columns of a window's start; day_of_week is 1 for Sunday."""
    dow = F.dayofweek(start)
    return {"hour": F.hour(start), "day_of_week": dow, "month": F.month(start), "year": F.year(start), "week_of_year": F.weekofyear(start), "is_weekend": dow.isin(1, 7).cast("int")}


def bucket(ts: Column, grain: str) -> Column:
    """struct(start, end) of the event-time bucket: hourly, daily, weekly (from Thursday, as epoch weeks) or monthly."""
    if grain == "monthly":
        start = F.trunc(ts, "month")  # a date: no time zone takes part
        return F.struct(start.cast("timestamp_ntz").alias("start"), F.add_months(start, 1).cast("timestamp_ntz").alias("end"))
    return F.window(ts, {"hourly": "1 hour", "daily": "1 day", "weekly": "1 week"}.get(grain, grain if " " in grain else "1 hour"))


def hours_between(first: Column, last: Column) -> Column:
    return F.timestamp_diff("SECOND", first, last) / 3600.0


def over_share(p: Column, q: Column) -> Column:
    return F.try_divide(p, q)
