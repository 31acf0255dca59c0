"""Data quality and sampling: one pass each, no eager counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def place(id_col: str, seed: int = 42) -> Column:
    """Where in [0, 1) a row stands by the MD5 of seed and id: the same in every engine, run and partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / float(1 << 32)


def quality_report(df: DataFrame, text: str = "text", label: str = "sentiment", ts: str = "timestamp") -> DataFrame:
    """One row of metrics; removal_percentage is null for an empty table."""
    blank = F.col(text).isNotNull() & (F.char_length(F.trim(text)) == 0)
    good = _good(text, label, ts)
    out = df.agg(F.count("*").alias("initial_count"), F.count_if(F.col(text).isNull()).alias("null_text_count"), F.count_if(blank).alias("empty_text_count"), F.count_if(F.col(label).isNull()).alias("null_sentiment_count"), F.count_if(F.col(ts).isNull()).alias("invalid_date_count"), F.count_if(good).alias("final_count"))
    removed = F.col("initial_count") - F.col("final_count")
    return out.withColumns({"removed_count": removed, "removal_percentage": F.try_divide(removed * 100.0, "initial_count")})


def _good(text: str, label: str, ts: str):
    return F.coalesce(F.char_length(F.trim(text)) > 0, F.lit(False)) & F.col(label).isNotNull() & F.col(ts).isNotNull()


def valid_rows(df: DataFrame, text: str = "text", label: str = "sentiment", ts: str = "timestamp") -> DataFrame:
    return df.where(_good(text, label, ts))


def class_counts(df: DataFrame, label: str = "sentiment") -> DataFrame:
    return df.groupBy(label).count()


def balanced_sample(df: DataFrame, id_col: str, fraction: float = 0.01, label: str = "sentiment") -> DataFrame:
    """Equal numbers of each class, about `fraction` of all rows in total, chosen by the hash of the id.

    Per-class thresholds come from one aggregate, so no window holds a class in one task. The result is a function of
    the ids alone and of neither partitioning nor run; each class's number is met up to chance.
    """
    per = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))  # one row a class by now
    per = per.withColumn("target", F.sum("n").over(every) * fraction / F.count("*").over(every))
    per = per.select(F.col(label).alias("_label"), F.least(F.try_divide("target", "n"), F.lit(1.0)).alias("_share"))
    return df.join(F.broadcast(per), df[label] == per["_label"]).where(place(id_col) < F.col("_share")).drop("_label", "_share")


def hash_sample(df: DataFrame, id_col: str, fraction: float, seed: int = 42) -> DataFrame:
    """Bernoulli-like sampling that any partitioning repeats."""
    return df.where(place(id_col, seed) < fraction)


def bernoulli_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(fraction=fraction, seed=seed)


def hash_split(df: DataFrame, id_col: str, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test by the hash of the id."""
    return df.where(place(id_col, seed) < share), df.where(place(id_col, seed) >= share)


def random_split(df: DataFrame, share: float = 0.8, seed: int = 42) -> list[DataFrame]:
    return df.randomSplit([share, 1 - share], seed)


def shuffled(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Rows in the order of a hash: random to the eye and the same in each run."""
    return df.orderBy(F.xxhash64(F.lit(seed), id_col), id_col)
