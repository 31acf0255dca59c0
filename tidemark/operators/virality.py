"""Virality scores from text alone or with engagement: weighted sums of terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import require

#: The weight of each term, and the scores above which a text is of high or medium potential.
TEXT_WEIGHTS = {"extremity": 0.3, "hashtag": 0.2, "url": 0.1, "signs": 0.01}
TEXT_LIMITS = {"high": 0.7, "medium": 0.4}
ENGAGEMENT_WEIGHTS = {"engagement": 0.4, "extremity": 0.2, "hashtag": 0.15, "mention": 0.15, "url": 0.1}
ENGAGEMENT_LIMITS = {"high": 0.8, "medium": 0.5}


def _holds(sign: str) -> Column:
    return F.coalesce(F.contains("text", F.lit(sign)), F.lit(False)).cast("double")


#: What a term is, from the columns of a post.
TERMS = {
    "extremity": lambda: F.abs("vader_compound"),
    "hashtag": lambda: F.coalesce(F.size("hashtags") > 0, F.lit(False)).cast("double"),
    "url": lambda: _holds("http"),
    "mention": lambda: _holds("@"),
    "signs": lambda: (F.col("exclamation_count") + F.col("question_count") + F.col("emoji_sentiment")).cast("double"),
    "engagement": lambda: F.try_divide(F.col("retweet_count") * 2 + F.col("favorite_count"), F.col("follower_count") + 1),
}


def _scored(df: DataFrame, weights: dict[str, float], limits: dict[str, float]) -> DataFrame:
    """df with virality_score, the weighted sum, and virality_potential."""
    out = df.withColumn("virality_score", reduce(lambda total, x: total + TERMS[x[0]]() * x[1], weights.items(), F.lit(0.0)))
    level = reduce(lambda low, x: F.when(F.col("virality_score") > x[1], x[0]).otherwise(low), reversed(limits.items()), F.lit("low"))
    return out.withColumn("virality_potential", level)


def text_virality(df: DataFrame) -> DataFrame:
    """Needs text, hashtags, vader_compound, exclamation_count, question_count, emoji_sentiment."""
    require(df, "text", "hashtags", "vader_compound", "exclamation_count", "question_count", "emoji_sentiment")
    return _scored(df, TEXT_WEIGHTS, TEXT_LIMITS)


def engagement_virality(df: DataFrame) -> DataFrame:
    """Needs text, hashtags, vader_compound, retweet_count, favorite_count, follower_count."""
    require(df, "text", "hashtags", "vader_compound", "retweet_count", "favorite_count", "follower_count")
    return _scored(df, ENGAGEMENT_WEIGHTS, ENGAGEMENT_LIMITS)
