"""The text preparation chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X

KEPT = "tweet_id text text_processed sentiment timestamp year month day hour hashtags emoji_sentiment text_length processed_length token_count tokens_lemmatized detected_language language_confidence".split()


def clean(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumns({"text_clean": X.clean_text(F.col(text)), "hashtags": X.hashtags(F.col(text))})


def emoji(df: DataFrame, text: str = "text", cleaned: str = "text_clean") -> DataFrame:
    return df.withColumns({"emoji_sentiment": X.emoji_score(F.col(text)), "text_clean_demojized": X.emoji_words(F.col(cleaned))})


def language(df: DataFrame, text: str = "text") -> DataFrame:
    # As rows of a generator: a filter on the result isn't pushed into it, so the detector is in the plan once.
    return df.select("*", F.inline(F.array(X.detect_language(F.col(text)))).alias("detected_language", "language_confidence"))


def filter_language(df: DataFrame, text: str = "text", languages: list[str] | None = ("en",), least: float = 0.5) -> DataFrame:
    """Rows of the languages at that confidence; no list, no filter."""
    out = language(df, text)
    return out.where(F.col("detected_language").isin(*languages) & (F.col("language_confidence") >= least)) if languages else out


def words(df: DataFrame, cleaned: str = "text_clean") -> DataFrame:
    out = df.withColumn("tokens", X.tokens(F.col(cleaned)))
    out = out.withColumn("tokens_filtered", X.without_stop_words(F.col("tokens")))
    return out.withColumn("tokens_lemmatized", X.lemmas(F.col("tokens_filtered")))


def processed(df: DataFrame, text: str = "text") -> DataFrame:
    out = df.withColumn("text_processed", F.array_join("tokens_lemmatized", " "))
    return out.withColumns({"text_length": F.char_length(text), "processed_length": F.char_length("text_processed"), "token_count": F.size("tokens_lemmatized")})


def pipeline(df: DataFrame, languages: list[str] | None = ("en",), least: float = 0.5) -> DataFrame:
    """language, clean, emoji, words and lengths; of the result the known columns that exist.

    The filter comes first, since it needs the text alone: other rows aren't cleaned. Without languages, none is detected.
    """
    out = df.transform(filter_language, "text", languages, least).transform(clean).transform(emoji).transform(words, "text_clean_demojized").transform(processed)
    return out.select(*[c for c in KEPT if c in out.columns])
