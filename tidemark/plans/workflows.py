"""The two batch workflows: preparation of raw posts, and market intelligence from prepared ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import brand, entity, features, forecast, preprocess, quality, topics
from tidemark.sources.sinks import Stages


def prepare(spark: SparkSession, posts: DataFrame, folder: str, fraction: float | None = None, with_word2vec: bool = False, resume: bool = True) -> dict[str, DataFrame]:
    """Quality, sample, preprocessing, features; each stage is stored and found again when the run is repeated."""
    stages = Stages(spark, folder)

    def stage(name: str, make) -> DataFrame:
        return stages.load(name) if resume and stages.has(name) else stages.save(name, make())

    sample = stage("sample", lambda: quality.valid_rows(posts) if fraction is None else quality.balanced_sample(quality.valid_rows(posts), "tweet_id", fraction))
    clean = stage("preprocessed", lambda: preprocess.pipeline(sample))
    feats = stage("features", lambda: features.feature_pipeline(clean, with_word2vec=with_word2vec))
    return {"sample": sample, "preprocessed": clean, "features": feats}


def intelligence(spark: SparkSession, posts: DataFrame, terms: DataFrame, folder: str, id_col: str = "tweet_id", target: str | None = None) -> dict[str, DataFrame]:
    """Brands, share of voice, momentum, insights, topics and forecasts; brand sentiment is computed once and reused."""
    stages = Stages(spark, folder)
    found = stages.save("brands", brand_rows(posts, terms, id_col))
    flat = found.select("*", F.explode("detected_brands").alias("b")).withColumns({"brand": F.lower("b.brand"), "confidence": F.col("b.confidence")}).drop("b", "detected_brands", "detected_products")
    daily = stages.save("brand_sentiment", brand.brand_sentiment(flat))
    out = {"brands": found, "brand_sentiment": daily, "share_of_voice": brand.share_of_voice(daily, least=1), "momentum": brand.brand_momentum(daily)}
    if target:
        out["insights"] = brand.insight_table(out["share_of_voice"], target)
    out["forecast"] = forecast.forecast(daily, "brand", "sentiment_score")
    out["anomalies"] = forecast.isolation_anomalies(daily, "brand", ["sentiment_score", "mention_count"])
    if "hashtags" in posts.columns:
        out["trending"] = topics.trending(posts, least=1)
    return out


def brand_rows(posts: DataFrame, terms: DataFrame, id_col: str = "tweet_id") -> DataFrame:
    """posts with detected_brands, detected_products and the first brand as primary_brand; those without any brand go."""
    out = entity.detect_products(entity.detect_brands(posts, terms, id_col), terms, id_col)
    return out.where("size(detected_brands) > 0").withColumn("primary_brand", F.get("detected_brands", F.lit(0))["brand"])
