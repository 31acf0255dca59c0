"""Topic statistics, trends, networks, topic models and clusters."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import IDF, CountVectorizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import bucket, has
from tidemark.functions.text import STOP_WORDS

#: Words that say nothing of a post's topic, beside the common stop words (fixed values).
MORE_STOPS = "url user rt amp http https com org www bit ly tweet twitter say get go know like time people good bad new day way year think".split()


def topic_sentiment(df: DataFrame, topic: str = "dominant_topic", label: str = "sentiment", samples: str | None = None) -> DataFrame:
    """Count, mean, spread and shares a topic; positive_ratio is over rows with a label."""
    y = F.col(label)
    more = [F.avg("vader_compound").alias("avg_vader_compound")] if has(df, "vader_compound") else []
    out = df.groupBy(topic).agg(F.count("*").alias("doc_count"), F.count(y).alias("labelled"), F.avg(y).alias("avg_sentiment"), F.stddev(y).alias("sentiment_stddev"), F.count_if(y == 1).alias("positive_count"), F.count_if(y == 0).alias("negative_count"), *more)
    out = with_samples(out, df, topic, samples) if samples else out
    return out.withColumn("positive_ratio", F.try_divide("positive_count", "labelled"))


def with_samples(out: DataFrame, rows: DataFrame, topic: str, samples: str, n: int = 5) -> DataFrame:
    """out (one row a topic) with sample_texts, the n least texts of each topic; each task keeps n rows a topic at most."""
    first = rows.select(F.col(topic).alias("_topic"), F.col(samples).alias("_t")).where("_t IS NOT NULL")
    first = first.withColumn("_n", F.row_number().over(Window.partitionBy("_topic").orderBy("_t"))).where(F.col("_n") <= n)
    first = first.groupBy("_topic").agg(F.array_sort(F.collect_list("_t")).alias("sample_texts"))
    return out.join(first, out[topic].eqNullSafe(first["_topic"]), "left").drop("_topic")


def polarising(df: DataFrame, topic: str = "dominant_topic", least: int = 50, label: str = "sentiment") -> DataFrame:
    """polarization = 2 p n, controversy = polarization times the spread, for topics of `least` rows or more."""
    out = topic_sentiment(df, topic, label).where(F.col("doc_count") >= least)
    negative = F.try_divide("negative_count", "labelled")
    out = out.withColumn("negative_ratio", negative).withColumn("polarization", 2 * F.col("positive_ratio") * F.col("negative_ratio"))
    return out.withColumn("controversy", F.col("polarization") * F.coalesce("sentiment_stddev", F.lit(0.0)))


def cluster_statistics(df: DataFrame, cluster: str = "cluster", label: str = "sentiment") -> DataFrame:
    return df.groupBy(cluster).agg(F.count("*").alias("size"), F.avg(label).alias("avg_sentiment"))


def emerging_topics(df: DataFrame, topic: str, window: str = "7 days", least: float = 0.5, ts: str = "timestamp") -> DataFrame:
    """Growth of a topic's count over its window before (0 without one), above `least`; windows without rows aren't filled."""
    out = df.groupBy(bucket(F.col(ts), window).alias("w"), topic).agg(F.count("*").alias("doc_count")).select(F.col("w.start").alias("window_start"), topic, "doc_count")
    prev = F.lag("doc_count", 1).over(Window.partitionBy(topic).orderBy("window_start"))
    out = out.withColumn("prev_count", prev)
    return out.withColumn("growth_rate", F.when(F.col("prev_count") > 0, (F.col("doc_count") - F.col("prev_count")) / F.col("prev_count")).otherwise(0.0)).where(F.col("growth_rate") > least)


def trending(df: DataFrame, tags: str = "hashtags", window: str = "1 day", least: int = 10, top: int = 10, ts: str = "timestamp", label: str = "sentiment") -> DataFrame:
    """The commonest tags of each window; ties go by tag. The rank filter limits each partition before it is sorted whole."""
    rows = df.select(bucket(F.col(ts), window).alias("w"), F.col(label).alias("y"), F.explode(tags).alias("t")).select("w", "y", F.lower("t").alias("hashtag"))
    out = rows.groupBy("w", "hashtag").agg(F.count("*").alias("mention_count"), F.avg("y").alias("avg_sentiment")).where(F.col("mention_count") >= least)
    out = out.select(F.col("w.start").alias("window_start"), "hashtag", "mention_count", "avg_sentiment")
    rank = F.row_number().over(Window.partitionBy("window_start").orderBy(F.desc("mention_count"), "hashtag"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top)


def viral_topics(df: DataFrame, topic: str, score: str = "virality_score", least: float = 0.7, samples: str | None = None) -> DataFrame:
    """Count and mean score a topic of rows above `least`; samples: a text column of which five are kept."""
    rows = df.where(F.col(score) > least)
    out = rows.groupBy(topic).agg(F.count("*").alias("viral_count"), F.avg(score).alias("avg_virality"))
    return with_samples(out, rows, topic, samples) if samples else out


def topic_edges(df: DataFrame, topics: str, least: float = 0.1) -> DataFrame:
    """(a, b, docs, weight): unordered pairs of topics over rows with two or more, by their share of such rows.

    topics: an array of at most a few topic ids a row (see strong_topics), which bounds the pairs.
    """
    rows = df.select(F.array_sort(F.array_distinct(topics)).alias("t")).where("size(t) >= 2")
    total = rows.agg(F.count("*").alias("total"))
    pairs = rows.select("t", F.posexplode("t").alias("i", "a")).select("a", F.explode(F.slice("t", F.col("i") + 2, F.greatest(F.size("t") - F.col("i") - 1, F.lit(0)))).alias("b"))
    out = pairs.groupBy("a", "b").agg(F.count("*").alias("docs")).crossJoin(F.broadcast(total))  # with one row
    return out.withColumn("weight", F.try_divide("docs", "total")).where(F.col("weight") >= least).drop("total")


def strong_topics(distribution: Column, least: float = 0.1, most: int = 3) -> Column:
    """The first `most` topics by id with a probability above `least`."""
    p = vector_to_array(distribution)
    ids = F.filter(F.transform(p, lambda x, i: F.when(x > least, i)), lambda i: i.isNotNull())
    return F.slice(ids, 1, most)


def dominant_topic(distribution: Column) -> Column:
    p = vector_to_array(distribution)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def word_overlap(topics: DataFrame, least: float = 0.1) -> DataFrame:
    """(a, b, jaccard) of topics (topic, words) whose word lists overlap more than `least`; pairs meet on a shared word."""
    flat = topics.select("topic", "words", F.explode(F.array_distinct("words")).alias("w"))
    left, right = flat.select(F.col("topic").alias("a"), F.col("words").alias("wa"), "w"), flat.select(F.col("topic").alias("b"), F.col("words").alias("wb"), "w")
    pairs = left.join(right, "w").where("a < b").select("a", "b", "wa", "wb").dropDuplicates(["a", "b"])
    return pairs.select("a", "b", (F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))).alias("jaccard")).where(F.col("jaccard") > least)


def histogram(df: DataFrame, topic: str = "dominant_topic") -> DataFrame:
    return df.groupBy(topic).count()


def lda_pipeline(tokens: str = "tokens", k: int = 10, rounds: int = 20, vocabulary: int = 1000, online: bool = False, min_df: float = 5, max_df: float = 0.8, seed: int = 42) -> Pipeline:
    """Stop words, counts, IDF and LDA; online: the stochastic variant with its usual decay."""
    stops = StopWordsRemover(inputCol=tokens, outputCol="topic_tokens", stopWords=[*STOP_WORDS, *MORE_STOPS])
    counts = CountVectorizer(inputCol="topic_tokens", outputCol="topic_counts", vocabSize=vocabulary, minDF=min_df, maxDF=max_df)
    idf = IDF(inputCol="topic_counts", outputCol="topic_features", minDocFreq=int(max(1, min_df)) if min_df >= 1 else 1)
    lda = LDA(k=k, maxIter=rounds, seed=seed, featuresCol="topic_features", topicDistributionCol="topic_distribution", optimizer="online")
    if online:
        lda = lda.setLearningOffset(1024.0).setLearningDecay(0.51).setSubsamplingRate(0.05).setOptimizeDocConcentration(True)
    else:
        lda = lda.setDocConcentration([1.1]).setTopicConcentration(1.1)
    return Pipeline(stages=[stops, counts, idf, lda])


def with_topics(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("dominant_topic", dominant_topic(F.col("topic_distribution")))


def describe_topics(model: PipelineModel, n: int = 20) -> DataFrame:
    """(topic, words, weights)."""
    words = F.array(*[F.lit(w) for w in model.stages[1].vocabulary])
    return model.stages[-1].describeTopics(n).select("topic", F.transform("termIndices", lambda i: F.get(words, i)).alias("words"), F.col("termWeights").alias("weights"))


def kmeans_clusters(df: DataFrame, k: int = 20, features: str | None = None, seed: int = 42) -> DataFrame:
    """df with its cluster; features: a vector column, by default the first of word2vec_features, tfidf_features, features."""
    chosen = features or next((c for c in ("word2vec_features", "tfidf_features", "features") if has(df, c)), None)
    if chosen is None:
        stages = Pipeline(stages=[CountVectorizer(inputCol="tokens", outputCol="_tf", vocabSize=1000), IDF(inputCol="_tf", outputCol="_idf")]).fit(df)
        df, chosen = stages.transform(df), "_idf"
    model = KMeans(k=k, maxIter=20, seed=seed, featuresCol=chosen, predictionCol="cluster").fit(df)
    return model.transform(df).drop("_tf", "_idf")
