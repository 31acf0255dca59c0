"""Feature columns: text statistics, time, lexicon, dictionary, n-grams, TF-IDF, Word2Vec."""

from __future__ import annotations

import math

from pyspark.ml.feature import IDF, HashingTF, Word2Vec
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.columns import has
from tidemark.functions.lexicon import lexicon_sentiment
from tidemark.sources.shared import stored

NUMERIC = (
    "text_length processed_length token_count exclamation_count question_count uppercase_ratio punctuation_density hour_sin hour_cos is_weekend vader_compound brand_count"
).split()

#: Tokens that a task of Word2Vec learns from before another one is worth its merge.
LEARNED = 100_000


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    return df.withColumns({"exclamation_count": X.count_of(t, "!"), "question_count": X.count_of(t, "?"), "uppercase_ratio": X.uppercase_ratio(t), "punctuation_density": X.punctuation_density(t)})


def temporal(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Hour on the circle, weekday and part of the day; without a timestamp 0.0, 1.0, unknown, 0, unknown."""
    if not has(df, ts):
        return df.withColumns({"hour_sin": F.lit(0.0), "hour_cos": F.lit(1.0), "day_of_week": F.lit("unknown"), "is_weekend": F.lit(0), "time_of_day": F.lit("unknown")})
    hour, day = F.hour(ts), F.date_format(ts, "E")
    turn = F.lit(2 * math.pi) * hour / 24
    part = F.when(hour.between(6, 11), "morning").when(hour.between(12, 17), "afternoon").when(hour.between(18, 23), "evening").when(hour.isNotNull(), "night").otherwise("unknown")
    return df.withColumns({"hour_sin": F.coalesce(F.sin(turn), F.lit(0.0)), "hour_cos": F.coalesce(F.cos(turn), F.lit(1.0)), "day_of_week": F.coalesce(day, F.lit("unknown")), "is_weekend": F.coalesce(day.isin("Sat", "Sun").cast("int"), F.lit(0)), "time_of_day": part})


def lexicon(df: DataFrame, text: str = "text", words: dict[str, float] | None = None) -> DataFrame:
    out = df.withColumn("_s", lexicon_sentiment(F.col(text), words))
    return out.withColumns({f"vader_{n}": F.col(f"_s.{n}") for n in ("compound", "positive", "negative", "neutral")}).drop("_s")


def dictionary(df: DataFrame, text: str = "text") -> DataFrame:
    """Brand terms, their occurrences, categories, flags of the main brands and whether rivals meet."""
    out = df.withColumns({"brand_mentions": X.brand_mentions(F.col(text)), "brand_count": X.brand_count(F.col(text)), "product_categories": X.categories(F.col(text))})
    out = out.withColumns({"category_count": F.size("product_categories"), "has_competitor_comparison": X.compares_rivals(F.col("brand_mentions"))})
    return out.withColumns({f"has_{b}": F.array_contains("brand_mentions", b).cast("int") for b in X.FLAGGED})


def ngram_counts(df: DataFrame, tokens: str = "tokens_lemmatized", sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    out = df.withColumns({f"{n}grams": F.coalesce(X.ngrams(F.col(tokens), n), F.array().cast("array<string>")) for n in sizes})
    # By the number of tokens: who wants the counts alone has no runs made.
    return out.withColumns({f"{n}gram_count": F.coalesce(F.greatest(F.size(tokens) - (n - 1), F.lit(0)), F.lit(0)) for n in sizes})


def tfidf(df: DataFrame, tokens: str = "tokens_lemmatized", out: str = "tfidf_features", width: int = 5000, min_docs: int = 2) -> DataFrame:
    """Hashed term frequencies times IDF; the vector is dropped from nothing: null tokens count as none."""
    rows = df.withColumn("_t", F.coalesce(tokens, F.array().cast("array<string>")))
    rows = HashingTF(inputCol="_t", outputCol="_tf", numFeatures=width).transform(rows)
    return IDF(inputCol="_tf", outputCol=out, minDocFreq=min_docs).fit(rows).transform(rows).drop("_t", "_tf")


def word2vec(df: DataFrame, tokens: str = "tokens_lemmatized", out: str = "word2vec_features", size: int = 100, min_count: int = 5, rounds: int = 3, window: int = 5, seed: int = 42, partitions: int = 4, kept: bool = False) -> DataFrame:
    """The mean of word vectors; rows without known words keep their row and get zeros.

    partitions: in how many tasks a small table is learned from; see learning_tasks.
    kept: df is read from a stored table that holds its tokens, so they aren't stored again.
    """
    rows = df.withColumn("_t", F.coalesce(tokens, F.array().cast("array<string>")))
    learn = rows.where("size(_t) > 0").select("_t")
    # Learning reads its rows several times: tokens are made once for all of them.
    learn = learn if kept else stored(learn, "sentences")
    model = Word2Vec(inputCol="_t", outputCol=out, vectorSize=size, minCount=min_count, maxIter=rounds, windowSize=window, seed=seed, numPartitions=learning_tasks(learn, "_t", partitions)).fit(learn)
    return model.transform(rows).drop("_t")


def learning_tasks(df: DataFrame, tokens: str, least: int) -> int:
    """`least`, or one for each LEARNED tokens, but no more than the cluster has cores: tasks that learn at once grow with the table."""
    many = df.agg(F.sum(F.size(tokens).cast("long"))).first()[0] or 0
    return max(least, min(many // LEARNED, df.sparkSession.sparkContext.defaultParallelism))


def zero_embedding(df: DataFrame, size: int = 100, out: str = "word2vec_features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.array_repeat(F.lit(0.0), F.lit(size))))


def word2vec_memory(df: DataFrame, tokens: str = "tokens_lemmatized", size: int = 100) -> DataFrame:
    """(vocabulary, bytes): what a Word2Vec model would need on the driver, from an approximate distinct count."""
    out = df.select(F.explode(tokens).alias("w")).agg(F.approx_count_distinct("w").alias("vocabulary"))
    return out.withColumn("bytes", F.col("vocabulary") * size * 8 * 3)


def feature_pipeline(df: DataFrame, text: str = "text", tokens: str = "tokens_lemmatized", with_ngrams: bool = True, width: int = 5000, with_word2vec: bool = False) -> DataFrame:
    """All features in order; df is what the preprocessing pipeline returns."""
    out = df.transform(text_statistics, text).transform(temporal).transform(lexicon, text).transform(dictionary, text)
    if with_ngrams:
        out = out.transform(ngram_counts, tokens)
    out = tfidf(out, tokens, width=width)
    return word2vec(out, tokens) if with_word2vec else out


def statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, stddev, min and max of numeric columns, long: (column, count, mean, ...), in one pass."""
    names = [c for c in (columns or NUMERIC) if has(df, c)]
    packed = df.agg(*[F.struct(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev(c).alias("stddev"), F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max")).alias(c) for c in names])
    return packed.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.count"), F.col(f"{c}.mean"), F.col(f"{c}.stddev"), F.col(f"{c}.min"), F.col(f"{c}.max")) for c in names])))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) for all pairs of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)])))
