import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import TESTDATA
from tidemark.functions.columns import require
from tidemark.operators import brand, entity, features, forecast, models, quality, timeseries, topics, virality
from tidemark.plans.texts import QUERIES
from tidemark.sources import readers, sinks

DAY = dt.datetime(2024, 1, 1)
A1 = [
    (["Apple:0.95"], DAY, 1.0), (["Apple:0.85", "Samsung:0.80"], DAY + dt.timedelta(hours=2), 0.5),
    (["Samsung:0.90"], DAY + dt.timedelta(hours=3), 1.0), (["Google:0.88"], DAY + dt.timedelta(hours=4), 0.0),
]


@pytest.fixture(scope="module")
def daily(spark):
    rows = spark.createDataFrame(A1, "brands array<string>, timestamp timestamp, sentiment double")
    return brand.brand_sentiment(brand.parse_pairs(rows))


def test_brand_sentiment(daily):
    got = {r.brand: r for r in daily.collect()}
    assert (got["apple"].mention_count, got["apple"].avg_sentiment, got["apple"].sentiment_score, got["apple"].mention_duration_hours) == (2, 0.75, 50.0, 2.0)
    assert abs(got["apple"].sentiment_stddev - 0.3535533906) < 1e-9 and got["google"].sentiment_stddev is None
    assert (got["samsung"].positive_mentions, got["samsung"].negative_mentions, got["samsung"].neutral_mentions) == (1, 0, 1)
    assert got["google"].day_of_week == "Monday"


def test_share_of_voice(daily):
    got = {r.brand: r for r in brand.share_of_voice(daily, least=1).collect()}
    assert {b: r.share_of_voice for b, r in got.items()} == {"apple": 40.0, "samsung": 40.0, "google": 20.0}
    assert [got[b].sov_rank for b in ("apple", "samsung", "google")] == [1, 2, 3]
    assert got["apple"].market_position == "Leader" and got["google"].market_position == "Challenger" and got["apple"].market_avg_sentiment == 0.0


def test_pairs_with_odd_names(spark):
    rows = spark.createDataFrame([(["a:b:0.7", "plain", "x:high"],)], "brands array<string>")
    assert [(r.brand, r.confidence) for r in brand.parse_pairs(rows).collect()] == [("a:b", 0.7), ("plain", None), ("x", None)]


def test_samples_are_bounded(spark):
    rows = spark.createDataFrame([("b", 1.0, DAY + dt.timedelta(minutes=i), 1.0, f"t{i % 4}") for i in range(20)], "brand string, confidence double, timestamp timestamp, sentiment double, text string")
    r = brand.brand_sentiment(rows, samples="text").first()
    assert r.sample_texts == ["t0", "t1", "t2", "t3", "t0"] and r.unique_text_count == 4


def test_momentum_start(spark):
    rows = spark.createDataFrame([("b", DAY + dt.timedelta(days=i), s, 1) for i, s in enumerate((10.0, 14.0))], "brand string, window_start timestamp, sentiment_score double, mention_count long")
    got = brand.brand_momentum(rows, lookback=1).orderBy("window_start").collect()
    assert [(r.sentiment_momentum, r.momentum_trend) for r in got] == [(0.0, "sideways"), (4.0, "strong_uptrend")] and got[0].projection_confidence == "low"


def test_insight_counts_rivals_really_behind(spark):
    rows = spark.createDataFrame([("a", DAY, 50.0, 10), ("b", DAY, 10.0, 10), ("c", DAY, 90.0, 10)], "brand string, window_start timestamp, sentiment_score double, mention_count long")
    r = brand.insight_table(rows, "A").first()
    assert "ahead of 1/2 rivals" in r.strategic_summary and r.opportunities == ["b"] and r.threats == ["c"] and r.recommendations[0].area == "visibility"


def test_monthly_buckets(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 2, 29, 5), 1.0), (dt.datetime(2024, 2, 1), None)], "timestamp timestamp, sentiment double")
    r = timeseries.sentiment_by_time(rows, "monthly").first()
    assert (r.window_start, r.window_end, r.tweet_count) == (dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 1), 1)


def test_short_history_is_normal(spark):
    rows = spark.createDataFrame([(DAY, 1.0), (DAY + dt.timedelta(hours=1), 9.0)], "window_start timestamp, avg_sentiment double")
    assert [r.is_anomaly for r in timeseries.rolling_anomalies(rows).collect()] == [0, 0]


def test_trends_tables(spark):
    got = timeseries.sentiment_trends(readers.event_series(spark, TESTDATA))
    assert set(got) == {"hourly", "daily", "weekly", "by_hour", "by_day_of_week"} and got["daily"].count() > 0


def test_virality(spark):
    row = ("see http://x", ["a"], -0.8, 1, 0, 0, 10, 5, 99)
    df = spark.createDataFrame([row], "text string, hashtags array<string>, vader_compound double, exclamation_count int, question_count int, emoji_sentiment int, retweet_count int, favorite_count int, follower_count int")
    r = virality.text_virality(df).first()
    assert abs(r.virality_score - 0.55) < 1e-9 and r.virality_potential == "medium"
    df = df.withColumns({"text": F.lit("plain"), "hashtags": F.array().cast("array<string>"), "vader_compound": F.lit(0.5)})
    r = virality.engagement_virality(df).first()
    assert abs(r.virality_score - 0.2) < 1e-9 and r.virality_potential == "low"


def test_quality(spark):
    schema = "text string, sentiment int, timestamp timestamp"
    df = spark.createDataFrame([(None, 1, DAY), ("  ", 1, DAY), ("a", None, DAY), ("b", 1, None), ("good", 0, DAY)], schema)
    r = quality.quality_report(df).first()
    assert (r.removed_count, r.removal_percentage, r.final_count) == (4, 80.0, 1) and quality.valid_rows(df).count() == 1
    assert quality.quality_report(spark.createDataFrame([], schema)).first().removal_percentage is None


def test_balanced_sample(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 10 == 0).cast("int").alias("sentiment"))
    got = {r.sentiment: r["count"] for r in quality.balanced_sample(df, "id", 0.1).groupBy("sentiment").count().collect()}
    assert 900 < got[0] < 1100 and 900 < got[1] < 1100
    a, b = quality.hash_split(df, "id")
    assert a.count() + b.count() == 20_000 and a.join(b, "id").count() == 0


def test_topics(spark):
    df = spark.createDataFrame([("t", y) for y in (0.0, 1.0) * 25], "dominant_topic string, sentiment double")
    r = topics.polarising(df).first()
    assert r.polarization == 0.5 and abs(r.controversy - 0.5 * r.sentiment_stddev) < 1e-12
    assert topics.polarising(df.limit(10)).count() == 0
    grow = spark.createDataFrame([(DAY + dt.timedelta(days=d), "x") for d, n in enumerate((2, 3, 3, 6)) for _ in range(n)], "timestamp timestamp, topic string")
    assert [r.growth_rate for r in topics.emerging_topics(grow, "topic", "1 day", 0.4).orderBy("window_start").collect()] == [0.5, 1.0]
    edges = topics.topic_edges(spark.createDataFrame([([1, 2],), ([2, 1, 3],), ([4],)], "t array<int>"), "t").collect()
    assert {(r.a, r.b): r.docs for r in edges} == {(1, 2): 2, (1, 3): 1, (2, 3): 1}


BRANDS = [("Apple", "technology", ["aapl"], ["iphone", "macbook"], ["ios", "smartphone", "tablet"]), ("Samsung", "technology", [], ["galaxy"], ["android"]), ("Tesla", "automotive", [], ["model s"], ["electric"])]


@pytest.fixture(scope="module")
def terms(spark):
    return entity.terms_of(spark.createDataFrame(BRANDS, "brand string, industry string, aliases array<string>, products array<string>, keywords array<string>"))


def test_recognise(spark, terms):
    texts = spark.createDataFrame([(1, "I love my iPhone and the Samsng Galaxy"), (2, "nothing here"), (3, None), (4, ""), (5, "a smartphone or tablet"), (6, "Tesla Model S")], "id long, text string")
    got = {r.id: {b.brand: (round(b.confidence, 2), b.match_type) for b in r.brands} for r in entity.recognise(texts, terms).collect()}
    assert got[1]["Apple"] == (1.0, "exact") and got[1]["Samsung"] == (1.0, "exact") and set(got) == {1, 5, 6}
    assert got[5] == {"Apple": (0.7, "context")} and got[6] == {"Tesla": (1.0, "exact")}
    full = entity.detect_brands(texts.withColumnRenamed("id", "tweet_id"), terms, "tweet_id")
    assert full.count() == 6 and full.where("tweet_id = 3").first().detected_brands == []


def test_typo(spark, terms):
    """Both words are alike to a term: "phone" stands in "iphone", and "samsng" lacks a letter."""
    got = {b.brand: b for b in entity.recognise(spark.createDataFrame([(1, "my samsng phone")], "id long, text string"), terms).first().brands}
    assert set(got) == {"Samsung", "Apple"} and all(b.match_type == "fuzzy" and b.confidence < 1 for b in got.values())
    assert entity.recognise(spark.createDataFrame([(1, "my samsng")], "id long, text string"), terms).first().brands[0].brand == "Samsung"


def test_similar_terms_of_any_start_and_length(spark):
    terms = entity.terms_of(spark.createDataFrame([("Thing", "goods", ["heatnt"], ["ration", "internationally"], [])], "brand string, industry string, aliases array<string>, products array<string>, keywords array<string>"))
    # The first letter differs, or four letters are missing: 80, 83.3, 83.3 and 73.3 by the ratio.
    for word, term in (("whing", "thing"), ("reatnt", "heatnt"), ("pation", "ration"), ("internation", "internationally")):
        got = entity.matches(spark.createDataFrame([(1, f"x {word} y")], "id long, text string"), terms).collect()
        assert [(r.chunk, r.term) for r in got] == [(word, term)]
    words = ["whing", "thin", "rationing", "heat", "stationary", "internation", "thing"]
    each = spark.createDataFrame([(w,) for w in words], "chunk string")
    for least in (40.0, 70.0, 75.0):
        every = each.crossJoin(terms.select("term")).where(entity.ratio(F.col("chunk"), F.col("term")) >= least)
        assert set(entity.similar_pairs(each, terms, least).select("chunk", "term").collect()) == set(every.collect())


def test_brand_recognition_query_is_whole(spark, tmp_path):
    spark.createDataFrame([(1, "pation", "en", "x")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r.brands for r in QUERIES["brand_recognition"](spark, str(tmp_path)).collect()] == ["Onion:0.83"]


def test_products_and_context(spark, terms):
    texts = spark.createDataFrame([(1, "iphone 12 beats galaxy")], "id long, text string")
    assert {(r.product, r.brand) for r in entity.extract_products(texts, terms).collect()} == {("iphone", "Apple"), ("galaxy", "Samsung")}
    df = spark.createDataFrame([(1, "Apple is better than Samsung", ["Apple", "Samsung", "Tesla"])], "id long, text string, brands array<string>")
    rivals = entity.competitor_map(spark.createDataFrame([("Apple", "Tesla")], "brand string, competitor string"))
    got = {(r.brand_a, r.brand_b): r.context for r in entity.competitive_context(df, rivals, terms.select("brand", "industry")).collect()}
    assert got == {("apple", "samsung"): "comparison", ("apple", "tesla"): "comparison"}


def test_brand_info(spark, terms):
    got = {r.kind: r.terms for r in entity.brand_info(terms, "APPLE").collect()}
    assert got["product"] == ["iphone", "macbook"] and got["name"] == ["apple"]


def test_benchmark(spark):
    df = spark.range(2000).select("id", (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 20 > 9).cast("int").alias("sentiment"))
    got = models.benchmark(spark, df, "id", ["x"], (0.5, 1.0), ("logistic_regression",))
    r = models.benchmark_summary(got).first()
    assert r.runs == 2 and r.avg_accuracy > 0.95


def test_disambiguation(spark):
    df = spark.createDataFrame([(1, "apple pie phone", "Apple", "tech", 0.8, 0, 2), (1, "apple pie phone", "Pie", "food", 0.6, 1, 1)], "id long, text string, brand string, industry string, confidence double, position int, n int")
    words = spark.createDataFrame([("tech", "phone"), ("food", "pie")], "industry string, word string")
    got = entity.disambiguate(df, words).collect()
    assert [(r.brand, round(r.confidence, 2)) for r in got] == [("Apple", 0.85)]


def test_dictionary_file(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"industries": {"technology": {"brands": {"apple": {"name": "Apple", "aliases": ["aapl"], "products": ["iphone"], "keywords": ["ios", "mobile"], "competitors": ["Samsung"]}}}}}')
    got = {(r.term, r.kind) for r in entity.load_dictionary(spark, str(tmp_path / "d.json")).collect()}
    assert got == {("apple", "name"), ("aapl", "alias"), ("iphone", "product"), ("mobile", "keyword")}
    assert entity.load_competitors(spark, str(tmp_path / "d.json")).collect() == [("apple", "samsung")]


def test_features(spark):
    df = spark.createDataFrame([(1, "Great phone!", ["great", "phone"], dt.datetime(2024, 1, 6, 6)), (2, None, None, None)], "id long, text string, tokens_lemmatized array<string>, timestamp timestamp")
    got = {r.id: r for r in features.feature_pipeline(df, width=64).collect()}
    assert (got[1].hour_sin, round(got[1].hour_cos, 9), got[1].is_weekend, got[1].time_of_day) == (1.0, 0.0, 1, "morning") and got[1]["2gram_count"] == 1
    assert got[1].vader_compound > 0 and got[1].product_categories == ["phone"] and got[2].time_of_day == "unknown" and got[2]["2gram_count"] == 0
    assert features.zero_embedding(df, 3).first().word2vec_features.toArray().tolist() == [0, 0, 0]
    assert features.temporal(df.drop("timestamp")).first().hour_cos == 1.0


def test_forecast_and_anomalies(spark):
    rows = [("s", DAY + dt.timedelta(days=i), float(i + 3 * (i % 7 == 0))) for i in range(60)] + [("short", DAY, 1.0)]
    df = spark.createDataFrame(rows, "k string, window_start timestamp, v double")
    got = forecast.forecast(df, "k", "v", ahead=5).orderBy("ds").toPandas()
    assert len(got) == 65 and set(got.k) == {"s"} and (got.yhat_lower <= got.yhat).all() and abs(got.yhat.iloc[-1] - 64) < 4
    odd = spark.createDataFrame([("s", DAY + dt.timedelta(days=i), 50.0 if i == 30 else float(i % 5)) for i in range(60)], "k string, window_start timestamp, v double")
    top = forecast.isolation_anomalies(odd, "k", ["v"]).orderBy(F.desc("anomaly_score")).first()
    assert top.window_start == DAY + dt.timedelta(days=30) and top.is_anomaly == 1


def test_unit_root(spark):
    rng = np.random.default_rng(0)
    noise, walk = rng.normal(size=200), rng.normal(size=200).cumsum()
    df = spark.createDataFrame([(k, DAY + dt.timedelta(days=i), float(x)) for k, s in (("noise", noise), ("walk", walk)) for i, x in enumerate(s)], "k string, window_start timestamp, v double")
    assert {r.k: r.stationary for r in forecast.unit_root(df, "k", "v").collect()} == {"noise": True, "walk": False}


def test_models(spark):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"), F.rand(3).alias("z"), (F.col("id") % 20 > 9).cast("int").alias("sentiment"))
    train, test = quality.hash_split(df, "id")
    got = models.compare(spark, (train, test), ["x", "z"], ("logistic_regression", "naive_bayes", "nonsense")).collect()
    assert models.best_model(spark.createDataFrame(got)) == got[0].model
    assert got[0].accuracy > 0.9 and got[-1].model == "nonsense" and got[-1].error
    fitted = [models.train(train, n, ["x", "z"])[0] for n in ("logistic_regression", "random_forest")]
    assert models.soft_vote(fitted, test, "id").where("prediction <> cast(id % 20 > 9 as double)").count() < 10
    with pytest.raises(ValueError):
        models.classifier("nonsense")


def test_sources_and_sinks(spark, tmp_path):
    line = '"0","1","Mon Apr 06 22:19:45 PDT 2009","NO_QUERY","u","caf\xe9 hi"\n"4","2","bad date","NO_QUERY","u","x"\n"2","3","Mon Apr 06 22:19:45 PDT 2009","q","u","  "\n'
    (tmp_path / "p.csv").write_bytes(line.encode("latin-1"))
    got = readers.read_posts(spark, str(tmp_path / "p.csv")).orderBy("tweet_id").collect()
    assert [(r.text, r.sentiment, r.year) for r in got] == [("café hi", 0, "2009"), ("x", 1, None)]
    df = readers.rows(spark, [(1, "2024", "01"), (2, "2024", "02")], "id int, year string, month string")
    sinks.write_by_month(df, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).where("month = 2").count() == 1
    for f in ("parquet", "csv", "json"):
        sinks.save(df, str(tmp_path / f), f)
    with pytest.raises(ValueError):
        sinks.save(df, str(tmp_path / "x"), "xml")
    stages = sinks.Stages(spark, str(tmp_path / "s"))
    assert not stages.has("a")
    stages.save("a", df, note=1)
    assert sinks.Stages(spark, str(tmp_path / "s")).has("a") and stages.metadata("a")["note"] == 1 and stages.load("a").count() == 2
    assert [len(b) for b in sinks.pandas_batches(df, 1)] == [1, 1]
    with pytest.raises(ValueError, match="nope"):
        require(df, "nope")


def test_scan_is_pruned_and_native(spark):
    plan = brand.brand_sentiment(readers.brand_mentions(spark, TESTDATA), "1 week")._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "p_retailprice" not in plan and "Python" not in plan


def test_word2vec_query_returns_mean_vectors(spark, tmp_path):
    texts = ["alpha", "beta", "alpha beta", "seldom"] + ["alpha beta gamma"] * 20
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: np.array(r.word2vec_features) for r in QUERIES["word2vec_similar"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) and all(v.shape == (100,) for v in got.values())
    assert np.abs(got[0]).max() > 0 and np.allclose(got[2], (got[0] + got[1]) / 2, atol=1e-6) and not np.allclose(got[0], got[1])
    assert not got[3].any() and np.allclose(got[4], got[23])


def test_word2vec_query_makes_tokens_once(spark, tmp_path):
    source = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(["alpha beta"] * 5 + [None, "", "..."])], "conv_id long, turn long, text string").write.parquet(source)
    got = QUERIES["word2vec_similar"](spark, str(tmp_path))
    # What is left for the result neither reads nor cuts texts again, and rows without words are in it.
    assert source not in " ".join(got.inputFiles()) and "regexp_replace" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.conv_id: bool(np.any(r.word2vec_features)) for r in got.collect()} == {i: i < 5 for i in range(8)}


def test_context_keywords_may_be_misspelt(spark, terms):
    texts = spark.createDataFrame([(1, "a smartfone or tablett"), (2, "one smartphone smartphone"), (3, "Tesla and a smartphone or tablet")], "id long, text string")
    got = {r.id: {b.brand: (round(b.confidence, 2), b.match_type) for b in r.brands} for r in entity.recognise(texts, terms).collect()}
    assert got == {1: {"Apple": (0.7, "context")}, 3: {"Tesla": (1.0, "exact"), "Apple": (0.7, "context")}}
    assert 1 not in {r.id for r in entity.recognise(texts, terms, fuzzy=None).collect()}


def test_products_by_ratio(spark, terms):
    texts = spark.createDataFrame([(1, "my iphnoe 12 is old"), (2, "the s model of Tesla"), (3, "a galaxy"), (4, None)], "id long, text string")
    got = {(r.id, r.product, r.brand): round(r.confidence, 3) for r in entity.extract_products(texts, terms).collect()}
    assert got[3, "galaxy", "Samsung"] == 1.0 and got[2, "model s", "Tesla"] == 1.0 and 0.7 <= got[1, "iphone", "Apple"] < 1
    seen = spark.createDataFrame([(1, "Apple"), (3, "Samsung")], "id long, brand string")
    more = {(r.id, r.product): r.confidence for r in entity.extract_products(texts, terms, brands=seen).collect()}
    assert abs(more[1, "iphone"] - min(got[1, "iphone", "Apple"] * 1.1, 1)) < 1e-3 and more[3, "galaxy"] == 1.0
    # Against every phrase and term.
    words = "my iphnoe 12 is old".split()
    phrases = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    every = spark.createDataFrame([(p,) for p in phrases if len(p) > 2], "chunk string").crossJoin(entity.product_terms(terms)).where(entity.token_sort_ratio(F.col("chunk"), F.col("term")) >= 70)
    near = entity.similar_pairs(spark.createDataFrame([(p,) for p in phrases if len(p) > 2], "chunk string"), entity.product_terms(terms), 70.0, words_sorted=True)
    assert {(r.chunk, r.term) for r in near.collect()} == {(r.chunk, r.term) for r in every.collect()}
    full = entity.detect_products(entity.detect_brands(texts.withColumnRenamed("id", "tweet_id"), terms, "tweet_id"), terms, "tweet_id")
    rows = {r.tweet_id: r.p for r in full.select("tweet_id", entity.encode_products(F.col("detected_products")).alias("p")).collect()}
    assert rows[3] == ["galaxy|Samsung:100.00"] and rows[4] == []


def test_comparisons_by_ratio(spark, terms):
    df = spark.createDataFrame([(1, "Apple is beter than Samsung", ["Apple", "Samsung"]), (2, "Apple and Samsung", ["Apple", "Samsung"]), (3, "Apple beats all", ["Apple"])], "id long, text string, brands array<string>")
    rivals = entity.competitor_map(spark.createDataFrame([("Apple", "Samsung")], "brand string, competitor string"))
    side = terms.select("brand", "industry")
    assert {r.id: r.context for r in entity.competitive_context(df, rivals, side).collect()} == {1: "comparison", 2: "co-mention"}
    assert {r.id: r.context for r in entity.competitive_context(df, rivals, side, phrases=None).collect()} == {1: "co-mention", 2: "co-mention"}


def test_industry_words_may_be_misspelt(spark):
    df = spark.createDataFrame([(1, "apple softwre here", "Apple", "tech", 0.8, 0, 1), (2, "apple unphones", "Apple", "tech", 0.8, 0, 1)], "id long, text string, brand string, industry string, confidence double, position int, n int")
    words = spark.createDataFrame([("tech", "software"), ("tech", "phone")], "industry string, word string")
    assert {r.id: round(r.confidence, 2) for r in entity.disambiguate(df, words).collect()} == {1: 0.85, 2: 0.8}


def test_samples_are_bounded_and_ordered(spark):
    rows = spark.range(1000).select((F.col("id") % 2).cast("string").alias("topic"), F.format_string("t%04d", "id").alias("text"), F.lit(0.9).alias("virality_score"), F.lit(1.0).alias("sentiment"), F.when(F.col("id") < 900, "b").otherwise("c").alias("brand"), F.lit(1.0).alias("confidence"), F.lit(DAY).alias("timestamp"))
    got = {r.topic: r for r in topics.viral_topics(rows, "topic", samples="text").collect()}
    assert got["1"].viral_count == 500 and got["1"].sample_texts == [f"t{k:04d}" for k in (1, 3, 5, 7, 9)]
    assert {r.topic: r.sample_texts for r in topics.topic_sentiment(rows, "topic", samples="text").collect()}["0"] == [f"t{k:04d}" for k in (0, 2, 4, 6, 8)]
    one = brand.brand_sentiment(rows, samples="text").where("brand = 'b'").first()
    assert one.mention_count == 900 and one.sample_texts == [f"t{k:04d}" for k in range(5)] and one.unique_text_count == 5
    plan = brand.brand_sentiment(rows, samples="text")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_model_names_and_columns(spark):
    assert models.chosen("SVM") == "svm" and models.chosen("mlp") == "mlp" and models.chosen("nonsense") == models.chosen("Random Forest") == "random_forest"
    assert len(models.FEATURES) == 17 and models.pipeline("svm").getStages()[0].getInputCols() == models.FEATURES


def test_token_ids(spark):
    rows = spark.createDataFrame([(1, ["a", "x", "b", "a"]), (2, None), (3, []), (4, ["b"] * 9)], "id long, tokens array<string>")
    known = spark.createDataFrame([("a", 1), ("b", 2)], "word string, index int")
    assert {r.id: r.ids for r in models.token_ids(rows, known, "id", length=5).collect()} == {1: [0, 0, 1, 2, 1], 2: [0] * 5, 3: [0] * 5, 4: [2] * 5}


def test_pandas_batches(spark):
    df = spark.range(2_500).select("id", F.array("id").alias("a"), F.when(F.col("id") % 2 == 0, "x").alias("s")).repartition(3)
    got = list(sinks.pandas_batches(df, 1_000))
    assert [len(b) for b in got] == [1_000, 1_000, 500] and sorted(x for b in got for x in b["id"]) == list(range(2_500))
    assert list(sinks.pandas_batches(df.limit(0))) == []


def test_tfidf_weights_against_plain_counts(spark):
    import math

    docs = {1: ["a", "b", "a"], 2: ["b", "c"], 3: None, 4: ["d"]}
    rows = spark.createDataFrame([(i, t) for i, t in docs.items()], "id long, tokens array<string>")
    got = {r.id: r.tfidf_features.toArray() for r in features.tfidf(rows, "tokens", width=1 << 12, min_docs=1).collect()}
    df = {"a": 1, "b": 2, "c": 1, "d": 1}
    for i, words in docs.items():
        want = sorted((words or []).count(w) * math.log(5 / (df[w] + 1)) for w in set(words or []))
        assert np.allclose(sorted(x for x in got[i] if x), want)


def test_word2vec_learns_in_more_tasks_the_more_tokens(spark):
    few, many = (spark.range(n).selectExpr("array_repeat(cast(id AS string), 1000) AS tokens") for n in (100, 10 * features.LEARNED // 1000))
    cores = spark.sparkContext.defaultParallelism
    assert features.learning_tasks(few, "tokens", 1) == 1 and features.learning_tasks(few, "tokens", 4) == 4 and features.learning_tasks(few.limit(0), "tokens", 4) == 4
    assert features.learning_tasks(many, "tokens", 1) == min(10, cores)
