import re

import pandas as pd
from pyspark.sql import functions as F

from tests.oracle import check
from tidemark.functions import text as X
from tidemark.functions.lexicon import score
from tidemark.operators import features, preprocess
from tidemark.plans.texts import QUERIES, SQL


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first()["r"]


def test_clean_text_and_hashtags(spark):
    t = "Check HTTP://x.co @Bob #Fun  now"
    assert one(spark, t, X.clean_text) == "check URL USER fun now"
    assert one(spark, t, X.hashtags) == ["Fun"]
    assert one(spark, None, X.hashtags) == [] and one(spark, None, X.clean_text) is None


def test_tokens_are_a_set_in_order(spark):
    assert one(spark, "a_b a b!!", X.tokens) == ["a", "b"]


def test_stop_words(spark):
    assert one(spark, ["The", "cat", "cat"], X.without_stop_words, "array<string>") == ["cat", "cat"]
    assert one(spark, None, X.without_stop_words, "array<string>") == []
    assert "être" in X.stop_words("fr") and X.stop_words("xx") == X.STOP_WORDS


def test_lemmas(spark):
    words = "running stopped cities went boss tables faster quickly kindness".split()
    assert one(spark, words, X.lemmas, "array<string>") == "run stop city go boss table fast quick kind".split()


def test_emoji(spark):
    assert one(spark, "😊😎😢👍", X.emoji_score) == 1
    assert one(spark, "🤯", X.emoji_score) == 1 and one(spark, None, X.emoji_score) == 0
    assert one(spark, "ok 👍 x🚀y", X.emoji_words) == "ok good x y"


def test_language(spark):
    lang = lambda t: tuple(one(spark, t, X.detect_language))
    assert lang("short") == ("unknown", 0.0) and lang(None) == ("unknown", 0.0) and lang("xyz qwerty") == ("unknown", 0.0)
    assert lang("the cat is on the mat and it was good")[0] == "en"
    assert lang("el perro de la casa que no está en la calle")[0] == "es"
    assert lang("le chat dans la maison est sur il et elle qui")[0] == "fr"
    assert lang("привет мир снова здесь") == ("ru", 0.7)


def test_keyword_sentiment(spark):
    df = spark.createDataFrame([("I love it",), ("so bad",), ("well",), (None,), ("good and bad",)], "text string")
    r = X.sentiment_summary(df).first()
    assert (r.total, r.positive, r.negative, r.neutral) == (5, 2, 1, 2) and abs(r.avg_confidence - 0.78) < 1e-9


def test_statistics_of_empty_texts(spark):
    for v in ("", None):
        assert one(spark, v, X.uppercase_ratio) == 0.0 and one(spark, v, X.punctuation_density) == 0.0 and one(spark, v, lambda c: X.count_of(c, "!")) == 0
    assert one(spark, "AB c!", X.uppercase_ratio) == 0.4


def test_dictionary(spark):
    t = "My iPhone and the Galaxy; apple vs samsung, apple. Model S is a car"
    assert one(spark, t, X.brand_mentions) == ["apple", "iphone", "samsung", "galaxy", "model s"]
    assert one(spark, t, X.brand_count) == 6 and one(spark, t, X.categories) == ["car"]
    assert one(spark, t, lambda c: X.compares_rivals(X.brand_mentions(c))) == 1 and one(spark, None, X.brand_mentions) == []


def test_ngrams(spark):
    assert one(spark, ["a", "b", "c"], lambda c: X.ngrams(c, 2), "array<string>") == ["a b", "b c"]
    assert one(spark, ["a"], lambda c: X.ngrams(c, 2), "array<string>") == []


def test_lexicon_rules():
    lex = {"good": 1.9, "bad": -2.5}
    assert score(None, lex) == (0, 0, 0, 0) and score("", lex) == (0, 0, 0, 1)
    plain, very, negated, loud = (score(t, lex)[0] for t in ("it is good", "it is very good", "it is not good", "it is GOOD"))
    assert negated < 0 < plain < very and loud > plain and score("bad!!!", lex)[0] < score("bad", lex)[0]


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "The cat")], "tweet_id long, text string")
    plan = preprocess.pipeline(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_pipeline_columns(spark):
    docs = spark.createDataFrame([(1, "The cat is running on the tables of the house"), (2, None)], "tweet_id long, text string")
    got = preprocess.pipeline(docs).collect()
    assert [r.tweet_id for r in got] == [1] and got[0].text_processed == "cat run table house" and got[0].token_count == 4


def test_detector_stands_once_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "The cat")], "tweet_id long, text string")
    plan = preprocess.pipeline(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?:the|be|to|") == 1 and plan.count("regexp_count") <= 6
    assert preprocess.pipeline(docs, languages=None)._jdf.queryExecution().optimizedPlan().toString().count("regexp_count") == 0


def test_terms_that_overlap(spark):
    terms = ["model s", "s class", "model", "c++"]
    t = "a model s class and c++ code, model models"
    assert not X._apart(terms) and X._apart(X.BRAND_TERMS)
    assert one(spark, t, lambda c: X.brand_mentions(c, terms)) == ["model s", "s class", "model"]
    assert one(spark, t, lambda c: X.brand_count(c, terms)) == 4
    # One pass over the text finds what a test of each term finds.
    words = X.BRAND_TERMS[:12] + ["applepie", "my", "model"]
    for k in range(40):
        text = " ".join(words[(k * 7 + i * i) % len(words)] for i in range(9))
        alone = [t for t in X.BRAND_TERMS if one(spark, text, lambda c, t=t: F.rlike(c, F.lit(X._quoted(t))))] if k < 3 else None
        if alone is not None:
            assert one(spark, text, X.brand_mentions) == alone


def test_language_shares_equal_word_by_word_counts(spark):
    texts = ["the  cat\tis on the mat and the dog", "El perro de la casa que no está en la calle", "le chat dans la maison est sur il et elle qui va où", "thethe and,the the, was singing walked", "Été là où ça été fait ing ed", "x ing yed zing the the"]
    for t in texts:
        words = t.lower().split()
        share = lambda known: sum(w in known for w in words) / len(words)  # noqa: E731, B023
        en, es, fr = share(X.COMMON_EN), share(X.COMMON_ES), share(X.COMMON_FR)
        bonus = sum(0.1 for p in X.ENGLISH_SIGNS if re.search(p, t.lower()))
        en = (en + min(bonus, 0.3)) * (0.8 if sum(ord(c) > 127 for c in t) / len(t) > 0.1 else 1.0)
        want = ("en", min(en * 2, 0.95)) if en > max(es, fr) and en > 0.15 else ("es", es * 2) if es > fr and es > 0.15 else ("fr", fr * 2) if fr > 0.15 else ("unknown", 0.0)
        got = tuple(one(spark, t, X.detect_language))
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-9, t


def test_language_queries_equal_their_sql_beside_letters_outside_ascii(spark, tmp_path):
    tail = " der und la den son"
    texts = [
        "étheö a été là où nous the ö" + tail, "öis éhave üwill sér the cats" + tail, "verßing übered xéing the" + tail, "thé aé anö isü areé" + tail, "is\u00a0the\u00a0cat have been walking" + tail,
        "the\u00a0cat will be the\u2003dog" + tail, "the\x0bcat is\x0bthe a\x0bb" + tail, "\u00a0\u2003 the cat \u00a0\u00a0\u00a0\u00a0", "the cat is on the mat and it was good", "éed öing the one" + tail, "le de éthe leaiqued où", "", None,
    ]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "en", "source": "web"}).to_parquet(tmp_path / "documents.parquet")
    for name in ("detected_language", "english_posts", "language_distribution"):
        check(spark, QUERIES[name], SQL[name], str(tmp_path))


def test_words_and_signs_are_looked_up_not_searched(spark):
    docs = spark.createDataFrame([(1, "x", ["Was", "running", "the", None, "", "flies", "cities", "glass", "boxes", "done", "quickly", "station", "É", "tea"])], "id long, text string, w array<string>")
    out = docs.select(X.lemmas(X.without_stop_words(F.col("w"))).alias("w"), X.emoji_score(F.col("text")).alias("e"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan and "array_contains" not in plan and "map_contains_key" not in plan
    least = min(map(ord, X.EMOJI_GOOD + X.EMOJI_MILD + X.EMOJI_BAD))
    assert least > 0xFFFF and f"x{{{least:x}}}" in plan
    assert out.first()["w"] == ["run", "", "fly", "city", "glass", "boxe", "do", "quick", "sta", "É", "tea"]
    counts = features.ngram_counts(spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],), (None,)], "t array<string>"), "t")
    assert [(r["2gram_count"], r["3gram_count"]) for r in counts.collect()] == [(2, 1), (0, 0), (0, 0), (0, 0)]
    assert [(len(r["2grams"]), len(r["3grams"])) for r in counts.collect()] == [(2, 1), (0, 0), (0, 0), (0, 0)]
    assert "slice" not in counts.select("2gram_count", "3gram_count")._jdf.queryExecution().optimizedPlan().toString()
