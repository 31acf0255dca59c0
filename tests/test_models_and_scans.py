"""Saved topic models, and scans that lose no line."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tests.conftest import TESTDATA
from tidemark.operators import models, topics
from tidemark.plans.texts import _turns
from tidemark.sources import readers
from tidemark.sources.shared import stored_model


def test_a_loaded_model_gives_the_topics_of_the_saved_one(spark):
    docs = _turns(spark, TESTDATA)
    model = topics.lda_pipeline(k=4, rounds=3, min_df=2, max_df=0.95).fit(docs)
    again = stored_model(spark, model, "topics-test")
    scored = [topics.with_topics(m, docs).select("conv_id", "turn", "dominant_topic", vector_to_array("topic_distribution").alias("p")).orderBy("conv_id", "turn").collect() for m in (model, again)]
    assert scored[0] and [r.dominant_topic for r in scored[0]] == [r.dominant_topic for r in scored[1]]
    assert all(abs(x - y) < 1e-9 for a, b in zip(*scored, strict=True) for x, y in zip(a.p, b.p, strict=True))
    assert all(abs(sum(r.p) - 1) < 1e-9 and r.p[r.dominant_topic] == max(r.p) for r in scored[1])


def test_every_line_is_accounted_for(spark, tmp_path):
    good = '0,1,Mon Apr 06 22:19:45 PDT 2009,NO_QUERY,me,"a ""quoted"", text"'
    lines = [good, '4,2,Mon Apr 06 22:19:45 PDT 2009,NO_QUERY,me,"more"', "x,3,d,q,u,t", "4,4", '4,5,d,q,u," "', "2,6,d,q,u,neutral", "4,7,d,q,u,t,one too many"]
    (tmp_path / "posts.csv").write_text("\n".join(lines) + "\n", encoding="latin-1")
    scan = readers.scan_posts(spark, str(tmp_path))
    assert {r.kind: r.n for r in readers.scan_counts(scan).collect()} == {"0": 1, "1": 1, "rejected": 3, "blank": 1, "unlabelled": 1}
    assert sorted(r.line for r in readers.rejects(scan).collect()) == sorted([lines[2], lines[3], lines[6]]), "all of a broken line is kept"
    got = {r.tweet_id: (r.sentiment, r.text) for r in readers.accepted(scan).collect()}
    assert got == {"1": (0, 'a "quoted", text'), "2": (1, "more"), "6": (None, "neutral")}


def test_equal_rows_are_learned_and_scored_once(spark):
    """A row with its number is what as many rows are, for the models, the metrics and the area; the forest reads all rows."""
    k = F.col("id")
    df = spark.range(4000).select((k % 7).cast("double").alias("x"), (k % 3).cast("double").alias("y"), ((k % 7 + k % 5) > 5).cast("int").alias("sentiment")).coalesce(2)
    alike = models.with_counts(df, ["x", "y", "sentiment"]).cache()
    assert alike.count() <= 42 and alike.agg(F.sum(models.MANY)).first()[0] == 4000
    for name in ("naive_bayes", "logistic_regression", "svm", "gradient_boosting", "random_forest"):
        plain, counted = models.train(df, name, ["x", "y"])[0], models.train(df, name, ["x", "y"], alike=alike)[0]
        assert counted.stages[-1].uid and (name == "random_forest") == (counted.stages[-1].isDefined("weightCol") is False)
        a, b = models.evaluate(plain, df), models.evaluate(counted, alike)
        assert a.keys() == b.keys() and all(abs(a[m] - b[m]) < 1e-6 for m in a), name
        one, two = (m.transform(alike).select("x", "y", F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("s")).distinct().orderBy("x", "y").collect() for m in (plain, counted))
        assert all(abs(p.s - q.s) < 1e-3 for p, q in zip(one, two, strict=True)), name
