"""The area under the ROC curve from sorted ranges of scores."""

import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from tidemark.operators import models


def plain(rows):
    good, bad = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad)) if good and bad else None


@pytest.mark.parametrize("many", [4, 10_000])  # many ties, and hardly any
def test_against_all_pairs(spark, many):
    rng = random.Random(many)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(many) / 7, rng.choice([0, 0, 1, None])) for _ in range(900)] + [("one class", 1.0, 1), ("b", None, 1), ("b", 0.5, 2)]
    df = spark.createDataFrame(rows, "k string, score double, label int")
    got = {r.k: (r.rows, r.auc) for r in models.auc(df, key=["k"]).collect()}
    kept = [r for r in rows if r[1] is not None and r[2] in (0, 1)]
    for k in {r[0] for r in kept}:
        own = [r[1:] for r in kept if r[0] == k]
        want = plain(own)
        assert got[k][0] == len(own) and (got[k][1] is None if want is None else abs(got[k][1] - want) < 1e-12)
    assert abs(models.auc(df).first().auc - plain([r[1:] for r in kept])) < 1e-12
    assert models.auc(df.limit(0)).count() == 0


def test_as_the_evaluator_has_it_and_one_scoring(spark):
    df = spark.range(3000).select("id", (F.col("id") % 40).cast("double").alias("x"), ((F.col("id") * 7919) % 100 < F.col("id") % 40 + 30).cast("int").alias("sentiment"))
    model, _ = models.train(df, "logistic_regression", ["x"])
    scored = model.transform(models.labelled(df))
    got = models.evaluate(model, df)
    assert abs(got["auc"] - BinaryClassificationEvaluator(labelCol="label").evaluate(scored)) < 1e-9
    assert abs(got["accuracy"] - scored.where("label = prediction").count() / 3000) < 1e-12


def test_folds_go_by_id(spark):
    df = spark.range(600).select((F.col("id") % 200).alias("doc"))
    got = models.folds(df, "doc", 4).groupBy("doc").agg(F.countDistinct("fold").alias("n"), F.max("fold").alias("f")).collect()
    assert {r.n for r in got} == {1} and {r.f for r in got} == {0, 1, 2, 3}
