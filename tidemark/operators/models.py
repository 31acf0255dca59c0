"""Classic classifiers: one scaler fitted inside each pipeline, relational evaluation, comparison and selection."""

from __future__ import annotations

import time

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import has
from tidemark.operators.quality import place
from tidemark.sources.shared import stored

#: The columns that models take unless told otherwise, and the names under which models are asked for.
FEATURES = [
    "text_length", "processed_length", "token_count", "emoji_sentiment", "exclamation_count", "question_count", "uppercase_ratio", "punctuation_density",
    "vader_compound", "vader_positive", "vader_negative", "vader_neutral", "hour_sin", "hour_cos", "is_weekend", "2gram_count", "3gram_count",
]
NAMES = {"Naive Bayes": "naive_bayes", "Logistic Regression": "logistic_regression", "Random Forest": "random_forest", "Gradient Boosting": "gradient_boosting", "SVM": "svm"}
#: The column of how many equal rows one stands for.
MANY = "_many"
#: Models whose fit is a sum over rows, so that a row of weight n stands for n equal ones.
WEIGHTED = ("naive_bayes", "logistic_regression", "gradient_boosting", "svm")
MODELS = ("naive_bayes", "logistic_regression", "random_forest", "gradient_boosting", "svm", "mlp")


def classifier(name: str, width: int = 0, seed: int = 42):
    common = {"featuresCol": "features", "labelCol": "label"}
    made = {
        "naive_bayes": lambda: NaiveBayes(modelType="gaussian", **common), "logistic_regression": lambda: LogisticRegression(maxIter=100, **common), "random_forest": lambda: RandomForestClassifier(seed=seed, **common),
        "gradient_boosting": lambda: GBTClassifier(seed=seed, **common), "svm": lambda: LinearSVC(maxIter=100, **common), "mlp": lambda: MultilayerPerceptronClassifier(layers=[width, 16, 2], seed=seed, **common),
    }
    if name not in made:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(made)}")
    return made[name]()


def chosen(name: str) -> str:
    """A model's name from either form; one that isn't known stands for the random forest."""
    return name if name in MODELS else NAMES.get(name, "random_forest")


def pipeline(name: str, features: list[str] | None = None, seed: int = 42) -> Pipeline:
    """Assemble (FEATURES unless given), scale (to 0..1 for naive Bayes, else to mean 0 and spread 1) and classify.

    Naive Bayes is Gaussian: test rows outside the range of the training rows scale to negative values, which it takes.
    """
    features = list(features or FEATURES)
    scale = MinMaxScaler(inputCol="raw_features", outputCol="features") if name == "naive_bayes" else StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw_features", handleInvalid="skip"), scale, classifier(name, len(features), seed)])


def labelled(df: DataFrame, label: str = "sentiment") -> DataFrame:
    return df.where(F.col(label).isin(0, 1)).withColumn("label", F.col(label).cast("double"))


def grid(name: str, p: Pipeline) -> list:
    c, b = p.getStages()[-1], ParamGridBuilder()
    if name == "naive_bayes":
        b = b.addGrid(c.smoothing, [0.5, 1.0, 1.5])
    elif name in ("logistic_regression", "svm"):
        b = b.addGrid(c.regParam, [0.01, 0.1])
    elif name == "random_forest":
        b = b.addGrid(c.numTrees, [50, 100]).addGrid(c.maxDepth, [5, 10])
    elif name == "gradient_boosting":
        b = b.addGrid(c.maxDepth, [3, 5]).addGrid(c.maxIter, [20])
    return b.build()


def with_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct rows of these columns, each with how many rows it stands for (MANY)."""
    return df.groupBy(*columns).agg(F.count("*").alias(MANY))


def confusion(scored: DataFrame) -> DataFrame:
    """(label, prediction, n); rows of with_counts() stand for as many as they say."""
    return scored.groupBy("label", "prediction").agg((F.sum(MANY) if has(scored, MANY) else F.count("*")).alias("n"))


def metrics(scored: DataFrame) -> DataFrame:
    """accuracy, weighted precision, recall and F1 as one row, from the confusion counts alone, which are made once."""
    said = F.sum("n").over(Window.partitionBy("prediction"))  # over a row a pair of classes
    c = confusion(scored).withColumns({"said": said, "own": F.col("label") == F.col("prediction")})
    one = lambda x: F.coalesce(F.max(F.when(F.col("own"), F.col(x))), F.lit(0))
    per = c.groupBy("label").agg(F.sum("n").alias("real"), one("n").alias("hit"), one("said").alias("said"))
    per = per.withColumns({"p": F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)), "r": F.coalesce(F.try_divide("hit", "real"), F.lit(0.0))})
    per = per.withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    total = F.sum("real")
    weighted = lambda x: F.try_divide(F.sum(F.col(x) * F.col("real")), total)
    return per.agg(F.try_divide(F.sum("hit"), total).alias("accuracy"), weighted("p").alias("precision"), weighted("r").alias("recall"), weighted("f").alias("f1"))


def auc(scored: DataFrame, score: str = "score", label: str = "label", key: list[str] | None = None) -> DataFrame:
    """(key..., rows, auc): the area under the ROC curve, the share of pairs of a row of class 1 and one of class 0 in which the
    first scores higher, ties counted half; null where a class is missing. Rows without a score or class don't count.

    Rows become counts of each distinct score, which are sorted by range: how many zeros score less is what earlier ranges
    hold and what the own range holds before. Nothing meets in one task but a row a range. Rows of with_counts() stand
    for as many as they say.
    """
    key, y = key or [], F.col(label)
    rows = scored.where(F.col(score).isNotNull() & y.isin(0, 1)).withColumns({"_key": F.struct(*(key or [F.lit(0).alias("all")])), "_s": F.col(score), "_y": y})
    many = F.col(MANY) if has(scored, MANY) else F.lit(1).cast("long")
    of = lambda k: F.sum(F.when(F.col("_y") == k, many).otherwise(0))
    hist = rows.groupBy("_key", "_s").agg(of(1).alias("p"), of(0).alias("n"))
    ranges = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hist = stored(hist.repartitionByRange(ranges, "_key", "_s").withColumn("range", F.spark_partition_id()), "scores")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = hist.groupBy("_key", "range").agg(F.sum("n").alias("n")).select("_key", "range", before(Window.partitionBy("_key").orderBy("range")).alias("below"))
    hist = hist.withColumn("inside", before(Window.partitionBy("_key", "range").orderBy("_s"))).join(starts, ["_key", "range"])
    wins = F.sum(F.col("p") * (F.col("below") + F.col("inside") + F.col("n") / 2))
    out = hist.groupBy("_key").agg((F.sum("p") + F.sum("n")).alias("rows"), F.try_divide(wins, F.sum("p") * F.sum("n")).alias("auc"))
    return out.select(*[F.col(f"_key.{k}").alias(k) for k in key], "rows", "auc")


def train(df: DataFrame, name: str, features: list[str] | None = None, label: str = "sentiment", seed: int = 42, alike: DataFrame | None = None) -> tuple[PipelineModel, float]:
    """The fitted pipeline and the seconds that took.

    alike: df's rows by with_counts(). Models that minimise a sum over rows then learn from a row a distinct one, weighted by
    its number. The scaler, which takes no weights, and the random forest, which draws single rows, always read df.
    """
    start = time.time()
    steps, rows = pipeline(name, features, seed).getStages(), labelled(df, label)
    if alike is None or name not in WEIGHTED:
        return Pipeline(stages=steps).fit(rows), time.time() - start
    # The least and greatest values are those of the distinct rows; mean and spread aren't.
    shape = Pipeline(stages=steps[:-1]).fit(labelled(alike, label) if name == "naive_bayes" else rows)
    last = steps[-1].setWeightCol(MANY).fit(shape.transform(labelled(alike, label)))
    return PipelineModel(stages=[*shape.stages, last]), time.time() - start


def evaluate(model: PipelineModel, df: DataFrame, label: str = "sentiment") -> dict[str, float]:
    """The metrics and the area under the ROC curve (nan where the model gives no score or a class is missing).

    df: rows, or distinct ones by with_counts(), of which each is scored once.
    """
    scored = model.transform(labelled(df, label))
    raw = F.get(vector_to_array("rawPrediction"), F.lit(1)) if "rawPrediction" in scored.columns else F.lit(None).cast("double")
    scored = stored(scored.select("label", "prediction", raw.alias("score"), *([MANY] if has(df, MANY) else [])), "scored")  # each row is scored once
    row = metrics(scored).first().asDict()
    found = auc(scored).first()
    row["auc"] = float("nan") if found is None or found["auc"] is None else found["auc"]
    return row


def folds(df: DataFrame, id_col: str, k: int = 3, seed: int = 42) -> DataFrame:
    """df with `fold` from 0 to k - 1 by the hash of the id: rows of one id are in one fold, however the table is dealt."""
    return df.withColumn("fold", F.floor(place(id_col, seed) * k).cast("int"))


def cross_validate(df: DataFrame, name: str, features: list[str] | None = None, folds: int = 3, label: str = "sentiment", seed: int = 42, fold_col: str = ""):
    """fold_col: a column of folds (see folds()); without one they are random."""
    name = chosen(name)
    p = pipeline(name, features, seed)
    cv = CrossValidator(estimator=p, estimatorParamMaps=grid(name, p), evaluator=BinaryClassificationEvaluator(labelCol="label"), numFolds=folds, seed=seed, parallelism=2, foldCol=fold_col)
    return cv.fit(labelled(df, label))


def soft_vote(models: list[PipelineModel], df: DataFrame, id_col: str) -> DataFrame:
    """(id, probability, prediction): the mean probability of models that give one, each scored in turn on the same rows."""
    rows, scores = df, []
    for k, m in enumerate(models):
        keep = rows.columns
        rows = m.transform(rows).withColumn(f"_p{k}", F.get(vector_to_array("probability"), F.lit(1))).select(*keep, f"_p{k}")
        scores.append(F.col(f"_p{k}"))
    mean = sum(scores[1:], scores[0]) / len(scores)
    return rows.select(id_col, mean.alias("probability"), (mean >= 0.5).cast("double").alias("prediction"))


def compare(spark: SparkSession, data: tuple[DataFrame, DataFrame], features: list[str], names: tuple[str, ...] = MODELS[:5], label: str = "sentiment") -> DataFrame:
    """A row a model, best area first; a model that fails has zeros and its error. data: train and test."""
    rows = []
    # Each model reads the same tables, which are split and cut to their columns once. A model of many rounds learns from
    # the distinct rows, and all are tested on them, with how many rows each stands for.
    learn = stored(labelled(data[0], label).select(*features, label), "models")
    alike, test = (stored(with_counts(d, [*features, label]), "alike") for d in (learn, labelled(data[1], label)))
    for name in names:
        try:
            model, seconds = train(learn, name, features, label, alike=alike)
            start = time.time()
            got = evaluate(model, test, label)
            rows.append((name, got["accuracy"], got["precision"], got["recall"], got["f1"], got["auc"], seconds, time.time() - start, None))
        except Exception as e:  # noqa: BLE001  reported in the row
            rows.append((name, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, str(e)[:200]))
    out = spark.createDataFrame(rows, "model string, accuracy double, precision double, recall double, f1 double, auc double, train_seconds double, predict_seconds double, error string")
    return out.orderBy(F.desc("auc"), "model")


def benchmark(spark: SparkSession, df: DataFrame, id_col: str, features: list[str], fractions: tuple[float, ...] = (0.01, 0.05, 0.1, 0.2), names: tuple[str, ...] = MODELS[:4], label: str = "sentiment") -> DataFrame:
    """compare() at several shares of the data."""
    from functools import reduce

    from .quality import hash_sample, hash_split

    parts = [compare(spark, hash_split(hash_sample(df, id_col, f), id_col), features, names, label).withColumn("fraction", F.lit(f)) for f in fractions]
    return reduce(DataFrame.unionByName, parts)


def benchmark_summary(results: DataFrame) -> DataFrame:
    """Mean accuracy, F1 and times of each model over the shares that benchmark() tried."""
    means = [F.avg(c).alias(f"avg_{c}") for c in ("accuracy", "f1", "train_seconds", "predict_seconds")]
    return results.groupBy("model").agg(*means, F.count("*").alias("runs"))


def best_model(results: DataFrame, by: str = "auc") -> str | None:
    """The name of compare()'s best model that ran; None if none did."""
    row = results.where("error IS NULL").orderBy(F.desc(by), "model").first()
    return row["model"] if row else None


def vocabulary(df: DataFrame, tokens: str = "tokens", size: int = 10_000) -> DataFrame:
    """(word, n, index): the commonest words by rank from 1, as a deep model's tokenizer numbers them."""
    from pyspark.sql import Window

    top = df.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return top.withColumn("index", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "word")))


def token_ids(df: DataFrame, vocabulary: DataFrame, id_col: str, tokens: str = "tokens", length: int = 100) -> DataFrame:
    """(id, ids): the vocabulary's numbers of a row's words in order, as a deep model takes them.

    Words outside the vocabulary are left out; of longer rows the last `length` words stay, shorter ones have zeros in
    front. The vocabulary is bounded by its own size and goes to the rows. Rows of null or no tokens are all zeros.
    """
    words = df.select(F.col(id_col).alias("id"), F.posexplode(tokens).alias("at", "word"))
    known = words.join(F.broadcast(vocabulary.select("word", "index")), "word")
    got = known.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "index"))).alias("x"))
    ids = F.coalesce(F.transform("x", lambda x: x["index"]), F.array().cast("array<int>"))
    last = F.slice(ids, F.greatest(F.size(ids) - length + 1, F.lit(1)), F.lit(length))
    rows = df.select(F.col(id_col).alias("id")).join(got, "id", "left").select("id", last.alias("ids"))
    return rows.select("id", F.concat(F.array_repeat(F.lit(0), F.lit(length) - F.size("ids")), "ids").alias("ids"))
