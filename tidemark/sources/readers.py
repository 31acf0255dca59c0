"""Sources: labelled posts as CSV, Parquet, rows in memory, and the driver tables seen as posts, mentions and events."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import require

RAW = T.StructType([T.StructField("polarity", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("tweet_id", "date", "query", "user", "text")]])


def parse_post_date(c: Column) -> Column:
    """Dates like "Mon Apr 06 22:19:45 PDT 2009"; what can't be read is null. The weekday is redundant and not parsed."""
    return F.try_to_timestamp(F.substring(c, 5, 100), F.lit("MMM dd HH:mm:ss zzz yyyy"))


def polarity(c: Column) -> Column:
    return F.when(c == 0, 0).when(c == 4, 1)


def shape_posts(raw: DataFrame) -> DataFrame:
    """Drop blank texts; polarity becomes sentiment; the date becomes a timestamp with its parts as strings."""
    out = raw.where(F.char_length(F.trim("text")) > 0).withColumns({"sentiment": polarity(F.col("polarity")), "timestamp": parse_post_date(F.col("date"))}).drop("polarity")
    return out.withColumns({n: F.date_format("timestamp", f) for n, f in (("year", "yyyy"), ("month", "MM"), ("day", "dd"), ("hour", "HH"))})


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Headerless latin-1 CSV of fixed schema; malformed lines are dropped."""
    return shape_posts(spark.read.csv(path, schema=RAW, encoding="ISO-8859-1", mode="DROPMALFORMED", quote='"', escape='"'))


def scan_posts(spark: SparkSession, path: str) -> DataFrame:
    """The same CSV with nothing lost: RAW and `rejected`, the whole line where it doesn't fit the schema, else null.

    Lines are read in splits, whatever the size of a file; see accepted, rejects and scan_counts.
    """
    schema = T.StructType([*RAW, T.StructField("rejected", T.StringType())])
    # Without column pruning, since a line of too many or too few fields only shows when all are parsed.
    reader = spark.read.option("columnPruning", False)
    return reader.csv(path, schema=schema, encoding="ISO-8859-1", mode="PERMISSIVE", columnNameOfCorruptRecord="rejected", quote='"', escape='"')


def accepted(scan: DataFrame) -> DataFrame:
    return shape_posts(scan.where("rejected IS NULL").drop("rejected"))


def rejects(scan: DataFrame) -> DataFrame:
    """(line): what was not read, to be kept apart."""
    # A scan can't ask for the whole line alone.
    return scan.where("rejected IS NOT NULL").select(F.coalesce("rejected", F.concat(F.col("polarity").cast("string"), "tweet_id")).alias("line"))


def scan_counts(scan: DataFrame) -> DataFrame:
    """(kind, n): lines by their label, `blank` for those without a text and `rejected` for those that don't fit."""
    kind = F.when(F.col("rejected").isNotNull(), "rejected").when(F.char_length(F.trim(F.coalesce("text", F.lit("")))) == 0, "blank").otherwise(F.coalesce(polarity(F.col("polarity")).cast("string"), F.lit("unlabelled")))
    return scan.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def balanced_posts(spark: SparkSession, path: str, fraction: float = 0.01) -> DataFrame:
    """A balanced sample of a CSV by label, whatever the order of its rows."""
    from tidemark.operators.quality import balanced_sample

    return balanced_sample(read_posts(spark, path), "tweet_id", fraction)


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return require(df, *columns).select(*columns) if columns else df


def rows(spark: SparkSession, data: Iterable[tuple], schema: str) -> DataFrame:
    """Rows in memory, an empty table included."""
    return spark.createDataFrame(list(data), schema)


def model_table(spark: SparkSession, path: str, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """A feature table with the columns that models need, sampled on wish."""
    df = require(spark.read.parquet(path), "text", "sentiment", "text_processed", "text_length", "processed_length", "token_count")
    return df if fraction is None else df.sample(fraction=fraction, seed=seed)


# -- driver tables as the library's inputs


def brand_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its part: brand, confidence, timestamp, sentiment (N 1, A 0.5, R 0), aspect, amount."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.lower("p_brand").alias("brand"), F.col("p_type").alias("aspect"))
    label = F.when(F.col("l_returnflag") == "N", 1.0).when(F.col("l_returnflag") == "R", 0.0).when(F.col("l_returnflag") == "A", 0.5)
    rows_ = line.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").alias("timestamp"), label.alias("sentiment"), (1 - F.col("l_discount")).alias("confidence"), "l_quantity")
    return rows_.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: timestamp, topic (event_type), sentiment (purchase and signup 1, error 0, else none), value."""
    kind = F.col("event_type")
    label = F.when(kind.isin("purchase", "signup"), 1.0).when(kind == "error", 0.0)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").alias("timestamp"), "user_id", kind.alias("topic"), label.alias("sentiment"), "value")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as posts: tweet_id, text, timestamp (a minute a document from 2024), sentiment (quality, where labelled)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").cast("double").alias("sentiment"))
    stamp = F.timestamp_add("MINUTE", F.col("doc_id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("tweet_id"), "text", "lang", "source", stamp.alias("timestamp"), "sentiment")
