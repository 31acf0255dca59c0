import datetime as dt

from tidemark.__main__ import main
from tidemark.operators import entity
from tidemark.plans import workflows
from tidemark.plans.texts import terms  # noqa: F401  the dictionary shape

from tests.test_operators import BRANDS
from tidemark.sources import sinks


def test_both_workflows(spark, tmp_path):
    rows = [(str(i), f"The iphone is great and {'good' if i % 2 else 'bad'} with Samsung number {i} #fun", dt.datetime(2024, 1, 1 + i % 15, 5), i % 2) for i in range(60)]
    posts = spark.createDataFrame(rows, "tweet_id string, text string, timestamp timestamp, sentiment int")
    got = workflows.prepare(spark, posts, str(tmp_path / "p"))
    assert got["features"].count() == 60 and "tfidf_features" in got["features"].columns
    again = workflows.prepare(spark, posts.limit(0), str(tmp_path / "p"))
    assert again["features"].count() == 60  # found again
    known = entity.terms_of(spark.createDataFrame(BRANDS, "brand string, industry string, aliases array<string>, products array<string>, keywords array<string>"))
    market = workflows.intelligence(spark, posts, known, str(tmp_path / "m"), target="Apple")
    assert market["share_of_voice"].where("brand = 'apple'").count() == 15 and market["insights"].first().brand == "apple" and market["forecast"].count() > 0


def test_jobs_from_a_shell(spark, tmp_path):
    lines = [f'{i % 2 * 4},{i},Mon Apr 06 22:19:45 PDT 2009,q,u,"The new iphone of Apple is {("good", "bad")[i % 2]}, says number {i}"' for i in range(20)] + ["broken"]
    (tmp_path / "posts.csv").write_text("\n".join(lines))
    got = main(["prepare", "--format", "csv", str(tmp_path / "posts.csv"), str(tmp_path / "out")])
    assert got["features"] == got["sample"] == 20 and spark.read.parquet(str(tmp_path / "out/rejects")).first().line == "broken"
    (tmp_path / "d.json").write_text('{"industries": {"technology": {"brands": {"apple": {"name": "Apple", "aliases": [], "products": ["iphone"], "keywords": [], "competitors": []}}}}}')
    rows = [(str(i), "Apple iphone", dt.datetime(2024, 1, 1 + i % 15), i % 2) for i in range(45)]
    spark.createDataFrame(rows, "tweet_id string, text string, timestamp timestamp, sentiment int").write.parquet(str(tmp_path / "posts"))
    got = main(["intelligence", "--dictionary", str(tmp_path / "d.json"), "--target", "apple", str(tmp_path / "posts"), str(tmp_path / "market")])
    assert got["brands"] == 45 and spark.read.parquet(str(tmp_path / "market/share_of_voice")).count() == got["share_of_voice"] == 15


def test_a_month_is_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "months")
    df = spark.range(90).selectExpr("id", "2024 AS year", "cast(id % 3 + 1 AS int) AS month")
    sinks.write_by_month(df, path, 2)
    files = lambda m: {p.name: p.stat().st_mtime_ns for p in (tmp_path / f"months/year=2024/month={m}").glob("*.parquet")}
    before = {m: files(m) for m in (1, 2, 3)}
    sinks.update_months(df.where("month = 2 AND id < 30"), path, 2)
    assert files(1) == before[1] and files(3) == before[3] and files(2).keys() != before[2].keys()
    again = spark.read.parquet(path)
    assert {r.month: r["count"] for r in again.groupBy("month").count().collect()} == {1: 30, 2: 10, 3: 30}
    assert "PartitionFilters: [isnotnull(month" in again.where("month = 2")._jdf.queryExecution().executedPlan().toString()
