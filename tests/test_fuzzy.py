"""The exact index of similar strings against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import TESTDATA
from tidemark.operators import entity, fuzzy


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def percent(a, b):
    n = max(len(a), len(b))
    return (n - distance(a, b)) * 100.0 / n


def strings(rng, n, letters="aabcdeé ", most=14):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, most))).strip() for _ in range(n)} - {""})


@pytest.mark.parametrize("least", [30.0, 60.0, 70.0, 85.0, 100.0])
@pytest.mark.parametrize("rows", [1_000_000, 0])  # by broadcast, and by key
def test_no_pair_is_lost(spark, least, rows):
    rng = random.Random(least)
    words, terms = strings(rng, 150), strings(rng, 60)
    words = sorted({*words, *(w[:k] + rng.choice("xab") + w[k + rng.randint(0, 1) :] for w in terms for k in (0, len(w) // 2))})
    each, known = (spark.createDataFrame([(w,) for w in side], f"{name} string") for side, name in ((words, "chunk"), (terms, "term")))
    got = {(r.chunk, r.term): r.ratio for r in fuzzy.similar_pairs(each, known, least, index_rows=rows).collect()}
    want = {(a, b): p for a in words for b in terms if (p := percent(a, b)) >= least}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_the_index_spares_most_pairs_and_joins_by_keys(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    each = entity.chunks(docs, "doc_id", "text", 1).select("chunk").distinct().cache()
    terms = entity.chunks(spark.read.parquet(f"{TESTDATA}/benchmark.parquet"), "item_id", "text", 1).where("char_length(chunk) >= 5").select(F.col("chunk").alias("term")).distinct().cache()
    lengths = lambda df, c: df.groupBy(F.char_length(c).alias("l")).count().collect()
    permitted = sum(a["count"] * b["count"] for a in lengths(each, "chunk") for b in lengths(terms, "term") if min(a.l, b.l) * 100 >= max(a.l, b.l) * 80 - 1e-6)
    pairs = fuzzy.candidate_pairs(each, terms, 80.0)
    assert permitted > 20 * pairs.count()
    plan = fuzzy.similar_pairs(each, terms, 80.0, index_rows=0)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_partial_ratio(spark):
    rng = random.Random(7)
    rows = [(a, b) for a in strings(rng, 12) for b in strings(rng, 12)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", fuzzy.partial_ratio(F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        small, large = sorted((r.a, r.b), key=len)
        assert abs(r.p - max(percent(small, large[i : i + len(small)]) for i in range(len(large) - len(small) + 1))) < 1e-9


def test_words_in_any_order(spark):
    each, known = spark.createDataFrame([("model s tesla",), ("tesla modle s",)], "chunk string"), spark.createDataFrame([("tesla model s",)], "term string")
    assert {r.chunk for r in fuzzy.similar_pairs(each, known, 100.0, words_sorted=True).collect()} == {"model s tesla"}
    assert {r.chunk for r in fuzzy.similar_pairs(each, known, 80.0, words_sorted=True).collect()} == {"model s tesla", "tesla modle s"}


def test_empty_sides(spark):
    each, known = spark.createDataFrame([("abc",), (None,), ("",)], "chunk string"), spark.createDataFrame([("abc",), (None,), ("",)], "term string")
    assert [(r.chunk, r.term) for r in fuzzy.similar_pairs(each, known, 70.0).collect()] == [("abc", "abc")]
    assert fuzzy.similar_pairs(each, known.limit(0), 70.0).count() == fuzzy.similar_pairs(each.limit(0), known, 70.0).count() == 0


def test_runs_claim_their_words(spark):
    terms = entity.terms_of(spark.createDataFrame([("Thing", "goods", [], [], []), ("Onion", "food", [], ["thing of"], [])], "brand string, industry string, aliases array<string>, products array<string>, keywords array<string>"))
    texts = spark.createDataFrame([(1, "a thing of use"), (2, "one thing"), (3, "thing thing of")], "id long, text string")
    got = {r.id: {b.brand for b in r.brands} for r in entity.recognise(texts, terms).collect()}
    assert got == {1: {"Onion"}, 2: {"Thing"}, 3: {"Onion", "Thing"}}


def test_texts_are_split_once_and_probes_have_one_number_as_key(spark):
    """The places of the words come from stored words, and a probe of the index compares a single long."""
    terms = entity.terms_of(spark.createDataFrame([("Thing", "goods", [], ["thing of"], [])], "brand string, industry string, aliases array<string>, products array<string>, keywords array<string>"))
    texts = spark.createDataFrame([(1, "..A thin' offer, THING\u00e9 of -- x"), (2, "..."), (3, None), (4, "")], "id long, text string")
    assert [(r.position, r.n, r.chunk) for r in entity.chunks(texts, "id", "text", 2).orderBy("n", "position").collect()] == [(1, 1, "thin'"), (2, 1, "offer"), (3, 1, "thing\u00e9"), (0, 2, "a thin'"), (1, 2, "thin' offer"), (2, 2, "offer thing\u00e9"), (3, 2, "thing\u00e9 of"), (4, 2, "of x")]
    assert [(r.position, r.chunk) for r in entity.chunks(texts, "id", "text", 1).orderBy("position").collect()] == [(1, "thin'"), (2, "offer"), (3, "thing\u00e9")]
    found = entity.matches(texts, terms)
    assert "p{L}" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.position, r.n, r.term) for r in found.collect()} >= {(1, 1, "thing"), (3, 2, "thing of")}
    pairs = fuzzy.candidate_pairs(entity.chunks(texts, "id", "text", 2), terms, 70.0)
    assert "[_k" in pairs._jdf.queryExecution().executedPlan().toString() and dict(pairs.dtypes)["_d"] == "int"


def test_only_words_are_made_distinct_before_they_meet_products(spark):
    """product_matches gives a repeated run once, but doesn't shuffle the runs that are alike nothing."""
    from tidemark.plans.texts import _product_matches, terms

    got = _product_matches(spark, TESTDATA)
    assert "p{L}" not in got._jdf.queryExecution().optimizedPlan().toString()
    each = entity.chunks(spark.read.parquet(f"{TESTDATA}/conversations.parquet"), "conv_id", "text", 3).select("chunk").distinct()
    want = fuzzy.similar_pairs(each, entity.product_terms(terms(spark)), entity.PRODUCT_RATIO, words_sorted=True).select("chunk", "term", "brand", "product")
    rows = sorted(got.drop("ratio").collect())
    assert rows and rows == sorted(want.collect()) and any(" " in r.chunk for r in rows)
