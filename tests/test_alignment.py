"""Ratios by the longest common subsequence against a plain dynamic programme."""

import random

from pyspark.sql import functions as F

from tidemark.functions import alignment


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], max(row[j], row[j - 1], last + (x == y))
    return row[-1]


def pairs():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcé 🙂") for _ in range(n))
    return [(text(rng.randint(0, 12)), text(rng.randint(0, 12))) for _ in range(300)] + [(text(n), text(m)) for n, m in ((64, 64), (65, 70), (63, 200), (150, 90), (0, 0), (0, 5), (64, 300))]


def test_lengths():
    a, b = zip(*pairs(), strict=True)
    assert alignment.lcs_lengths(list(a), list(b)).tolist() == [lcs(x, y) for x, y in zip(a, b, strict=True)]


def test_ratios(spark):
    rows = [(a, b) for a, b in pairs() if max(len(a), len(b)) < 80]
    df = spark.createDataFrame([*rows, (None, "a")], "a string, b string")
    for r in df.select("a", "b", alignment.indel_ratio(F.col("a"), F.col("b")).alias("i"), alignment.partial_indel_ratio(F.col("a"), F.col("b")).alias("p")).collect():
        if r.a is None:
            assert r.i is None and r.p is None
            continue
        small, large = sorted((r.a, r.b), key=len)
        assert abs(r.i - (200 * lcs(r.a, r.b) / (len(r.a) + len(r.b)) if large else 100)) < 1e-9
        assert abs(r.p - (max(100 * lcs(small, large[k : k + len(small)]) / len(small) for k in range(len(large) - len(small) + 1)) if small else 100)) < 1e-9
