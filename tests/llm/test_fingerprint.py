"""Fingerprints: the multiset hash against plain Python, its algebra, successors, and the odd cases."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tests.conftest import TESTDATA
from tidemark.llm import fingerprint

KIND = "doc_id long, text string"


def brute(text):
    ones, sums, n = [0] * 128, [0] * 8, 0
    for line in text.split("\n"):
        sha = hashlib.sha256(line.encode()).hexdigest()
        sums = [(s + int(sha[8 * k : 8 * k + 8], 16)) % 2**32 for k, s in enumerate(sums)]
        for x in re.sub(r"([.!?])[ \t]", "\\1\n", line).split("\n"):
            if x.strip(" \t\n\x0b\x0c\r"):
                n += 1
                md5 = hashlib.md5(x.encode()).hexdigest()
                ones = [c + (int(md5[j // 32 * 8 : j // 32 * 8 + 8], 16) >> j % 32 & 1) for j, c in enumerate(ones)]
    return n, ones, sums


def near(a, b):
    (n, x, _), (m, y, _) = a, b
    u, v = [2 * c - n for c in x], [2 * c - m for c in y]
    total = sum(c * c for c in u + v)
    return 1.0 if a == b else max(0.0, 1 - sum((c - d) ** 2 for c, d in zip(u, v, strict=True)) / total) if total else 0.0


def plain(f):
    return f.n, f.ones, f.sums


def test_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["", "One. Two! Three?\tFour.", "é ß. 漢字。 \n\n  \nEnd", "x" * 3000, "\n", None, "A line. " * 70_000] + ["\n".join(" ".join(rng.choice(["Aa.", "bb", "Cc!", ""]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 6))) for _ in range(30)]
    docs = [(3 * i, t) for i, t in enumerate(texts)]
    got = {r.id: r for r in fingerprint.edit_fingerprints(spark.createDataFrame(docs, KIND)).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        t, after = t or "", docs[k - 1][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited, r.next_id) == (len(t), edited, docs[k - 1][0])
        assert (plain(r.fingerprint), plain(r.edited_fingerprint), plain(r.next_fingerprint)) == (brute(t), brute(edited), brute(after))


def test_order_insertion_and_deletion(spark):
    a, b = "First one. Second one.\nA third.", "Another line\n\nThe last. Of all."
    row = spark.createDataFrame([(a, b, a + "\n" + b, b + "\n" + a)], "a string, b string, ab string, ba string")
    for c in "a b ab ba".split():
        row = fingerprint.with_fingerprint(row, c, f"f{c}")
    r = row.select("fa", "fb", "fab", "fba", fingerprint.inserted(F.col("fa"), F.col("fb")).alias("sum"), fingerprint.deleted(F.col("fab"), F.col("fb")).alias("less")).first()
    assert r.fab == r.fba == r.sum != r.fa == r.less


def test_likeness(spark):
    rng = random.Random(2)
    lines = [f"Sentence {rng.random()} of its own." for _ in range(400)]
    row = spark.createDataFrame([("\n".join(lines[:200]), "\n".join(lines[100:300]), "\n".join(lines[200:]), "  \n")], "a string, b string, c string, d string")
    for c in "abcd":
        row = fingerprint.with_fingerprint(row, c, f"f{c}")
    pairs = ["ab", "ac", "aa", "ad", "dd"]
    r = row.select("fa", "fb", "fc", *[fingerprint.likeness(F.col(f"f{p[0]}"), F.col(f"f{p[1]}")).alias(p) for p in pairs]).first()
    assert abs(r.ab - 0.5) < 0.25 and r.ac < 0.3 and (r.aa, r.ad, r.dd) == (1, 0, 1)
    assert abs(r.ab - near(plain(r.fa), plain(r.fb))) < 1e-9 and abs(r.ac - near(plain(r.fa), plain(r.fc))) < 1e-9


def test_odd_tables(spark):
    docs = [(None, "null id"), (1, "one. copy"), (1, "one. copy"), (1, "one. other text"), (2, None)]
    df = spark.createDataFrame([(i, t, "c", 1.0) for i, t in docs], KIND + ", id string, f double")  # clashing names
    got = fingerprint.edit_fingerprints(df).collect()
    assert len(got) == 5
    assert {r.next_id for r in got if r.text == "one. copy"} in ({1}, {None}) and len({r.edited for r in got if r.text == "one. copy"}) == 1
    assert next(r for r in got if r.id is None).next_id == 2 and next(r for r in got if r.id == 2).edited == ""
    alone = fingerprint.edit_fingerprints(df.where("doc_id = 2 OR doc_id IS NULL").where("doc_id IS NULL")).first()
    assert (alone.edited, alone.next_id) == ("nullnul", None)
    assert fingerprint.edit_fingerprints(df.limit(0)).count() == 0


def test_rows_are_made_once_and_natively(spark):
    df = fingerprint.op13_fingerprint(spark, TESTDATA)
    df._jdf.queryExecution().toRdd().count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
