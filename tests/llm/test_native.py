"""Line dedup and decontamination: SQL, plans and the odd cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import TESTDATA
from tests.oracle import check
from tidemark.llm import decontam, line_dedup, registry

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    check(spark, registry.queries()[name], registry.oracle_sql()[name], TESTDATA)


@pytest.mark.parametrize("name", ["op2_decontamination", "op6_line_dedup"])
def test_no_python_in_the_plan(spark, name):
    plan = registry.queries()[name](spark, TESTDATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def brute_lines(docs):
    keys = {}
    for i, t in docs:
        for k in {lower(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                keys.setdefault(k, set()).add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(ids := keys.get(lower(x.strip(" \t\n\x0b\x0c\r")), ())) < 3 or max(ids) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    pool = ["A common line of twenty chars", "  a COMMON line of twenty chars\t", "short", "", "É common line of twenty chars", "é common line of twenty chars", "x" * 5000, "trailing space is kept here "]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(60)] + [(60, None), (61, ""), (62, "\n\n"), (63, "A common line of twenty chars\n" * 3000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, _t string, n long")  # a clashing name
    got = {r.doc_id: (r._n_lines, r._n_dropped, r._kept) for r in line_dedup.dedup_lines(df.select("doc_id", "text")).collect()}
    assert got == brute_lines(docs)


def test_lines_of_odd_tables(spark):
    line = "a line that is long enough to count"
    df = spark.createDataFrame([(None, line), (1, line), (2, line), (2, line), (3, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r._n_dropped) for r in line_dedup.dedup_lines(df).collect())
    assert got == [("1", 1), ("2", 0), ("2", 0), ("3", 0), ("None", 1)]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_lines_count_documents_not_rows(spark, tmp_path):
    line = "a line that is long enough to count"
    rows = [(1, line), (1, line), (2, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r._n_dropped for r in line_dedup.dedup_lines(df).collect()} == {0}
    more = spark.createDataFrame([*rows, (3, "x\n" + line), (3, line + " ")], "doc_id long, text string")
    assert sorted((r.doc_id, r._n_dropped) for r in line_dedup.dedup_lines(more).collect()) == [(1, 1), (1, 1), (2, 1), (3, 0), (3, 0)]
    # By its SQL, too, on repeated ids of different texts.
    docs = [(i % 7, f"{line} {i % 3}\n{line} {i % 5}\nown {i}") for i in range(21)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    held = {}
    for i, t in docs:
        for x in t.split("\n"):
            held.setdefault(x, set()).add(i)
    want = sorted((i, sum(len(x) >= 20 and len(held[x]) >= 3 and max(held[x]) > i for x in t.split("\n"))) for i, t in docs)
    assert sorted((r.doc_id, r.n_dropped) for r in line_dedup.op6_line_dedup(spark, str(tmp_path)).collect()) == want


def brute_hits(docs, items, width=13):
    wins = {}
    for k, t in items:
        w = WORD.findall(lower(t or ""))
        for s in range(max(1, len(w) - width + 1)) if w else ():
            wins.setdefault(tuple(w[s : s + width]), set()).add(k)
    out = {}
    for i, t in docs:
        w, hit, got = WORD.findall(lower(t or "")), set(), set()
        for win, ids in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    got |= ids
        out[i] = (len(w), len(hit), sorted(map(str, got)), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_contamination_against_brute_force(spark):
    rng = random.Random(5)
    vocab = ["the", "of", "É", "é", "x1", "Zeta", "ab", "cd", "naïve", "q"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "--", "_"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 12, 13, 14, 20, 30]))) for k in range(12)] + [(50, None), (51, ""), (52, "..."), (3, text(14))]
    docs = [(i, text(30) + items[rng.randrange(12)][1] + text(rng.choice([0, 5, 900]))) for i in range(40)] + [(90, None), (91, ""), (92, "!!"), (93, items[4][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, t, "z") for k, t in items], "item_id long, text string, words string")
    want = brute_hits(docs, items)
    for block in (50_000, 7):  # one broadcast block and several
        got = {r.doc_id: (r._n_words, r._n_hit, r._items, r._contaminated) for r in decontam.mark_contaminated(d, b, block=block).collect()}
        assert got == want


def test_contamination_of_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [(r._n_hit, r._contaminated) for r in decontam.mark_contaminated(d, b.limit(0)).collect()] == [(0, False)] * 2
    assert decontam.mark_contaminated(d.limit(0), b).count() == 0
    r = decontam.mark_contaminated(d, b).where("doc_id = 1").first()
    assert (r._n_hit, r._items, r._contaminated) == (2, ["1"], True)


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


CLASH = "items n_hit _id _t _n_hit _items _contaminated gone _text _lines _kept _row row n doc words".split()


def test_columns_of_any_name_are_carried(spark):
    d = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    for i, name in enumerate(CLASH):
        d = d.withColumn(name, F.lit(100 + i))
    items = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    a = decontam.mark_contaminated(d, items)
    assert a.columns == [*d.columns, "_n_words", "__n_hit", "__items", "__contaminated"]
    got = {r.doc_id: r for r in a.collect()}
    assert (got[1]["_n_words"], got[1]["__n_hit"], got[2]["__n_hit"]) == (3, 2, 0)
    b = line_dedup.dedup_lines(d)
    assert b.columns == [*d.columns, "__kept", "_n_lines", "_n_dropped"]
    for r in [*got.values(), *b.collect()]:
        assert [r[c] for c in CLASH] == [100 + i for i in range(len(CLASH))]
