"""The pipeline's stages against brute force on a small fixture."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.llm.test_groups import brute_groups
from tests.llm.test_native import brute_hits, brute_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    docs, labels = [], []
    item = " ".join(word() for _ in range(20))
    for i in range(240):
        text = "\n".join(" ".join(word() for _ in range(12)) for _ in range(4))
        if i % 5 == 0:
            text += "\nthis footer line stands in many documents"
        if i % 6 == 0:
            text = f"{text} idiot moron and idiot"
        if i % 40 == 1:
            text = f"{text} {item}"
        if i % 30 == 2 and i > 30:
            text = docs[2][1]
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int("idiot" in text)))
    docs += [(500, None, None, None, None), (501, "", "en", "s", 0), (None, "a null id stays", "en", "s", 15)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = texts(docs)
    stages = dict(C.STAGES)
    kept = texts(stages["toxicity"](spark, docs, folder))
    assert set(kept) == {i for i, t in before.items() if "idiot" not in (t or "")}

    out = stages["line_dedup"](spark, docs, folder)
    want = brute_lines([(i, t) for i, t in before.items() if i is not None])
    got = texts(out)
    assert out.columns == docs.columns and {i: t or "" for i, t in got.items() if i is not None} == {i: w[2] for i, w in want.items()}
    assert out.where("n_chars <> char_length(text)").count() == 0

    got = stages["near_dedup"](spark, docs, folder)
    _, comp = brute_groups([(i, t) for i, t in before.items() if i is not None], 5)
    assert set(texts(got)) == {i for i, c in comp.items() if i == c} | {None} and got.columns == docs.columns

    got = stages["decontamination"](spark, docs, folder)
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    hit = brute_hits([(i, t) for i, t in before.items()], [(1, item)])
    assert set(texts(got)) == {i for i, h in hit.items() if not h[3]} and got.columns == docs.columns

    assert stages["bpe"](spark, docs, folder).count() == docs.count()


def test_run(spark, folder):
    out = C.run(spark, folder)
    assert out.count() > 100 and "ids" in out.columns and out.where("doc_id % 6 = 0 AND doc_id < 240").count() == 0


def test_empty_docs(spark, folder):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in C.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_stages_carry_columns_of_any_name(spark, folder):
    names = "_row row n items n_hit _id _t _n_hit gone _text _lines _kept _contaminated id component_id kept score".split()
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 40 OR doc_id IS NULL")
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(70 + i))
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, folder)
        rows = out.collect()
        assert out.columns == docs.columns and rows, name
        assert all([r[c] for c in names] == [70 + i for i in range(len(names))] for r in rows), name
    assert C.STAGES[-1][1](spark, docs, folder).count() == docs.count()
