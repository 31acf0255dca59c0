"""A training-corpus pipeline over `documents`: toxicity, line dedup, near dedup, decontamination, tokens.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a frame that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of docs. Each works on all its
predecessor kept, and its decisions take effect:

- toxicity: documents that score 0.3 or more go. The model learns from labelled documents of sf_dir, by the rule of
  the operator's query (never from held-out rows).
- line_dedup: lines of 20 code points or more that stand in three documents or more stay in the largest doc_id only;
  n_chars follows the text. A document that loses all its lines stays with an empty text.
- near_dedup: one document (the least doc_id) of each group that shares 80 % of its five-word shingles stays, and one
  row of each doc_id; documents without words and rows of a null doc_id stay.
- decontamination: documents whose words are hit by benchmark windows to a twentieth or more go.
- bpe: every text's token ids, their number and the digests of ids and decoded text.

Nulls, empty and very long texts, empty tables and extra columns, which may have any name, are handled as the operators'
modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, line_dedup, near_dup, toxicity
from tidemark.llm.common import clear_scratch, crc_mod, scratch_mark, scratch_path, small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    known = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = toxicity.fit(known.where(~held), labels.where(~held))
    return docs.where(toxicity.score_column(model)(F.col("text")) < 0.3)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup.deduped(docs)
    row, same = F.col("row"), F.col("_n_dropped") == 0
    new = {"text": F.when(same, row["text"]).otherwise(F.col("_kept")), "n_chars": F.when(same, row["n_chars"]).otherwise(F.char_length("_kept").cast("long"))}
    return found.select(*[new.get(c, row[c]).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    groups = near_dup.near_duplicates(docs.select("doc_id", "text"), k=5)
    stay = groups.where("kept AND id IS NOT NULL").select(F.col("id").alias("doc_id")).distinct()
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    one = docs.join(stay, "doc_id", "left_semi").select(F.struct("*").alias("row"), F.row_number().over(first).alias("n")).where("n = 1").select("row.*")
    return one.unionByName(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontam.contaminated(docs, items).where(~F.col("_contaminated")).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # Smaller caches than the operator's own: the workers of the stages before share the executors' memory.
    small_batches(spark)
    return bpe.encode_texts(docs, str(public_tokenizers.path("word_bpe_49k.json")), with_ids=True, cache=170_000)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("bpe", encode)]

#: The toxicity and token stages aren't expressible in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; each result is a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = scratch_mark()
    for name, stage in STAGES:
        # The path is asked for after the stage's own tables are made, and those go once its result is written.
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"stage-{name}")
        out.write.parquet(path)
        clear_scratch(spark, mark, but=path)
        docs = spark.read.parquet(path)
    return docs
