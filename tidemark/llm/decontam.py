"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Words are maximal runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased. An item's windows are its
`width` consecutive words; a shorter item, unless empty, is one window. A document word inside any occurrence of a
window is hit.

How it works: a window occurs in a document only if all its words do, so the necessary prefix of a window, its words
ordered by rarity over all documents, is its rarest word. Every document word is looked up among those prefix words
(one hash probe a word), the positional bound (the word's place in the window) and the length bound (the window must
end inside the document) cut the candidates, and the words of the item-sized window are compared exactly. The
prefix table is broadcast in blocks of at most `block` windows, so that its size is bounded for any benchmark.

Cases: a null or empty text has no words, is hit by nothing and isn't contaminated; items without words have no
window. Repeated rows of documents each get a result; repeated items of one id count once; a null item id takes no
part in n_items or the digest. Empty tables work: no item hits, or no row comes out. Other columns may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, beside, materialize

#: Separators of words, before lower-casing: ASCII other than digits and letters.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, not lower-cased yet."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), "")


def windows(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(w, words, ids): the distinct windows, with the ids of the items that have them."""
    w = F.col("_w")
    rows = items.select(F.col(id_col).alias("_item"), words(F.translate(F.col(text_col), UPPER, LOWER)).alias("_w")).where("size(_w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (width - 1)))
    rows = rows.select("_item", F.explode(F.transform(starts, lambda s: F.slice(w, s, width))).alias("words"))
    return rows.groupBy("words").agg(F.collect_set("_item").alias("ids")).select(F.xxhash64("words").alias("w"), "words", "ids")


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 13, block: int = 50_000) -> DataFrame:
    """(_id, _t, n_hit, items): for documents with an occurring window, the words hit and the sorted item ids as strings."""
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"), words(F.col(text_col)).alias("_words"))
    wins = materialize(windows(items, item_id, item_text, width), "windows")
    n = wins.count()
    parts = max(1, -(-n // block))
    key = lambda c: F.xxhash64(ascii_lower(c))
    # Rarity: how often each benchmark word occurs in all documents.
    vocab = wins.select(F.explode("words").alias("word")).distinct().select("word", F.xxhash64("word").alias("h"))
    blocks = lambda df, c: [df.where(F.pmod(F.xxhash64(F.lit(7), c), F.lit(parts)) == i) for i in range(parts)] if parts > 1 else [df]
    flat = rows.select(F.explode("_words").alias("x")).select(key(F.col("x")).alias("h"))
    counts = [flat.join(F.broadcast(v), "h").groupBy("word").count() for v in blocks(vocab, "h")]
    counts = materialize(reduce(DataFrame.unionByName, counts), "rarity")
    # The necessary prefix: the rarest word of each window; a window with a word that no document has can't occur.
    prefix = wins.select("w", "words", F.posexplode("words").alias("off", "word")).join(counts, "word", "left")
    prefix = prefix.groupBy("w", "words").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "off")).alias("p")).where("p.n > 0")
    prefix = prefix.select("w", "words", F.size("words").alias("len"), F.col("p.off").alias("off"), F.xxhash64("p.word").alias("h"))
    prefix = materialize(prefix, "prefix")
    found = []
    for p in blocks(prefix, "w"):
        at = rows.select("_id", "_t", "_words", F.posexplode("_words").alias("pos", "x")).withColumn("h", key(F.col("x")))
        at = at.join(F.broadcast(p), "h").where("pos >= off AND pos - off + len <= size(_words)")
        at = at.where(F.translate(F.array_join(F.slice("_words", F.col("pos") - F.col("off") + 1, F.col("len")), " "), UPPER, LOWER) == F.array_join("words", " "))
        found.append(at.select("_id", "_t", (F.col("pos") - F.col("off")).alias("start"), (F.col("pos") - F.col("off") + F.col("len")).alias("stop"), "w"))
    found = materialize(reduce(DataFrame.unionByName, found), "matches")
    ids = found.select("_id", "_t", "w").distinct().join(wins.select("w", F.explode("ids").alias("item")), "w")
    ids = ids.groupBy("_id", "_t").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    # Words hit: lay the intervals in order and add what each has beyond the last end.
    spans = found.groupBy("_id", "_t", "start").agg(F.max("stop").alias("stop")).groupBy("_id", "_t").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("s"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], a["end"]))).alias("n"), F.greatest(a["end"], x["stop"]).alias("end"))
    n_hit = F.aggregate("s", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"].cast("long")
    return spans.select("_id", "_t", n_hit.alias("n_hit")).join(ids, ["_id", "_t"], "left")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 20, **how) -> DataFrame:
    """(row, _n_words, _n_hit, _items, _contaminated): all of docs' columns as the struct `row`, whatever their names."""
    found = hits(docs, items, id_col, text_col, **how)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_own"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_own_t"), F.size(words(F.col(text_col))).cast("long").alias("_n_words"))
    rows = rows.join(found, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_t") == F.col("_t")), "left")
    out = rows.select("row", "_n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("_n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("_items"))
    return out.withColumn("_contaminated", (F.col("_n_hit") > 0) & (share * F.col("_n_hit") >= F.col("_n_words")))


def mark_contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """docs with every column, plus _n_words, _n_hit, _items and _contaminated (_n_hit > 0 and share * _n_hit >= _n_words).

    Where docs has such a column, the new one's name gets underscores in front.
    """
    return beside(docs, contaminated(docs, items, **how), ["_n_words", "_n_hit", "_items", "_contaminated"])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document; see the module for the rule."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    # Only numbers travel beside the document id: the text isn't shuffled.
    found = hits(docs, items)
    rows = docs.select(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    rows = rows.join(found, rows["doc_id"].eqNullSafe(found["_id"]) & (rows["_t"] == found["_t"]), "left")
    n_hit, got = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(got).cast("long").alias("n_items"), F.sha2(F.array_join(got, ",").cast("binary"), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


ORACLE: dict[str, str] = {
    "op2_decontamination": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), wi AS (
  SELECT item_id, least(len(w), 13) AS n, unnest(list_transform(range(1, greatest(2, len(w) - 11)), lambda s: array_to_string(list_slice(w, s, s + 12), ' '))) AS win FROM b WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM wi
), p AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, sizes WHERE len(w) >= n
), h AS (
  SELECT p.doc_id, p.s, p.n, wi.item_id FROM p JOIN wi ON wi.n = p.n AND wi.win = array_to_string(list_slice(p.w, p.s, p.s + p.n - 1), ' ')
), hit AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS k FROM h) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
}
