"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions only.

A line's key is the line stripped of [\\x20\\x09-\\x0D] at both ends with A-Z lower-cased. Keys of at least
`min_chars` code points that occur in at least `min_docs` documents are settled: their lines go from every
document but the one with the largest id that holds them. All other lines stay, in order, joined by \\n.

How it works
- One pass over the texts writes a table of line hashes (row, line number, 128-bit hash).
- The hashes are dealt into batches by falling document id and reduced to (hash, documents, largest id) within a
  batch. Each batch, in turn, is merge-anti-joined with the settled hashes of the runs so far (a settled hash needs
  nothing more, since later batches only hold smaller ids); what is left is sorted and becomes a run of level 0.
- Two runs of one level are compacted into one of the next, summing documents and taking the largest id.
- The last run's settled hashes are joined to the hash table; what they hit is dropped from the texts. Hashes that
  have more than 1 / `hot` of all lines within one batch, of which there are `hot` at most, are broadcast, so that no line
  however common meets in one place; the others are joined by hash.

Cases: a null or empty text is one empty line, hash sha256(''). Rows of one id are one document: they count once, and
each gets a result; so are rows of null id, which come last in the order of ids, so another holder wins over them.
An empty table gives an empty result. Columns other than id and text are ignored (or carried by `dedup_lines`,
whatever their names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, ascii_lower, beside, key128, materialize

_LOW = -(2**63)


class LineRuns:
    """The levelled runs: (h1, h2, n, holder), each sorted by hash and stored in the shared folder."""

    def __init__(self, min_docs: int, fan: int = 2):
        self.min_docs, self.fan, self.levels = min_docs, fan, []

    def add(self, batch: DataFrame) -> None:
        """Batches must come by falling ids, so that the holder of a settled hash is final."""
        for level in self.levels:
            for run in level:
                batch = batch.join(run.where(F.col("n") >= self.min_docs), ["h1", "h2"], "left_anti")
        self._put(batch, 0)

    def _put(self, run: DataFrame, k: int) -> None:
        while len(self.levels) <= k:
            self.levels.append([])
        self.levels[k].append(materialize(run.sortWithinPartitions("h1", "h2"), f"run{k}"))
        if len(self.levels[k]) == self.fan:
            full, self.levels[k] = self.levels[k], []
            self._put(self._merged(full), k + 1)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        union = runs[0]
        for run in runs[1:]:
            union = union.unionByName(run)
        return union.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("holder").alias("holder"))

    def settled(self) -> DataFrame:
        """(h1, h2, n, holder) of the hashes in at least min_docs documents."""
        runs = [run for level in self.levels for run in level]
        return (self._merged(runs) if len(runs) > 1 else runs[0]).where(F.col("n") >= self.min_docs)


def _rows(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW)).alias("_id"), F.xxhash64(text).alias("_t"), text.alias("_text"), *more)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4, hot: int = 20_000) -> DataFrame:
    """(_id, _t, gone): for each document that loses lines, the sorted numbers (from 0) of those it loses."""
    rows = _rows(docs, id_col, text_col)
    key = lambda x: F.btrim(x, F.lit(WS))
    numbered = F.transform(F.split("_text", "\n", -1), lambda x, k: F.struct(key(x).alias("s"), k.cast("int").alias("k")))
    hashed = F.transform(F.filter(numbered, lambda x: F.char_length(x["s"]) >= min_chars), lambda x: F.struct(*key128(ascii_lower(x["s"])), x["k"].alias("k")))
    rows = rows.select("_id", "_t", F.array_sort(hashed).alias("a"))
    # Sorted by hash: the first line of each key counts the document, once.
    flagged = F.transform("a", lambda x, i: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["k"].alias("k"), ((i == 0) | (F.get("a", i - 1)["h1"] != x["h1"]) | (F.get("a", i - 1)["h2"] != x["h2"])).alias("first")))
    lines = materialize(rows.select("_id", "_t", F.inline(flagged)), "lines")
    cuts = lines.agg(F.percentile_approx("_id", [(batches - i) / batches for i in range(1, batches)], 1000).alias("q")).first()["q"] if batches > 1 else None
    batch = F.lit(0)
    for q in cuts or []:
        batch = batch + (F.col("_id") < q).cast("int")
    firsts = lines.where("first").select("_id", "h1", "h2")
    # Rows of one id are one document: where there are any, a line's documents are counted by distinct ids.
    per_id = rows.agg(F.count("*").alias("n"), F.countDistinct("_id").alias("ids")).first()
    if per_id["n"] > per_id["ids"]:
        firsts = firsts.distinct()
    held = firsts.groupBy(batch.alias("batch"), "h1", "h2").agg(F.count("*").alias("n"), F.max("_id").alias("holder"))
    held = materialize(held, "batches")
    runs = LineRuns(min_docs)
    for b in range(batches if cuts else 1):
        runs.add(held.where(F.col("batch") == b).drop("batch"))
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = held.where(F.col("n") > total / hot).select("h1", "h2").distinct()  # at most `hot` rows
    settled = materialize(runs.settled().select("h1", "h2", "holder"), "settled")
    common = settled.join(F.broadcast(common), ["h1", "h2"], "left_semi").select("h1", "h2", F.col("holder").alias("top"))
    lines = lines.join(F.broadcast(common), ["h1", "h2"], "left")
    hit = lines.where("_id < top").drop("top").unionByName(lines.where("top IS NULL").drop("top").join(settled, ["h1", "h2"]).where("_id < holder").drop("holder"))
    return hit.groupBy("_id", "_t").agg(F.array_sort(F.collect_set("k")).alias("gone"))


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """(row, _kept, _n_lines, _n_dropped): all of docs' columns as the struct `row`, whatever their names."""
    gone = dropped_lines(docs, id_col, text_col, **rule)
    # The lines are split before the join, so that what stays is picked by number from a ready array.
    rows = _rows(docs, id_col, text_col, F.struct("*").alias("row")).withColumn("_lines", F.split("_text", "\n", -1)).drop("_text").join(gone, ["_id", "_t"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.array_join("_lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda k: F.get("_lines", k)), "\n"))
    return rows.select("row", kept.alias("_kept"), F.size("_lines").cast("long").alias("_n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("_n_dropped"))


def dedup_lines(docs: DataFrame, **rule) -> DataFrame:
    """docs with every column, plus _kept (the text that stays), _n_lines and _n_dropped.

    Where docs has such a column, the new one's name gets underscores in front.
    """
    return beside(docs, deduped(docs, **rule), ["_kept", "_n_lines", "_n_dropped"])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every document; see the module for the rule and its cases."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = {
    "op6_line_dedup": """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS k FROM documents
), s AS (
  SELECT doc_id, line, k, trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS t FROM l
), q AS (
  SELECT doc_id, line, k, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM s
), g AS (
  SELECT key, max(doc_id) AS holder FROM q WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), f AS (
  SELECT q.doc_id, q.line, q.k, g.key IS NOT NULL AS gone FROM q LEFT JOIN g ON q.key = g.key AND q.doc_id < g.holder
)
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY k), '')) AS kept_sha256
FROM f GROUP BY doc_id""",
}
