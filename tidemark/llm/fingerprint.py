"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A text is a multiset of paragraphs (its lines), a paragraph a multiset of sentences (cut at white space after . ! or ?;
blank ones don't count). Each member is hashed to a wide vector, and vectors are summed modulo 2^32:

- `sums`: 8 coordinates, the 32-bit words of each paragraph's SHA-256. They tell whether two multisets are equal.
- `ones`: 128 coordinates, the bits of each sentence's MD5; `n` is the number of sentences. 2 * ones - n is a sum of
  random signs, so the square of a difference of two such vectors estimates how many sentences they don't share.

So a fingerprint doesn't depend on the order of paragraphs, and a paragraph is inserted or deleted by adding or
subtracting its own fingerprint (`inserted`, `deleted`), without the rest of the text. `likeness` is
1 - |a - b|^2 / (|a|^2 + |b|^2), at least 0: the share of sentences that two texts have in common (twice the common ones
by all), with a standard error of about 0.09; 1 for equal fingerprints.

How a text's successor is found: the distinct (id, text hash, length) rows are sorted by range, so that each row's
neighbour is in its own range or at the start of the next, and each document then sends the head of its text, no longer
than asked for, to the one before it. Texts meet by key only: they are shuffled once, half of each a second time.

Cases: a null text is empty; an empty text is one empty paragraph without sentences. Rows of equal id and text are one
document and get the same result; different texts of one id follow each other by hash; a null id is the least. A single
document is its own successor. Texts of any length work: sums are exact up to 2^31 members. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WS, materialize, task_count

MODULUS = 1 << 32
_PACKED = {w: sum(1 << k for k in range(0, 64, w)) for w in (16, 32)}  # a long's lowest bits of fields of w bits


def _number(hex8: Column) -> Column:
    return F.conv(hex8, 16, 10).cast("long")


def _total(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + of(x))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with struct<n, ones, sums> of a column of texts (nulls: empty). Each stage is a generator's row, so nothing is computed twice."""
    whole = F.coalesce(F.col(text), F.lit(""))
    sentences = F.filter(F.split(F.regexp_replace(whole, "([.!?])[ \t]", "$1\n"), "\n", -1), lambda s: F.btrim(s, F.lit(WS)) != "")
    member = F.struct(F.transform(sentences, lambda s: F.md5(s)).alias("_md5"), F.transform(F.split(whole, "\n", -1), lambda p: F.sha2(p, 256)).alias("_sha"))
    df = df.select("*", F.inline(F.array(member)))
    half = lambda at: F.transform("_md5", lambda m: F.conv(F.substring(m, at, 16), 16, -10).cast("long"))
    df = df.select("*", F.inline(F.array(F.struct(half(1).alias("_a"), half(17).alias("_b")))))
    # A shift and a mask take every 16th bit of a long, and all four are counted in one addition; every 32nd of long texts.
    counted = lambda c, w: F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda j: _total(F.col(c), lambda x: F.call_function("shiftrightunsigned", x, j).bitwiseAND(F.lit(_PACKED[w]))))
    few = F.size("_md5") < 1 << 15  # a sum has a sign
    bits = lambda c: F.when(few, counted(c, 16)).otherwise(counted(c, 32))
    words = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: _total(F.col("_sha"), lambda s: _number(F.substring(s, k * 8 + 1, F.lit(8)))) % MODULUS)
    df = df.select("*", F.inline(F.array(F.struct(bits("_a").alias("_sa"), bits("_b").alias("_sb"), words.alias("_sums")))))
    part = lambda c, at, w: F.transform(c, lambda x: F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << w) - 1)))
    ones = F.when(few, F.concat(*[part(c, at, 16) for c in ("_sa", "_sb") for at in (32, 48, 0, 16)])).otherwise(F.concat(*[part(c, at, 32) for c in ("_sa", "_sb") for at in (32, 0)]))
    found = F.struct(F.size("_md5").cast("long").alias("n"), ones.alias("ones"), F.col("_sums").alias("sums"))
    return df.withColumn(name, found).drop("_md5", "_sha", "_a", "_b", "_sa", "_sb", "_sums")


def _combined(a: Column, b: Column, sign: int) -> Column:
    one = lambda x, y: F.pmod(x + sign * y, F.lit(MODULUS))
    return F.struct(one(a["n"], b["n"]).alias("n"), F.zip_with(a["ones"], b["ones"], one).alias("ones"), F.zip_with(a["sums"], b["sums"], one).alias("sums"))


def inserted(a: Column, b: Column) -> Column:
    """The fingerprint of a's paragraphs and b's together."""
    return _combined(a, b, 1)


def deleted(a: Column, b: Column) -> Column:
    """The fingerprint of a's paragraphs without b's, which a must hold."""
    return _combined(a, b, -1)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; see the module."""
    signs = lambda f: F.transform(f["ones"], lambda x: (2 * x - f["n"]).cast("double"))
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x)
    apart = square(F.zip_with(signs(a), signs(b), lambda x, y: x - y))
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(1 - F.try_divide(apart, square(signs(a)) + square(signs(b))), F.lit(0.0))))


def text_form(f: Column) -> Column:
    """n;ones;sums, numbers in decimal, joined by commas."""
    return F.concat_ws(";", f["n"].cast("string"), F.array_join(f["ones"].cast("array<string>"), ","), F.array_join(f["sums"].cast("array<string>"), ","))


def predecessors(keys: DataFrame, n: int) -> DataFrame:
    """For each distinct (id, k1, k2, n_chars) of keys: k1, k2, and as `p` the row whose successor it is.

    Successors go by falling (id, k1, k2), and the least row's is the greatest. keys has n rows.
    """
    row = F.struct("id", "k1", "k2", "n_chars")
    parts = task_count(keys.sparkSession, n // 50_000 + 1)
    ranged = materialize(keys.repartitionByRange(parts, "id", "k1", "k2").withColumn("range", F.spark_partition_id()), "order")
    by = Window.orderBy("range")  # over one row a range
    starts = ranged.groupBy("range").agg(F.min(row).alias("s"))
    starts = starts.select("range", F.coalesce(F.lead("s").over(by), F.first("s").over(by.rowsBetween(Window.unboundedPreceding, 0))).alias("after"))
    inside = F.lead(row).over(Window.partitionBy("range").orderBy("id", "k1", "k2"))
    return ranged.withColumn("inside", inside).join(F.broadcast(starts), "range").select("k1", "k2", F.coalesce("inside", "after").alias("p"))


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, next_id, text, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint) for every row; fingerprints as structs.

    edited: the text's last floor(n_chars / 2) code points replaced by the first as many, or all, of its successor.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumns({"k1": F.xxhash64("id", "text"), "k2": F.xxhash64(F.lit(0x9E3779B9), "id", "text")})
    keys = materialize(rows.select("id", "k1", "k2", F.char_length("text").cast("long").alias("n_chars")).groupBy("id", "k1", "k2").agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("c")), "keys")
    n, most = keys.agg(F.count("*"), F.max("c")).first()
    before = predecessors(keys.drop("c"), n)
    rows = with_fingerprint(rows, "text", "f")
    # Both joins need the same columns of the rows by the same keys, so Spark makes the rows and their exchange once.
    sent = rows.join(before.hint("shuffle_hash"), ["k1", "k2"]).select(F.col("p.k1").alias("k1"), F.col("p.k2").alias("k2"), F.col("id").alias("next_id"), F.left("text", F.expr("p.n_chars div 2").cast("int")).alias("head"), F.col("f").alias("next_f"))
    if (most or 0) > 1:  # repeated rows have sent the same head
        sent = sent.dropDuplicates(["k1", "k2"])
    half = F.char_length("text") - F.floor(F.char_length("text") / 2)
    both = rows.join(sent.hint("merge"), ["k1", "k2"]).select("id", "next_id", "text", "f", "next_f", F.concat(F.left("text", half.cast("int")), "head").alias("edited"))
    both = with_fingerprint(both, "edited", "edited_f")
    return both.select("id", "next_id", "text", F.char_length("text").cast("long").alias("n_chars"), "edited", F.col("f").alias("fingerprint"), F.col("edited_f").alias("edited_fingerprint"), F.col("next_f").alias("next_fingerprint"))


def op13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document."""
    found = edit_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    own, edited, following = found["fingerprint"], found["edited_fingerprint"], found["next_fingerprint"]
    return found.select(
        F.col("id").alias("doc_id"), F.col("next_id").alias("next_doc_id"), "n_chars", F.sha2(found["edited"], 256).alias("edited_sha256"), text_form(own).alias("fingerprint"), text_form(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"), likeness(own, following).alias("near_next"),
    )


_BITS = "list_transform(range(0, 128), lambda j: (('0x' || substr(m, ((j // 32) * 8 + 1)::INT, 8))::BIGINT >> (j % 32)::INT) & 1)"
_PRINT = lambda t: f"""SELECT k, n || ';' || array_to_string(ones, ',') || ';' || array_to_string(sums, ',') AS f, n, ones, sums FROM (
  SELECT k, coalesce(n, 0)::BIGINT AS n, coalesce(ones, list_transform(range(0, 128), lambda j: 0::BIGINT)) AS ones, sums
  FROM (SELECT k, list(s ORDER BY j) AS sums FROM (SELECT k, j, (sum(('0x' || substr(h, (j * 8 + 1)::INT, 8))::BIGINT) % 4294967296)::BIGINT AS s FROM (SELECT k, sha256(unnest(string_split({t}, chr(10)))) AS h FROM e), (SELECT unnest(range(0, 8)) AS j) GROUP BY k, j) GROUP BY k)
  LEFT JOIN (SELECT k, max(n) AS n, list(s ORDER BY j) AS ones FROM (SELECT k, j, count(*) AS n, sum(v)::BIGINT AS s FROM (SELECT k, unnest(range(0, 128)) AS j, unnest({_BITS}) AS v FROM (SELECT k, md5(s) AS m FROM (SELECT k, unnest(string_split(regexp_replace({t}, '([.!?])[ \\t]', '\\1' || chr(10), 'g'), chr(10))) AS s FROM e) WHERE trim(s, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) <> '')) GROUP BY k, j) GROUP BY k) USING (k))"""  # noqa: E731
_NEAR = lambda a, b: f"""CASE WHEN {a}.f = {b}.f THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, coalesce(1 - list_sum(list_transform(range(1, 129), lambda j: (((2 * {a}.ones[j] - {a}.n) - (2 * {b}.ones[j] - {b}.n)) ** 2)::DOUBLE))
  / nullif(list_sum(list_transform(range(1, 129), lambda j: ((2 * {a}.ones[j] - {a}.n) ** 2 + (2 * {b}.ones[j] - {b}.n) ** 2)::DOUBLE)), 0), 0)) END"""  # noqa: E731

#: Ids are taken as distinct, as they are in `documents`.
ORACLE = {
    "op13_fingerprint": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS k, count(*) OVER () AS many FROM documents),
e AS (SELECT d.k, d.doc_id, d.text, d.n, x.k AS next, x.doc_id AS next_id, left(d.text, d.n - d.n // 2) || left(x.text, d.n // 2) AS edited FROM d JOIN d x ON x.k = d.k % d.many + 1),
a AS ({_PRINT("text")}),
b AS ({_PRINT("edited")})
SELECT e.doc_id, e.next_id AS next_doc_id, e.n::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint, {_NEAR("a", "b")} AS near_edited, {_NEAR("a", "x")} AS near_next
FROM e JOIN a USING (k) JOIN b USING (k) JOIN a x ON x.k = e.next""",
}
