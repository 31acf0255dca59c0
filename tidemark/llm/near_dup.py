"""Near-duplicate documents by banded MinHash with odd sketches, confirmed on full shingle sets.

Words are maximal runs of bytes other than [\\x20\\x09-\\x0D] after A-Z are lower-cased; a document's set holds its
distinct k-word shingles (64-bit hashes), or its whole sequence as one where it has fewer words. Two documents are
linked if 100 * intersection >= percent * union. The result is each document's component.

1. One pass over the texts gives, per document, the set's size and fingerprint, BANDS x ROWS MinHash samples folded
   into band keys, and an odd sketch: a bitmap in which each sample flips one bit, so that the population count of the
   XOR of two sketches tells their similarity.
2. Documents of one fingerprint are one class, represented by its least id. Only classes go on.
3. Classes that share a band key share a bucket. In each bucket one leader is compared with the others (not all
   pairs): sizes and sketches discard what can't be similar, full sets confirm the rest; components are formed.
   This is done `rounds` times with other leaders, in buckets that still hold more than one component.
4. In buckets that still do, every pair of classes of different components is compared by sketch, in blocks of
   bounded size that are dealt over all tasks. In buckets of up to HOT classes what passes goes to the full sets by
   joins; in larger ones the sets, folded to 31-bit hashes, come to the blocks, which return what may still be a link
   (folding only adds to an intersection) for the full sets to confirm, so that near misses in a large group make no
   rows. Every pair that shares a bucket is either connected already or checked; none is capped.
   A large group of copies is connected in step 3 and costs a row each. Facts of the buckets that hold more than
   1 / COMMON of all rows, COMMON of them at most, are broadcast to their rows; the others are joined by bucket.

At a similarity of 0.8, 24 bands of 4 rows miss a pair with probability 3e-6; the sketch test leaves a margin of 5.5
standard deviations.

Cases: a null or empty text, or one of white space, has an empty set and is linked with nothing. Rows of a null id
are linked with nothing, have a null component and are kept. Rows of one id are one document, whatever their
texts, so they share a component. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialize, task_count, tidy

BANDS, ROWS, BITS = 24, 4, 512
#: Classes in a block, without and with sets; classes in a bucket beyond which sets are sent to the blocks.
BLOCK, SET_BLOCK, HOT = 2048, 1024, 64
#: Buckets at most whose facts are broadcast.
COMMON = 20_000
_U = np.uint64
_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | _U(1)
_ADD = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_SEAT = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """The sorted distinct shingle hashes of a text; word hashes are kept in a bounded cache."""

    def __init__(self, k: int, cache: int = 150_000):
        self.k, self.cache, self.codes = k, cache, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # bytes: A-Z and [\x20\x09-\x0D] only
        if not words:
            return np.empty(0, np.uint64)
        codes = self.codes
        if len(codes) > self.cache:
            codes.clear()
        for w in set(words).difference(codes):
            codes[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(words))
        n = len(words) - k + 1
        out = mix(h[:n] + _U(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        for j in range(1, k):
            out = mix(out + h[j : j + n])
        return np.unique(out)


def samples(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that isn't empty."""
    least = np.full(len(_MUL), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[i : i + 2048, None] * _MUL + _ADD).min(0), out=least)
    return least


def fold(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketch), both int64; least: [set, sample]."""
    keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(least), 0)
    rows = least.reshape(-1, BANDS, ROWS)
    for r in range(ROWS):
        keys = mix(keys * _U(0x9E3779B97F4A7C15) + rows[:, :, r])
    seat = (mix(least ^ _SEAT) % _U(BITS)).astype(np.int64) + np.arange(len(least))[:, None] * BITS
    odd = (np.bincount(seat.ravel(), minlength=len(least) * BITS) & 1).astype(np.uint8)
    return keys.view(np.int64), np.packbits(odd.reshape(len(least), BITS), axis=1).view(np.int64)


def most_bits(percent: int, deviations: float = 5.5) -> int:
    """Differing sketch bits that a pair at the threshold stays under, by so many standard deviations."""
    n, j = BANDS * ROWS, percent / 100
    apart = 2 * n * (1 - j)
    fade = np.exp(-2 * apart / BITS)
    spread = (4 * n * j * (1 - j) * fade**2 + BITS / 4 * (1 - fade**2)) ** 0.5
    return int(np.ceil(BITS / 2 * (1 - fade) + deviations * spread))


def describe(docs: DataFrame, k: int) -> DataFrame:
    """(id, t, n, f1, f2, keys, sketch) of every row of (id, t, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(k)
        for b in batches:
            n, prints, least, some = np.zeros(len(b), np.int64), np.zeros((len(b), 2), np.uint64), [], []
            for i, t in enumerate(b["text"]):  # one set at a time
                s = shingle(t) if isinstance(t, str) else np.empty(0, np.uint64)
                raw = s.tobytes()
                n[i], prints[i] = len(s), (xxhash.xxh64_intdigest(raw, 1), xxhash.xxh64_intdigest(raw, 2))
                if len(s):
                    some.append(i)
                    least.append(samples(s))
            prints = prints.view(np.int64)
            keys, sketch = [None] * len(b), [None] * len(b)
            if some:
                for i, x, y in zip(some, *fold(np.array(least)), strict=True):
                    keys[i], sketch[i] = x, y
            yield pd.DataFrame({"id": b["id"].array, "t": b["t"].array, "n": n, "f1": prints[:, 0], "f2": prints[:, 1], "keys": keys, "sketch": sketch})

    return docs.mapInPandas(tidy("near_dup", run), "id long, t long, n long, f1 long, f2 long, keys array<long>, sketch array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of every row of (node, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(k)
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "shingles": [shingle(t).view(np.int64) for t in b["text"]]})

    return docs.mapInPandas(tidy("near_dup", run), "node long, shingles array<long>")


def _apart(a: str, b: str) -> Column:
    return sum((F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(BITS // 64)), F.lit(0))


def _blocks(cross: DataFrame, percent: int, with_sets: bool) -> DataFrame:
    """(a, b) of different components in one bucket and alike by size and sketch; with_sets: by folded sets, too.

    cross: bucket, node, component, n, keys, sketch, count and, with sets, shingles (array<int>).
    """
    spark = cross.sparkSession
    deal = F.greatest(F.lit(1), F.ceil(F.col("count") / (SET_BLOCK if with_sets else BLOCK))).cast("int")
    compared = int(cross.agg(F.coalesce(F.sum(F.col("count").cast("double")), F.lit(0.0))).first()[0])
    rows = cross.withColumn("parts", deal).withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    # A block meets every other once: a row of block o goes to the tasks (min(o, x), max(o, x)) for all x.
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    more = ["shingles"] if with_sets else []
    rows = rows.select("bucket", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "own", "node", "component", "n", "keys", "sketch", *more)
    most = most_bits(percent)

    def pairs(g: pd.DataFrame) -> tuple[list[int], list[int]]:
        left = g[g["own"] == g["i"]]
        right = g[g["own"] == g["j"]]
        if not len(left) or not len(right):
            return [], []
        ka, kb = np.stack(left["keys"]), np.stack(right["keys"])
        sa, sb = np.stack(left["sketch"]), np.stack(right["sketch"])
        na, nb = left["n"].to_numpy(), right["n"].to_numpy()
        ca, cb = left["component"].to_numpy(), right["component"].to_numpy()
        ra, rb = left["node"].to_numpy(), right["node"].to_numpy()
        key, same = g["bucket"].iat[0], g["i"].iat[0] == g["j"].iat[0]
        if with_sets:
            # The block's own vocabulary: then one row's overlaps with all others are one look-up and sum.
            vocab, flat = np.unique(np.concatenate(right["shingles"].to_list()), return_inverse=True)
            starts = np.r_[0, np.cumsum(right["shingles"].map(len).to_numpy())[:-1]]
            sets = left["shingles"].to_list()
        ia, ib = [], []
        for r in range(len(left)):
            ok = (ca[r] != cb) & (100 * np.minimum(na[r], nb) >= percent * np.maximum(na[r], nb))
            if same:
                ok &= rb > ra[r]
            at = np.flatnonzero(ok)
            if len(at):
                at = at[np.bitwise_count((sa[r] ^ sb[at]).view(np.uint64)).sum(1) <= most]
            if len(at):
                eq = ka[r] == kb[at]  # only in the first bucket that they share
                at = at[ka[r][eq.argmax(1)] == key]
            if len(at) and with_sets:
                place = np.minimum(np.searchsorted(vocab, sets[r]), len(vocab) - 1)
                mark = np.zeros(len(vocab), np.int64)
                mark[place[vocab[place] == sets[r]]] = 1
                inter = np.add.reduceat(mark[flat], starts)[at]
                at = at[100 * inter >= percent * (na[r] + nb[at] - inter)]
            ia += [int(ra[r])] * len(at)
            ib += rb[at].tolist()
        return ia, ib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            k = b[["bucket", "i", "j"]].to_numpy()
            ends = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist()]
            for s, e in zip(ends[:-1], ends[1:], strict=True):
                x, y = pairs(b.iloc[s:e])
                if x:
                    yield pd.DataFrame({"a": x, "b": y})
            rest = b.iloc[ends[-1] :]
        if rest is not None and len(rest):
            x, y = pairs(rest)
            if x:
                yield pd.DataFrame({"a": x, "b": y})

    # Dealt by the number of comparisons, as rows say little of the work.
    tasks = task_count(spark, compared // 1_000_000 + 4 * spark.sparkContext.defaultParallelism, 1)
    rows = rows.repartition(tasks, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    found = rows.mapInPandas(tidy("near_dup", run), "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, rounds: int = 1) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row for each row of docs."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    own = materialize(describe(texts, k), "described")
    able = own.where("n > 0 AND id IS NOT NULL")
    # Classes: equal sets, each a node. Partial aggregates keep one row a fingerprint and task.
    classes = able.groupBy("f1", "f2").agg(F.min(F.struct("id", "t")).alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.select(F.xxhash64("f1", "f2").alias("node"), "f1", "f2", F.col("rep.id").alias("rep"), F.col("rep.t").alias("t"), "n", "keys", "sketch"), "classes")
    # An id with several texts stands for several classes: those are linked by sharing the id.
    named = able.select("id", F.xxhash64("f1", "f2").alias("node"))
    shared = named.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("id", "a")
    twins = named.join(shared, "id").select("a", F.col("node").alias("b")).where("a <> b").distinct()

    bands = classes.select(F.explode("keys").alias("bucket"), "node")
    counts = materialize(bands.groupBy("bucket").agg(F.count("*").alias("count")).where("count > 1"), "counts")
    cut = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0] / COMMON
    large = F.col("count") > cut
    found = bands.join(F.broadcast(counts.where(large)), "bucket", "left")
    found = found.where("count IS NOT NULL").unionByName(found.where("count IS NULL").drop("count").join(counts.where(~large), "bucket"))
    bands = materialize(found, "buckets")

    def by_bucket(rows: DataFrame, facts: DataFrame) -> DataFrame:
        """rows (bucket, count, ...) with the facts (bucket, count, ...) of their bucket."""
        near = rows.where(large).join(F.broadcast(facts.where(large).drop("count")), "bucket")
        return near.unionByName(rows.where(~large).join(facts.where(~large).drop("count"), "bucket"))

    involved = classes.join(bands.select("node").distinct(), "node").select("node", F.col("rep").alias("id"), "t")
    # The texts of classes that share a bucket, once each.
    held = texts.where("text IS NOT NULL").join(involved, ["id", "t"]).dropDuplicates(["node"])
    sets = materialize(full_sets(held.select("node", "text"), k), "sets")
    facts = classes.select("node", "n", "sketch")
    links = twins
    most = most_bits(percent)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose full sets are similar."""
        left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        both = pairs.join(left, "a").join(right, "b")
        inter = F.size(F.array_intersect("x", "y")).cast("long")
        return both.where(100 * inter >= percent * (F.size("x") + F.size("y") - inter)).select("a", "b")

    component = None
    for t in range(rounds):
        members = bands.select("bucket", "node", "count")
        if component is None:
            members = members.withColumn("component", F.col("node"))
        else:
            members = members.join(component, members["node"] == component["id"], "left").select("bucket", "node", "count", F.coalesce("component", "node").alias("component"))
        lead = members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64(F.lit(t), "node") if t else F.lit(0).cast("long"), "node", "component")).alias("lead"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.first("count").alias("count")).where("lo <> hi")
        pairs = by_bucket(members, lead.select("bucket", "count", F.col("lead.node").alias("a"), F.col("lead.component").alias("ca"))).where("component <> ca")
        pairs = pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        pairs = pairs.join(facts.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").join(facts.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
        pairs = pairs.where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (_apart("sa", "sb") <= most)).select("a", "b")
        links = materialize(links.unionByName(confirmed(pairs)), f"links{t}")
        component = components(links)
    members = bands.join(component, bands["node"] == component["id"], "left").select("bucket", "node", "count", F.coalesce("component", "node").alias("component"))
    open_ = members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.first("count").alias("count")).where("lo <> hi").select("bucket", "count")
    cross = by_bucket(members, open_).join(classes.select("node", "n", "keys", "sketch"), "node")
    cross = materialize(cross, "cross")
    folded = sets.select("node", F.transform("shingles", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("shingles"))
    hot = cross.where(F.col("count") > HOT).join(folded, "node")
    last = confirmed(_blocks(cross.where(F.col("count") <= HOT), percent, False).unionByName(_blocks(hot, percent, True)).distinct())
    component = components(materialize(links.unionByName(last), "links"))
    reps = classes.select("f1", "f2", "rep", "node").join(component, F.col("node") == F.col("id"), "left").select("f1", "f2", "rep", F.coalesce("component", "node").alias("component"))
    reps = reps.join(reps.groupBy("component").agg(F.min("rep").alias("least")), "component").select("f1", "f2", "least")
    out = own.select("id", "n", "f1", "f2").join(reps, ["f1", "f2"], "left")
    group = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("least")).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), group.alias("component_id"), F.coalesce(F.col("id") == group, F.lit(True)).alias("kept"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document, by shingles of two words and a similarity of 0.8."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, k=2).withColumnRenamed("id", "doc_id")


#: Sets of shingles, all pairs that share one, and what is reachable over links. Code points stand for bytes: both cut the same words.
ORACLE: dict[str, str] = {
    "op10_minhash": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingle FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), u AS (
  SELECT min(doc_id) AS rep, any_value(n) AS n, bits FROM (SELECT doc_id, n.n, md5(string_agg(shingle, chr(0) ORDER BY shingle)) AS bits FROM s JOIN n USING (doc_id) GROUP BY doc_id, n.n) GROUP BY bits
), k AS (
  SELECT s.* FROM s JOIN u ON s.doc_id = u.rep
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM k x JOIN k y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * common >= 80 * (x.n + y.n - common)
), r AS (
  SELECT rep, rep AS reached FROM u UNION SELECT r.rep, l.b FROM r JOIN l ON r.reached = l.a
), c AS (
  SELECT rep, min(reached) AS component_id FROM r GROUP BY rep
), f AS (
  SELECT doc_id, md5(string_agg(shingle, chr(0) ORDER BY shingle)) AS bits FROM s GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN u USING (bits) LEFT JOIN c ON u.rep = c.rep""",
}
