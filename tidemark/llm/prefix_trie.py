"""The prefix trie of conversations, by family-first merging.

A conversation c (one id) is rebuilt from its family's head, the first h turns of conversation c - c % 20 (h =
crc32(decimal c) % 4; all if there are fewer), and its own turns after its first h. A node is a distinct sequence of
first d rebuilt turns (role, text); the root is d = 0. For each node: the least conversation that starts with it, depth,
parent, how many conversations start with it, children, childless nodes below, the tokens that sharing saves below it,
and a digest of the conversations that end in it.

How it works
- Turns are reduced to two 64-bit hashes and a count of words, and numbered within their conversation: they are sorted
  by range of (conversation, turn), numbered within a range, and what earlier ranges hold of a conversation that spans
  several (one a border at most) is added. So a conversation of any length is dealt over many tasks.
- Families, in segments of `segment` turns, are cogrouped with their head: each group rebuilds its conversations and
  builds its small trie. A node's key is its depth and the exclusive or of hashes of (position, turn) along its path, so
  later segments continue from what earlier ones sum up to. A group is bounded: 39 conversations times a segment.
- Only the families' nodes are shuffled and merged by key. Members and ends travel as bits of the family, not as lists.
- What is summed over a subtree is summed along paths: a node belongs to its least conversation, whose nodes are the
  tail of its path, and counts for every node on that path above it. So a node's sum is that of suffix sums of its
  members' paths, found per family once more and added up by key: work linear in the turns, however deep the trie.
- Ends are joined to texts in blocks of 20,480 ids and streamed, in order, through SHA-256.

Cases: a null role or text is empty; null turns come first, and turns of equal number go by role and text. Repeated rows
are turns of their own. Rows without conv_id belong to no conversation. A conversation left without turns ends in the
root. An empty table has no conversation and so no node. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, task_count, tidy

#: Fixed by the rule: a family is 20 ids, and its head has 3 turns at most.
FAMILY, HEAD = 20, 3
#: Turns of a conversation that one group holds; ids whose ends one text joins (a multiple of FAMILY).
SEGMENT, BLOCK = 4096, 20_480
#: Rows of a range when turns are sorted.
PER_RANGE = 20_000
#: Parents of more than 1 / HOT of all nodes, of which there are HOT at most, are broadcast.
HOT = 20_000
KEY = ["depth", "k1", "k2"]
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64 (fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def step_hashes(depth: np.ndarray, t1: np.ndarray, t2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each turn at its position; a path's key is their exclusive or along it."""
    d = depth.astype(np.uint64)
    a, b = t1.astype(np.int64).view(np.uint64), t2.astype(np.int64).view(np.uint64)
    return tuple(_mix(_mix(x + d * seed) ^ y) for x, y, seed in ((a, b, _SEEDS[0]), (b, a, _SEEDS[1])))


def base_of(conv: Column) -> Column:
    return conv - conv % FAMILY


def numbered_turns(rows: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """(conv, base, h, pos, t1, t2, words): each row's place from 1 in its conversation; the texts are left behind."""
    spark = rows.sparkSession
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    tasks = task_count(spark, rows.count() // per_range + 1, each=1)
    rows = rows.repartitionByRange(tasks, "conv", "turn", "role", "text").sortWithinPartitions("conv", "turn", "role", "text")
    rows = rows.select("conv", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(0x9E3779B9), "role", "text").alias("t2"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"), F.spark_partition_id().alias("range"))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, seen = None, 0
        for batch in batches:
            conv = batch["conv"].to_numpy()
            if not len(conv):
                continue
            starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            pos = np.arange(len(conv)) - np.repeat(starts, np.diff(np.r_[starts, len(conv)])) + 1
            if conv[0] == last:
                pos[: starts[1] if len(starts) > 1 else len(conv)] += seen
            last, seen = conv[-1], int(pos[-1])
            yield batch.assign(pos=pos)

    schema = "conv long, t1 long, t2 long, words int, range int, pos long"
    rows = materialize(rows.mapInPandas(tidy("trie", number), schema), "turns")
    # A conversation that spans several ranges is the first or the last of each.
    parts = rows.groupBy("range", "conv").agg(F.max("pos").alias("n"))
    edges = rows.groupBy("range").agg(F.min("conv").alias("a"), F.max("conv").alias("b")).select(F.explode(F.array("a", "b")).alias("conv")).distinct()  # two a range at most
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.join(F.broadcast(edges), "conv").select("conv", "range", F.sum("n").over(before).alias("shift")).where("shift > 0")  # as many
    rows = rows.join(F.broadcast(shift), ["conv", "range"], "left").withColumn("pos", F.col("pos") + F.coalesce("shift", F.lit(0)))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    return rows.select("conv", base_of(F.col("conv")).alias("base"), h.cast("int").alias("h"), "pos", "t1", "t2", "words")


def _heads(turns: DataFrame) -> DataFrame:
    """(base, head): the first turns of the families' own conversations, in order."""
    return turns.where(f"conv = base AND pos <= {HEAD}").groupBy("base").agg(F.array_sort(F.collect_list(F.struct("pos", "t1", "t2", "words"))).alias("head"))


def _later(turns: DataFrame, heads: DataFrame, segment: int) -> DataFrame:
    """(base, seg, conv, x1, x2, more): for conversations longer than a segment, what the path's key is at the start of each
    segment, and whether another follows. Most tables have none; the work is that of the long ones alone."""
    long = turns.where(F.col("pos") > segment).select("conv").distinct()
    rows = turns.join(long, "conv", "left_semi").join(heads, "base", "left")
    skipped = F.least(F.col("h"), F.coalesce(F.size("head"), F.lit(0)))  # turns that the head gives
    own = rows.where("pos > h").select("base", "conv", F.expr(f"(pos - 1) div {segment}").alias("seg"), (F.col("pos") - F.col("h") + skipped).alias("depth"), "t1", "t2")
    lead = rows.where("pos = 1").select("base", "conv", F.lit(0).cast("long").alias("seg"), F.inline(F.expr("slice(head, 1, h)"))).select("base", "conv", "seg", F.col("pos").alias("depth"), "t1", "t2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f1, f2 = step_hashes(b["depth"].to_numpy(), b["t1"].to_numpy(), b["t2"].to_numpy())
            yield b[["base", "conv", "seg"]].assign(f1=f1.view(np.int64), f2=f2.view(np.int64))

    sums = own.unionByName(lead).mapInPandas(tidy("trie", run), "base long, conv long, seg long, f1 long, f2 long").groupBy("base", "conv", "seg").agg(F.bit_xor("f1").alias("f1"), F.bit_xor("f2").alias("f2"))
    w = Window.partitionBy("conv").orderBy("seg")  # over one row a segment
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return sums.select("base", "seg", "conv", zero(F.bit_xor("f1").over(upto)).alias("x1"), zero(F.bit_xor("f2").over(upto)).alias("x2"), F.lead("seg").over(w).isNotNull().alias("more"))


_NODES = "base long, depth long, k1 long, k2 long, p1 long, p2 long, words int, members long, ends long"


def _runs(x: np.ndarray) -> np.ndarray:
    """Where a run of equal values starts in a sorted array."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]])


def _family_trie(key: tuple, turns: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one family's segment, with members and ends as bits: bit (conv - base + 19)."""
    base, seg = int(key[0]), int(key[1])
    kind, facts = facts["kind"].to_numpy(), {c: facts[c].to_numpy() for c in ("conv", "x1", "x2", "more", "pos", "t1", "t2", "words")}
    in_order = np.flatnonzero(kind == 0)[np.argsort(facts["pos"][kind == 0])]
    head = {c: facts[c][in_order].astype(np.int64) for c in ("pos", "t1", "t2", "words")}
    conv, h, pos, t1, t2, words = (turns[c].to_numpy(np.int64) for c in ("conv", "h", "pos", "t1", "t2", "words"))
    each, first = np.unique(conv, return_index=True)
    given = np.minimum(h, len(in_order))  # turns that the head gives
    own = pos > h
    parts = [(conv[own], (pos - h + given)[own], t1[own], t2[own], words[own])]
    starts = np.zeros(len(each), np.int64)
    if seg:
        starts[:] = np.iinfo(np.int64).max
        np.minimum.at(starts, np.searchsorted(each, conv[own]), parts[0][1] - 1)
    else:
        many = given[first]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        parts.append((np.repeat(each, many), at + 1, *(head[c][at] for c in ("t1", "t2", "words"))))
    # Each conversation's path begins with the state before its first turn here: the root, or what earlier segments left.
    zero = np.zeros(len(each), np.int64)
    parts.append((each, starts, zero, zero, zero))
    conv, depth, t1, t2, words = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((depth, conv))
    conv, depth, t1, t2, words = (c[order] for c in (conv, depth, t1, t2, words))
    begin = _runs(conv)
    last = np.r_[begin[1:], len(conv)] - 1
    keys = []
    later, more = np.flatnonzero(kind == 1), np.zeros(len(each), bool)
    place = np.searchsorted(each, facts["conv"][later])
    more[place] = facts["more"][later].astype(bool)
    for f, x in zip(step_hashes(depth, t1, t2), ("x1", "x2"), strict=True):
        f[begin] = 0
        f[begin[place]] = facts[x][later].astype(np.int64).view(np.uint64)
        total = np.bitwise_xor.accumulate(f)
        keys.append((total ^ np.repeat(np.r_[np.uint64(0), total[last[:-1]]], last - begin + 1)).view(np.int64))
    k1, k2 = keys
    bits = np.int64(1) << (conv - base + FAMILY - 1)
    ends = np.zeros(len(conv), np.int64)
    ends[last[~more]] = bits[last[~more]]
    p1, p2 = np.r_[0, k1[:-1]], np.r_[0, k2[:-1]]
    p1[begin] = p2[begin] = 0
    keep = np.ones(len(conv), bool)
    if seg:  # the state is a node of an earlier segment
        keep[begin] = ends[begin] != 0
    # Equal paths of the family become one node; bits of different conversations add up.
    order = np.lexsort((k2, k1, depth))
    order = order[keep[order]]
    if not len(order):
        return pd.DataFrame({c: np.empty(0, np.int64) for c in ("base", *KEY, "p1", "p2", "words", "members", "ends")}).astype({"words": np.int32})
    depth, k1, k2, p1, p2, words, bits, ends = (c[order] for c in (depth, k1, k2, p1, p2, words, bits, ends))
    new = np.flatnonzero(np.r_[True, (depth[1:] != depth[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
    one = {c: v[new] for c, v in zip((*KEY, "p1", "p2", "words"), (depth, k1, k2, p1, p2, words.astype(np.int32)), strict=True)}
    return pd.DataFrame({"base": np.full(len(new), base), **one, "members": np.add.reduceat(bits, new), "ends": np.add.reduceat(ends, new)})


def family_nodes(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The tries of all families, one row a node of a family (and segment)."""
    heads = _heads(turns)
    seg = F.expr(f"(pos - 1) div {segment}").alias("seg")
    # No nulls: pandas would make floats of the hashes. kind 0 is a turn of the head, kind 1 a later segment's start.
    zero, head = F.lit(0).cast("long"), turns.select("base", seg).distinct().join(heads, "base").select("base", "seg", F.inline("head"))
    facts = head.select("base", "seg", F.lit(0).alias("kind"), zero.alias("conv"), zero.alias("x1"), zero.alias("x2"), F.lit(False).alias("more"), "pos", "t1", "t2", "words")
    later = _later(turns, heads, segment).select("base", "seg", F.lit(1).alias("kind"), "conv", "x1", "x2", "more", *[zero.alias(c) for c in ("pos", "t1", "t2")], F.lit(0).alias("words"))
    facts = facts.unionByName(later)
    facts = facts.toDF(*facts.columns)  # columns of its own, apart from those of the turns
    own = turns.select("base", seg, "conv", "h", "pos", "t1", "t2", "words")
    return own.groupBy("base", "seg").cogroup(facts.groupBy("base", "seg")).applyInPandas(_family_trie, _NODES)


def _low_bit(mask: Column) -> Column:
    """The number of the lowest bit that is set."""
    return F.bit_count(mask.bitwiseAND(-mask) - 1)


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """(depth, k1, k2, p1, p2, conv_id, n_convs, n_children, value, leaf): families' nodes of equal key as one, with its children.

    value: what the node itself saves; leaf: 1 for a node without children.
    """
    least = F.col("base") + _low_bit(F.col("members")) - (FAMILY - 1)
    one = nodes.withColumn("least", least).groupBy(*KEY).agg(F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("words").alias("words"), F.sum(F.bit_count("members")).alias("n_convs"), F.min("least").alias("conv_id"))
    one = materialize(one, "merged")
    kids = one.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    one = one.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    return one.select(*KEY, "p1", "p2", "conv_id", "n_convs", "n_children", ((F.col("n_convs") - 1) * F.col("words")).alias("value"), (F.col("n_children") == 0).cast("long").alias("leaf"))


_SUMS = "depth long, k1 long, k2 long, saved long, leaves long"


def _family_sums(key: tuple, nodes: pd.DataFrame, owned: pd.DataFrame) -> pd.DataFrame:
    """For each node of a family's segment: the sums of what its members own at its depth or below."""
    base = int(key[0])
    depth = nodes["depth"].to_numpy(np.int64)
    members = nodes["members"].to_numpy(np.int64)
    saved, leaves = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
    conv, d, value, leaf = (owned[c].to_numpy(np.int64) for c in ("conv", "depth", "value", "leaf"))
    order = np.lexsort((d, conv))
    conv, d, value, leaf = conv[order], d[order], value[order], leaf[order]
    begin = _runs(conv) if len(conv) else np.empty(0, np.int64)
    for i, j in zip(begin, [*begin[1:], len(conv)], strict=False):  # none, if nothing is owned here
        mine = np.flatnonzero((members >> np.int64(int(conv[i]) - base + FAMILY - 1)) & 1)
        at = np.searchsorted(d[i:j], depth[mine])
        for total, c in ((saved, value), (leaves, leaf)):
            total[mine] += np.r_[np.cumsum(c[i:j][::-1])[::-1], 0][at]
    return pd.DataFrame({"depth": depth, "k1": nodes["k1"].to_numpy(), "k2": nodes["k2"].to_numpy(), "saved": saved, "leaves": leaves})


def subtree_sums(nodes: DataFrame, merged: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(depth, k1, k2, saved, leaves) over the subtree of every node."""
    seg = lambda c: F.expr(f"{c} div {segment}")
    owned = merged.select(base_of(F.col("conv_id")).alias("base"), seg("depth").alias("seg"), F.col("conv_id").alias("conv"), "depth", "value", "leaf")
    # What a conversation owns in later segments stands at the end of each earlier one that its family's path has.
    per = owned.groupBy("base", "conv", "seg").agg(F.sum("value").alias("value"), F.sum("leaf").alias("leaf")).where("seg > 0")
    one = Window.partitionBy("conv")  # a row a segment; a conversation owns all segments from its first on
    on = one.orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col("seg") == F.min("seg").over(one), F.sequence(F.lit(0).cast("long"), F.col("seg") - 1)).otherwise(F.array(F.col("seg") - 1))
    carried = per.select("base", "conv", at.alias("at"), F.sum("value").over(on).alias("value"), F.sum("leaf").over(on).alias("leaf")).withColumn("seg", F.explode("at"))
    carried = carried.select("base", "seg", "conv", ((F.col("seg") + 1) * segment - 1).alias("depth"), "value", "leaf")
    left = nodes.select("base", seg("depth").alias("seg"), *KEY, "members")
    found = left.groupBy("base", "seg").cogroup(owned.unionByName(carried).groupBy("base", "seg")).applyInPandas(_family_sums, _SUMS)
    return found.groupBy(*KEY).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))


def end_digests(nodes: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of nodes in which conversations end: their ids, ascending, joined by commas."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(2 * FAMILY - 2)), lambda b: F.call_function("getbit", F.col("ends"), b) == 1)
    ids = nodes.where("ends <> 0").select(*KEY, F.floor(F.col("base") / BLOCK).alias("block"), F.explode(F.transform(bits, lambda b: F.col("base") + b - (FAMILY - 1))).alias("id"))
    blocks = ids.groupBy(*KEY, "block").agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("text"), F.min("id").alias("first"))
    blocks = blocks.repartition(*KEY).sortWithinPartitions(*KEY, "first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, digest = None, None
        for b in batches:
            out = []
            for *key, text in b[[*KEY, "text"]].itertuples(index=False):
                if key != last:
                    if digest is not None:
                        out.append((*last, digest.hexdigest()))
                    last, digest = key, hashlib.sha256(text.encode())
                else:
                    digest.update(f",{text}".encode())
            yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
        if digest is not None:
            yield pd.DataFrame([(*last, digest.hexdigest())], columns=[*KEY, "ends_sha256"])

    return blocks.select(*KEY, "text").mapInPandas(tidy("trie", run), "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT, per_range: int = PER_RANGE) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: (conv_id, turn, role, text). segment: turns of a conversation that a group holds.
    """
    if segment <= HEAD:
        raise ValueError("a segment must be longer than a head")
    nodes = materialize(family_nodes(materialize(numbered_turns(conversations, per_range), "numbered"), segment), "families")
    merged = materialize(merged_nodes(nodes), "nodes")
    sums, ends = subtree_sums(nodes, merged, segment), end_digests(nodes)
    out = merged.join(sums, KEY).join(ends, KEY, "left")
    # A parent may have a third of all nodes as children: such parents go to the children, the rest meet them by key.
    n = merged.count()
    parents = merged.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.col("n_children") > n / HOT
    by = ["depth", "p1", "p2"]
    out = out.join(F.broadcast(parents.where(hot).drop("n_children").withColumnRenamed("parent_conv_id", "hot_conv_id")), by, "left")
    # Rows that have their parent meet nobody, each under its own key.
    done = F.expr("depth = 0 OR hot_conv_id IS NOT NULL")
    out = out.withColumns({"jd": F.when(done, -1).otherwise(F.col("depth")), "j1": F.when(done, F.col("k1")).otherwise(F.col("p1")), "j2": F.when(done, F.col("k2")).otherwise(F.col("p2"))})
    rest = parents.where(~hot).select(F.col("depth").alias("jd"), F.col("p1").alias("j1"), F.col("p2").alias("j2"), "parent_conv_id")
    out = out.join(rest, ["jd", "j1", "j2"], "left").withColumn("parent_conv_id", F.coalesce("hot_conv_id", "parent_conv_id"))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")]
    return out.select(*cols)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations; see the module for its cases."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


# CRC-32 of a decimal id, bit by bit (the polynomial and the start are fixed values).
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], range(0, 8 * length(conv_id::VARCHAR))),
  lambda a, i: CASE WHEN (xor(a, CASE WHEN i % 8 = 0 THEN ascii(substr(conv_id::VARCHAR, (i // 8 + 1)::INT, 1)) ELSE 0 END) & 1) = 1
    THEN xor(xor(a, CASE WHEN i % 8 = 0 THEN ascii(substr(conv_id::VARCHAR, (i // 8 + 1)::INT, 1)) ELSE 0 END) >> 1, 3988292384)
    ELSE xor(a, CASE WHEN i % 8 = 0 THEN ascii(substr(conv_id::VARCHAR, (i // 8 + 1)::INT, 1)) ELSE 0 END) >> 1 END), 4294967295::BIGINT)"""

ORACLE = {
    "op12_prefix_trie": f"""
WITH o AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS xs FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
c AS (SELECT conv_id, xs, ({_CRC} % 4)::INT AS h FROM o),
r AS (SELECT c.conv_id, list_concat(coalesce(b.xs, [])[1:c.h], c.xs[c.h + 1:]) AS xs FROM c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, len(xs) AS n, d, xs[1:d] AS path FROM (SELECT conv_id, xs, unnest(range(0, len(xs) + 1)) AS d FROM r)),
m AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN n = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends,
  (count(*) - 1) * (CASE WHEN d = 0 THEN 0 ELSE len(list_filter(string_split_regex(path[d].t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) END) AS value FROM p GROUP BY 1, 2),
k AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM m WHERE d > 0 GROUP BY 1),
f AS (SELECT m.*, coalesce(n_children, 0) AS n_children FROM m LEFT JOIN k USING (path)),
s AS (SELECT a AS path, sum(value) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT path[1:i] AS a, value, n_children FROM (SELECT path, value, n_children, unnest(range(0, d + 1)) AS i FROM f)) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN s USING (path) LEFT JOIN m u ON f.d > 0 AND u.d = f.d - 1 AND u.path = f.path[1:f.d - 1]""",
}
