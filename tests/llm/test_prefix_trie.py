"""The prefix trie against a brute-force trie: families, long conversations, ties, nulls and empty tables."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie

KIND = "conv_id long, turn long, role string, text string"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    built = {}
    for c, t in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(convs.get(base, [])[:h] + t[h:])
    members, ends = {}, {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
        ends.setdefault(t, []).append(c)
    kids = {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    saved, leaves = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += p not in kids
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted([(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], digest(ends.get(p, []))) for p, m in members.items()], key=str)


def trie(df, **how):
    out = prefix_trie.prefix_trie(df, **how)
    return sorted([tuple(r[c] for c in COLUMNS) for r in out.collect()], key=str)


def table(seed):
    rng = random.Random(seed)
    rows = []
    for c in {*range(-45, 50), *(rng.randrange(-10**6, 10**6) for _ in range(25)), *(20_480 * k + 20 for k in range(4))}:
        if rng.random() < 0.15:
            continue  # some families have no head
        for i in range(rng.choice([1, 1, 2, 3, 5, 9, 14])):
            rows.append((c, rng.choice([i, i, i, 3, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a b", "a b", "", None, "cc\tdd  e f", "x" * 2000])))
    same = [(30_000 + 20 * k, i, "user", f"turn {i}") for k in range(40) for i in range(3)]  # many equal conversations
    rows += same + rows[:20] + [(None, 1, "user", "nobody's")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("segment", "per_range"), [(4096, 20_000), (4, 25)])
def test_against_brute_force(spark, segment, per_range):
    rows = table(segment)
    df = spark.createDataFrame(rows, KIND).withColumns({"depth": F.lit(7), "k1": F.lit("x"), "base": F.lit(None)})  # clashing names
    assert trie(df, segment=segment, per_range=per_range) == brute(rows)


def test_a_long_conversation_is_dealt_over_ranges_and_segments(spark):
    rows = [(c, i, "user", f"w{i} x") for c in (40, 41, 55) for i in range(c * 3)] + [(60 + i, 0, "user", "w0 x") for i in range(5)]
    df = spark.createDataFrame(rows, KIND)
    turns = prefix_trie.numbered_turns(df, per_range=16)
    assert {(r.conv, r.pos) for r in turns.collect()} == {(c, i + 1) for c, i, _, _ in rows}
    nodes = prefix_trie.family_nodes(turns, 10)
    assert nodes.groupBy("base", F.expr("depth div 10")).count().agg(F.max("count")).first()[0] <= 39 * 11
    assert trie(df, segment=10, per_range=16) == brute(rows)


def test_empty_tables_and_turnless_conversations(spark):
    df = spark.createDataFrame([(None, 1, "user", "x")], KIND)
    assert trie(df) == trie(df.limit(0)) == []
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 1, "user", "skipped"), (c, 2, None, None)]
    assert trie(spark.createDataFrame(rows, KIND)) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_blocks_of_ends_are_joined_in_order(spark):
    ids = [20 * k for k in range(3000)]  # three blocks
    rows = [(c, 1, "user", "the same") for c in ids]
    got = next(r for r in trie(spark.createDataFrame(rows, KIND)) if r[1] == 1)
    assert got[3] == 3000 and got[7] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
