"""Similarity of short strings, and an exact index for joins by it.

The ratio is 100 * (1 - Levenshtein distance / longer length). Two strings of lengths m and l with a ratio of `least` or
more are at most d = max(m, l) * (1 - least / 100) edits apart. So if one of them is cut into d + 1 segments, one of these
stands unchanged in the other (the pigeonhole principle), and no further from its own place than the edits on either
side permit. `candidate_pairs` makes join keys of that: a string gives its d + 1 segments for each d that the lengths of
the terms permit, a term its substrings at the permitted places. Each edit also brings at most one letter that the other
string lacks, so pairs whose letters (64 bits) differ in more than d go before any distance is computed. Nothing that
reaches the ratio is lost, and all joins are equi-joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a term index that are broadcast; a larger one meets the strings by key.
INDEX_ROWS = 1_000_000


def ratio(a: Column, b: Column) -> Column:
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.coalesce(F.try_divide((longer - F.levenshtein(a, b)) * 100.0, longer), F.lit(0.0))


def in_order(words: Column) -> Column:
    return F.array_join(F.sort_array(F.split(words, " ")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """The ratio of both with their words in alphabetical order; sorting leaves lengths as they are."""
    return ratio(in_order(a), in_order(b))


def partial_ratio(a: Column, b: Column) -> Column:
    """The highest ratio of the shorter string to a stretch of its length in the longer; 100 if it stands there."""
    swap = F.char_length(a) > F.char_length(b)
    small, large = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    starts = F.sequence(F.lit(1), F.char_length(large) - F.char_length(small) + 1)
    best = F.array_max(F.transform(starts, lambda i: ratio(small, F.substring(large, i, F.char_length(small)))))
    return F.when(F.contains(large, small), 100.0).otherwise(best)


def _letters(c: Column) -> Column:
    """The letters of a string as bits."""
    one = F.lit(1).cast("long")
    return F.aggregate(F.split(c, ""), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", one, F.ascii(x) % 64)))


def edits(m: int, n: int, least: float) -> int:
    """How many edits leave strings of these lengths at `least` or more."""
    return int(max(m, n) * (100 - least) / 100 + 1e-6)


def _segments(length: int, d: int) -> list[tuple[int, int]]:
    """(start, length) of d + 1 segments of nearly equal length; one empty segment if there are fewer letters than that."""
    if d + 1 > length:
        return [(0, 0)]
    cuts = [k * length // (d + 1) for k in range(d + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _plan(sizes: list[int], least: float) -> tuple[list[tuple], list[tuple]]:
    """What strings and terms of each length give: (l, d, i, start, n) and (m, l, d, i, n, first, last), places from 0."""
    own, theirs = set(), []
    for m in sizes:
        for n in range(1, max(m, math.floor(m * 100 / least + 1e-6) if least > 0 else m) + 1):
            d = edits(m, n, least)
            if abs(m - n) > d:
                continue
            for i, (start, size) in enumerate(_segments(n, d)):
                own.add((n, d, i, start, size))
                shift = m - n
                first, last = (max(start - i, start + shift - (d - i), 0), min(start + i, start + shift + (d - i), m - size)) if size else (0, 0)
                if first <= last:
                    theirs.append((m, n, d, i, size, first, last))
    return sorted(own), theirs


def fitting_lengths(terms: DataFrame, least: float) -> tuple[int, int]:
    """The shortest and longest string that may reach `least` with any term; (1, 0) without terms."""
    low, high = terms.where("term <> ''").agg(F.min(F.char_length("term")), F.max(F.char_length("term"))).first()
    return (1, 0) if low is None else (math.ceil(low * least / 100 - 1e-6), math.floor(high * 100 / least + 1e-6))


def candidate_pairs(each: DataFrame, terms: DataFrame, least: float, words_sorted: bool = False, index_rows: int = INDEX_ROWS, by_letters: bool = True) -> DataFrame:
    """each (a column `chunk`) with those of terms (a column `term`) that may reach `least`; a pair may come several times.

    `_a` and `_b` are the forms that are compared, `_d` the edits that their lengths permit. by_letters: whether the letters of
    a chunk, which take longer than a few distances, are worth it; they are for distinct chunks and many terms.
    """
    if not 0 < least <= 100:
        raise ValueError("least must be over 0 and at most 100")
    spark, form = each.sparkSession, in_order if words_sorted else (lambda c: c)
    sizes = sorted(r["m"] for r in terms.select(F.char_length("term").alias("m")).where("m > 0").distinct().collect())  # at most the longest term's length
    own, theirs = _plan(sizes, least)
    own = spark.createDataFrame(own, "_l int, _d int, _i int, _p int, _n int")
    theirs = spark.createDataFrame(theirs, "_m int, _l int, _d int, _i int, _n int, _first int, _last int")
    index = terms.withColumns({"_m": F.char_length("term"), "_b": form(F.col("term")), "_lb": _letters(F.col("term"))}).join(F.broadcast(theirs), "_m")
    # A segment, its place and the lengths are one number: a probe then costs a fraction of one by four columns, and a pair
    # that meets by chance of the hash only goes to the distance.
    key = lambda s: F.xxhash64("_l", "_d", "_i", s)
    index = index.withColumn("_s", F.explode(F.array_distinct(F.transform(F.sequence("_first", "_last"), lambda p: F.substring("_b", p + 1, F.col("_n")))))).withColumn("_k", key("_s")).drop("_m", "_n", "_first", "_last", "_l", "_i", "_s")
    if index.limit(index_rows + 1).count() <= index_rows:
        index = F.broadcast(index)
    probes = each.withColumns({"_l": F.char_length("chunk"), "_a": form(F.col("chunk"))})
    if by_letters:
        probes = probes.withColumn("_la", _letters(F.col("chunk")))
    probes = probes.join(F.broadcast(own), "_l").withColumn("_k", key(F.substring("_a", F.col("_p") + 1, F.col("_n")))).drop("_l", "_i", "_p", "_n", "_d")
    pairs = probes.join(index, "_k")
    lacks = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y)))) <= F.col("_d")
    if by_letters:
        pairs = pairs.where(lacks("_la", "_lb") & lacks("_lb", "_la")).drop("_la")
    return pairs.drop("_k", "_lb")


def similar_pairs(each: DataFrame, terms: DataFrame, least: float, **how) -> DataFrame:
    """each (strings `chunk`) with all terms whose ratio, or token-sort ratio, is `least` or more, and that ratio, once each.

    how: see candidate_pairs.
    """
    pairs = candidate_pairs(each, terms, least, **how)
    near = pairs.withColumn("_e", F.call_function("levenshtein", F.col("_a"), F.col("_b"), F.col("_d"))).where("_e >= 0")
    longer = F.greatest(F.char_length("_a"), F.char_length("_b"))
    return near.withColumn("ratio", (longer - F.col("_e")) * 100.0 / longer).where(F.col("ratio") >= least).drop("_a", "_b", "_d", "_e").dropDuplicates()
