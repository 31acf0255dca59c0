"""Ratios by the longest common subsequence of two strings, in Arrow batches.

The indel ratio is 200 * LCS / (sum of the lengths): only insertions and deletions count. The partial ratio is the highest
indel ratio of the shorter string to a stretch of its length in the longer.

The LCS is bit-parallel: a row of the dynamic programme is a number whose zero bits are the steps (Hyyro 2004), so a
letter of the second string takes three operations. Pairs whose first string has up to 64 letters go through numpy, a
whole batch at a time; longer ones through Python's unbounded integers, one by one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64
#: Windows that are compared at once.
BLOCK = 100_000


def _long_lcs(a: str, b: str) -> int:
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        step = row & places.get(c, 0)
        row = ((row + step) | (row - step)) & full
    return len(a) - row.bit_count()


def _codes(strings: list[str], width: int, fill: int) -> np.ndarray:
    """Code points, a row a string, padded by `fill`."""
    flat = np.frombuffer("".join(s.ljust(width, "\0") for s in strings).encode("utf-32-le"), "<u4").astype(np.int64).reshape(len(strings), width)
    length = np.array([len(s) for s in strings])
    return np.where(np.arange(width) < length[:, None], flat, fill)


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """The length of the longest common subsequence of each pair."""
    out = np.zeros(len(a), np.int64)
    short = np.array([0 < min(len(x), len(y)) <= WORD for x, y in zip(a, b, strict=True)], bool)
    for i in np.flatnonzero(~short):
        out[i] = _long_lcs(*sorted((a[i], b[i]), key=len))
    at = np.flatnonzero(short)
    if not len(at):
        return out
    pairs = [sorted((a[i], b[i]), key=len) for i in at]
    first, second = _codes([x for x, _ in pairs], max(len(x) for x, _ in pairs), -1), _codes([y for _, y in pairs], max(len(y) for _, y in pairs), -2)
    bits = np.uint64(1) << np.arange(first.shape[1], dtype=np.uint64)
    row = np.full(len(at), np.iinfo(np.uint64).max, np.uint64)
    for j in range(second.shape[1]):
        step = row & np.where(first == second[:, j : j + 1], bits, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        row = (row + step) | (row - step)
    own = np.where(first >= 0, bits, np.uint64(0)).sum(axis=1, dtype=np.uint64)
    out[at] = np.bitwise_count(~row & own)
    return out


def indel_ratios(a: list[str], b: list[str]) -> np.ndarray:
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])
    return np.where(total > 0, 200.0 * lcs_lengths(a, b) / np.maximum(total, 1), 100.0)


def partial_indel_ratios(a: list[str], b: list[str]) -> np.ndarray:
    out, at, left, right = np.zeros(len(a)), [], [], []

    def flush() -> None:
        if at:
            np.maximum.at(out, at, indel_ratios(left, right))
            at.clear(), left.clear(), right.clear()

    for i, pair in enumerate(zip(a, b, strict=True)):
        small, large = sorted(pair, key=len)
        if small in large:
            out[i] = 100.0
            continue
        for k in range(len(large) - len(small) + 1):
            at.append(i), left.append(small), right.append(large[k : k + len(small)])
            if len(at) >= BLOCK:
                flush()
    flush()
    return out


def _paired(work):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known = (a.notna() & b.notna()).to_numpy()
        out = pd.Series(np.nan, a.index, dtype="float64")
        if known.any():
            out[known] = work(a[known].tolist(), b[known].tolist())
        return out.astype("object").where(known, None)

    return run


def indel_ratio(a: Column, b: Column) -> Column:
    """0 to 100; null where a string is."""
    return F.pandas_udf(_paired(indel_ratios), "double")(a, b)


def partial_indel_ratio(a: Column, b: Column) -> Column:
    """0 to 100; null where a string is."""
    return F.pandas_udf(_paired(partial_indel_ratios), "double")(a, b)
