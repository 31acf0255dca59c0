"""Embedding near-dedup by an inverted multi-index.

Vectors of one label and length are compared by cosine in double precision; those that reach `least` are linked.

1. Equal vectors of one label form a class with a multiplicity; only classes go on.
2. Unit vectors are cut in halves; each half has its own codebook of centroids, fitted on a bounded sample (`fit_rows`
   classes of least hash). The nearest centroids of a class's halves name its cell in the product grid. The grid grows
   with the table, so that a cell holds about `cell_rows` classes of one label.
3. Multi-sequence traversal visits, for each class, the grid's cells in order of a lower bound of the distance to any
   vector in them (half by half, the distance to the bisector of the own and the other centroid), and stops where the
   target recall is reached. The stop is calibrated on the sample: for each of its vectors, partners at exactly the
   linking cosine in random directions, the hardest that count, and all links between sampled vectors; the stop is the
   bound within which the share `recall` of these pairs meet. With recall 1 the stop is the linking distance, within
   which every link of any data is met for certain.
4. Each visited cell (its number not under the own one, so a pair meets once) compares its residents with each other
   and with its visitors in blocks of bounded size that are dealt over all tasks. A task returns, for each class, how
   many vectors it is linked with, and a spanning forest of its links: rows grow with the classes, never with the links.

Cases: null, zero, empty and non-finite vectors, those with a null component and those of a null label link with
nothing. Vectors of different lengths aren't compared. Rows of a null id count as links of others but have a null
component and are kept; repeated rows of an id count as vectors and share its component. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import bounded_sample, components, materialize, task_count, tidy

#: Classes in a block of residents and of visitors.
BLOCK, VISITORS = 1024, 4096
#: Partners of each sampled vector when the stop is calibrated.
PARTNERS = 8


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of x at length one in double precision, and which of them link with anything (finite and not zero)."""
    x = np.asarray(x, np.float64)
    able = np.isfinite(x).all(1)
    top = np.abs(np.where(able[:, None], x, 0)).max(1)
    able &= top > 0
    x = np.where(able[:, None], x, 0) / np.where(able, top, 1)[:, None]
    return x / np.where(able, np.sqrt((x * x).sum(1)), 1)[:, None] + 0.0, able


def pack(values: list, wide: bool) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
    """(raw components, [row, 2] fingerprints of the unit vector, lengths); length 0 for what links with nothing."""
    raw, prints, dims = [None] * len(values), np.zeros((len(values), 2), np.int64), np.zeros(len(values), np.int64)
    by: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        if v is not None and len(v):
            by.setdefault(len(v), []).append(i)
    for n, at in by.items():
        x = np.array([values[i] for i in at], np.float64).reshape(len(at), n)  # a null component becomes NaN
        u, able = units(x)
        x = x if wide else x.astype(np.float32)
        for i, row, one, ok in zip(at, x, u, able.tolist(), strict=True):
            if ok:
                b = one.tobytes()
                raw[i], dims[i] = row.tobytes(), n
                prints[i] = xxhash.xxh64_intdigest(b, 1) - (1 << 63), xxhash.xxh64_intdigest(b, 2) - (1 << 63)
    return raw, prints, dims


def unpack(raw: list[bytes], wide: bool) -> np.ndarray:
    """The unit vectors of packed ones of one length."""
    x = np.frombuffer(b"".join(raw), np.float64 if wide else np.float32)
    return units(x.reshape(len(raw), -1))[0]


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (x.shape[-1] + 1) // 2
    return x[..., :cut], x[..., cut:]


def codebook(x: np.ndarray, cells: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's centroids; an empty one stays where it is. Equal centroids are merged."""
    c = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        for k in range(len(c)):
            if (own == k).any():
                c[k] = x[own == k].mean(0)
    return np.unique(c, axis=0)


def bounds(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, lower bound of the distance to any vector whose nearest centroid is i) of each row."""
    d = np.maximum((h**2).sum(1)[:, None] - 2 * h @ c.T + (c**2).sum(1), 0)
    own = d.argmin(1)
    if len(c) == 1:
        return own, np.zeros_like(d)
    apart = np.sqrt(((c[:, None] - c) ** 2).sum(2))
    np.fill_diagonal(apart, np.inf)
    return own, (d - d[np.arange(len(h)), own][:, None]) / (2 * apart[own])


def multi_sequence(a: np.ndarray, b: np.ndarray, stop: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) by rising a[i]**2 + b[j]**2, up to stop**2 (Babenko and Lempitsky 2012)."""
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb, most = a[ia] ** 2, b[ib] ** 2, stop**2
    heap, done = [(sa[0] + sb[0], 0, 0)], [0] * len(sa)
    while heap:
        s, i, j = heapq.heappop(heap)
        if s > most:
            return
        yield int(ia[i]), int(ib[j])
        done[i] = j + 1
        if i + 1 < len(sa) and done[i + 1] == j:
            heapq.heappush(heap, (sa[i + 1] + sb[j], i + 1, j))
        if j + 1 < len(sb) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))


def needed(x: np.ndarray, y: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The stop with which each pair (x[k], y[k]) of unit vectors meets."""
    bound, cell = [], []
    for z in (x, y):
        (oa, la), (ob, lb) = (bounds(h, c) for h, c in zip(halves(z), books, strict=True))
        bound.append((la, lb))
        cell.append((oa, ob))
    own = [a * len(books[1]) + b for a, b in cell]
    rows, lower = np.arange(len(x)), own[0] <= own[1]
    stops = [np.hypot(bound[s][0][rows, cell[1 - s][0]], bound[s][1][rows, cell[1 - s][1]]) for s in (0, 1)]
    return np.where(lower, stops[0], stops[1])


class Grid:
    """Codebooks and stops by vector length; a length outside the sample has one cell."""

    def __init__(self, sample: list[np.ndarray], cells: int, least: float, recall: float):
        by: dict[int, list[np.ndarray]] = {}
        for x in sample:
            by.setdefault(len(x), []).append(x)
        self.books, self.stops = {}, {}
        for n, v in by.items():
            x = np.stack(v)
            self.books[n] = tuple(codebook(h, cells, 7 + k) for k, h in enumerate(halves(x)))
            self.stops[n] = self._stop(x, self.books[n], least, recall)

    def _stop(self, x: np.ndarray, books: tuple, least: float, recall: float) -> float:
        sure = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
        if recall >= 1:
            return sure
        rng = np.random.default_rng(11)
        found = []
        for _ in range(PARTNERS if x.shape[1] > 1 else 0):
            r = rng.normal(size=x.shape)
            r -= (r * x).sum(1)[:, None] * x
            r /= np.maximum(np.sqrt((r * r).sum(1)), 1e-300)[:, None]
            found.append(needed(x, least * x + np.sqrt(max(0.0, 1 - least * least)) * r, books))
        for i in range(0, len(x), 1024):
            a, b = np.nonzero(np.triu(x[i : i + 1024] @ x[i:].T >= least, 1))
            # Links of the sample, at most as many as there are partners, so that one large group doesn't decide alone.
            step = max(1, len(a) // (PARTNERS * 1024))
            found.append(needed(x[i + a[::step]], x[i + b[::step]], books) if len(a) else np.zeros(0))
        found = np.concatenate(found)
        return min(sure, float(np.quantile(found, recall, method="higher")) + 1e-9) if len(found) else sure

    def visits(self, x: np.ndarray) -> tuple[list[int], list[list[int]]]:
        """For unit vectors of one length: own cells, and the other visited cells, all of higher numbers."""
        books = self.books.get(x.shape[1])
        if books is None:
            return [0] * len(x), [[]] * len(x)
        (oa, la), (ob, lb) = (bounds(h, c) for h, c in zip(halves(x), books, strict=True))
        wide, stop = len(books[1]), self.stops[x.shape[1]]
        own = (oa * wide + ob).tolist()
        return own, [[c for i, j in multi_sequence(a, b, stop) if (c := i * wide + j) > o] for a, b, o in zip(la, lb, own, strict=True)]


def _compare(least: float, wide: bool):
    """A task's work on the rows of its blocks, which come sorted by task and role."""

    def links(g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        role, node, m = g["role"].to_numpy(), g["node"].to_numpy(), g["m"].to_numpy()
        n = int(np.searchsorted(role, 1))  # residents of the block come first
        if not n:
            return
        x = unpack(g["v"].tolist(), wide)
        hit = x[:n] @ x.T >= least
        # A block with itself: each pair once. Where the task isn't the block's own, residents don't meet here.
        hit[:, :n] = np.triu(hit[:, :n], 1) if g["i"].iat[0] == g["j"].iat[0] else False
        some = np.flatnonzero(hit.any(1))
        if not len(some):
            return
        links_ = np.zeros(len(g), np.int64)
        links_[:n] = hit @ m
        links_ += m[:n] @ hit
        root = np.arange(len(g))
        for r in some.tolist():
            own = np.unique(root[np.append(np.flatnonzero(hit[r]), r)])
            if len(own) > 1:
                root[np.isin(root, own[1:])] = own[0]
        has = links_ > 0
        yield pd.DataFrame({"a": node[has], "b": node[has], "n": links_[has]})
        tied = np.flatnonzero(root != np.arange(len(g)))
        yield pd.DataFrame({"a": node[tied], "b": node[root[tied]], "n": np.zeros(len(tied), np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, keys = None, ["task", "cell", "i", "j"]
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            k = b[keys].to_numpy()
            ends = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist()]
            for s, e in zip(ends[:-1], ends[1:], strict=True):
                yield from links(b.iloc[s:e])
            rest = b.iloc[ends[-1] :]
        if rest is not None and len(rest):
            yield from links(rest)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.98, recall: float = 0.9999, fit_rows: int = 8192, cell_rows: int = 256) -> DataFrame:
    """(id, n_links, component_id, kept), one row for each row of vectors."""
    spark = vectors.sparkSession
    kind = vectors.schema[vec_col].dataType
    wide = not (isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType))
    flat = vectors.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>" if wide else "array<float>").alias("v"))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            has = b["label"].notna().tolist()
            raw, prints, dims = pack([v if ok else None for v, ok in zip(b["v"], has, strict=True)], wide)
            yield pd.DataFrame({"id": b["id"].array, "label": b["label"].array, "dim": dims, "f1": prints[:, 0], "f2": prints[:, 1], "v": raw})

    packed = flat.mapInPandas(tidy("embed", describe), "id string, label string, dim long, f1 long, f2 long, v binary").withColumn("id", F.col("id").cast("long"))
    own = materialize(packed.drop("v"), "vectors")
    # One vector a class, any of them. Copies meet in the partial aggregates, so that only different vectors are shuffled.
    classes = packed.where("dim > 0").groupBy("label", "dim", "f1", "f2").agg(F.count("*").alias("m"), F.min("id").alias("rep"), F.first("v").alias("v"))
    # A class's node is the hash of its label, length and contents.
    classes = materialize(classes.select(F.xxhash64("label", "dim", "f1", "f2").alias("node"), "*"), "classes")
    n, alike = classes.groupBy("label").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum(F.col("count").cast("double") * F.col("count")), F.lit(0.0))).first()
    # The label of a class holds alike / n others on average.
    cells = int(np.clip(round((alike / max(1, n) / cell_rows) ** 0.5), 1, 1024))
    sample = bounded_sample(classes.select("node", "v"), 3, ["node"], fit_rows).orderBy("node").select("v").collect()  # bounded by fit_rows
    grid = spark.sparkContext.broadcast(Grid([unpack([bytes(r["v"])], wide)[0] for r in sample], cells, least, recall))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, g in b.groupby("dim"):
                cell, seen = grid.value.visits(unpack(g["v"].tolist(), wide))
                yield g[["node", "label", "dim", "m", "v"]].assign(cell=cell, seen=seen)

    rows = classes.select("node", "label", "dim", "m", "v").mapInPandas(tidy("embed", index), "node long, label string, dim long, m long, v binary, cell long, seen array<long>")
    rows = materialize(rows, "indexed")
    key = ["label", "dim", "cell"]
    stay, call = rows.groupBy(*key).agg(F.count("*").alias("r")), rows.select("label", "dim", F.explode("seen").alias("cell")).groupBy(*key).agg(F.count("*").alias("q"))
    # Task (i, j) of a cell: block i of the residents with block j of them, if j >= i, and with block j of the visitors.
    parts = stay.join(call, key, "left").select(*key, F.ceil(F.col("r") / BLOCK).cast("int").alias("rs"), F.ceil(F.coalesce("q", F.lit(0)) / VISITORS).cast("int").alias("qs"))
    parts = materialize(parts, "parts")
    pairs = parts.agg(F.coalesce(F.sum(F.col("rs").cast("long") * F.greatest("rs", "qs")), F.lit(0))).first()[0]
    block = lambda c: F.pmod(F.xxhash64(F.lit(9), "node"), c).cast("int")
    to = lambda c: F.sequence(F.lit(0), c - 1)
    home = rows.drop("seen").join(parts, key).withColumn("o", block(F.col("rs")))
    role = lambda i, j, k: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(k).alias("role"))
    places = F.concat(F.transform(to(F.greatest("rs", "qs")), lambda j: role(F.col("o"), j, 0)), F.when(F.col("o") > 0, F.transform(to(F.col("o")), lambda i: role(i, F.col("o"), 1))).otherwise(F.array().cast("array<struct<i:int,j:int,role:int>>")))
    home = home.select(*key, "node", "m", "v", F.inline(places))
    away = rows.drop("cell").withColumn("cell", F.explode("seen")).drop("seen").join(parts, key).withColumn("o", block(F.col("qs")))
    away = away.select(*key, "node", "m", "v", F.inline(F.transform(to(F.col("rs")), lambda i: role(i, F.col("o"), 2))))
    tasks = home.unionByName(away).select(F.xxhash64(*key, "i", "j").alias("task"), "cell", "i", "j", "role", "node", "m", "v")
    tasks = tasks.repartition(task_count(spark, pairs), "task").sortWithinPartitions("task", "cell", "i", "j", "role", "node")
    found = materialize(tasks.mapInPandas(tidy("embed", _compare(least, wide)), "a long, b long, n long"), "links")
    counted = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    comp = components(found.where("a <> b").select("a", "b")).select(F.col("id").alias("node"), "component")
    facts = classes.drop("v").join(counted, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = facts.groupBy("component").agg(F.min("rep").alias("component_id"))
    facts = facts.join(least_id, "component").select("label", "dim", "f1", "f2", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = own.join(facts, ["label", "dim", "f1", "f2"], "left")
    group = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), group.alias("component_id"), F.coalesce(F.col("id") == group, F.lit(True)).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector, at a cosine of 0.98 within a label."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return near_vectors(vectors).withColumnRenamed("id", "vec_id")


#: All pairs of a label, and what is reachable over links.
ORACLE: dict[str, str] = {
    "op5_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), g AS (
  SELECT vec_id, label, e, len(e) AS n, sqrt(list_dot_product(e, e)) AS size FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.n = b.n AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98::DOUBLE
), r AS (
  SELECT vec_id, vec_id AS reached FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a
), c AS (
  SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id
)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c""",
}
