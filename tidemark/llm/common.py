"""Shared helpers: scratch tables in the cluster's shared folder, text keys, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that the operators strip and split at: [\x20\x09-\x0D].
WS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SCRATCH: list[str] = []
#: Rows of an Arrow batch: texts may be long, and a task holds a batch in the JVM and in its Python worker at once.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to BATCH_ROWS rows, unless it has a size of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset in local mode (as in tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not found:
        found = sc.getCheckpointDir()
        if not found:
            if sc.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
            sc.setCheckpointDir(found)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; clear_scratch() removes those made since a mark."""
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-scratch/{uuid.uuid4().hex}-{name}"
    _SCRATCH.append(path)
    return path


def scratch_mark() -> int:
    """What to give to clear_scratch() for the tables made from here on."""
    return len(_SCRATCH)


def clear_scratch(spark: SparkSession, since: int, but: str = "") -> None:
    """Delete the scratch tables made since a mark, except `but`; call it only when no frame that reads them is needed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for found in [p for p in _SCRATCH[since:] if p != but]:
        path = jvm.org.apache.hadoop.fs.Path(found)
        path.getFileSystem(conf).delete(path, True)
    _SCRATCH[since:] = [but] if but else []


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, other letters untouched. Spark's lower() does the same for pure ASCII and is several times faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def key128(c: Column, prefix: str = "h") -> list[Column]:
    """Two independent 64-bit hashes of a string, as columns h1 and h2."""
    return [F.xxhash64(c).alias(f"{prefix}1"), F.xxhash64(F.lit(0x9E3779B9), c).alias(f"{prefix}2")]


#: What a Python worker keeps between tasks, and for which operator.
_KEPT: list[dict] = []
_OWNER = [""]


def worker_cache() -> dict:
    """A dict that a worker keeps for later tasks of one operator; it is emptied when another operator's task starts."""
    _KEPT.append({})
    return _KEPT[-1]


def trim() -> None:
    """Give freed memory back to the system: workers live on, beside an executor that needs it."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def enter(owner: str) -> None:
    if _OWNER[0] != owner:
        for kept in _KEPT:
            kept.clear()
        _OWNER[0] = owner
        trim()


def tidy(owner: str, run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` over a task's batches, as `owner`; memory is given back at the end."""

    def wrapped(batches):
        enter(owner)
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def beside(docs: DataFrame, found: DataFrame, new: list[str]) -> DataFrame:
    """found's columns `new` beside all of docs', which found holds as a struct `row`.

    A new column whose name docs has already (in any case) gets underscores in front until the name is free.
    """
    taken, names = {c.lower() for c in docs.columns}, []
    for c in new:
        name = c
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        names.append(F.col(c).alias(name))
    return found.select("row.*", *names)


def crc_mod(col: str, m: int) -> Column:
    """crc32(column as text) mod m."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % m


def hash_cut(df: DataFrame, key: str, k: int) -> int:
    """The k-th least distinct value of a column of 64-bit hashes, or the largest value where there are fewer.

    Rows under a threshold are looked at first, so that no task sends k values of its own: the threshold lets about
    twice k of the distinct values pass, and is widened until k pass or all do.
    """
    low, high = -(1 << 63), (1 << 63) - 1
    n = df.agg(F.approx_count_distinct(key)).first()[0]
    span = (1 << 64) * (2 * k + 100) // max(1, n)
    while True:
        top = min(high, low + span)
        found = df.where(F.col(key) <= top).select(key).distinct().orderBy(key).limit(k)
        many, cut = found.agg(F.count("*"), F.max(key)).first()
        if many == k or top == high:
            return low if cut is None else cut
        span *= 4


def bounded_sample(df: DataFrame, seed: int, columns: list[str], k: int) -> DataFrame:
    """At most k different rows by `columns` (texts among them), those of least hash; repeats of a row count once.

    Any run and any partitioning give the same rows. Fewer than k different rows are all returned.
    """
    rows = df.withColumn("_hash", F.xxhash64(F.lit(seed), *columns))
    return rows.where(F.col("_hash") <= hash_cut(rows, "_hash", k)).dropDuplicates(["_hash"]).drop("_hash")


def task_count(spark: SparkSession, pieces: int, each: int = 8) -> int:
    """Tasks for so many pieces of work: adaptive execution leaves a stated number alone, however small the rows are."""
    return int(max(1, min(pieces, max(4 * spark.sparkContext.defaultParallelism, pieces // each), 200_000)))


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps (Kiveris et al. 2014).

    edges: columns a, b (long). Returns (id, component), component = least id reachable, for every id that is on
    an edge to another id. Each step is a min by key (combined before the shuffle) and an equi-join that Spark can
    split; the edge table is cut with a checkpoint and never grows. Nulls and self-loops are ignored; an empty
    table gives an empty table.
    """
    shared_dir(edges.sparkSession)
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    for _ in range(most):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
