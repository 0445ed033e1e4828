"""Shared parts of the training-data operators: shared scratch tables, text columns, worker caches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable
from typing import TypeVar

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to a Python worker; long texts make small batches.
ARROW_BATCH_BYTES = 8 << 20
#: Bytes of files for which there is one partition at least, and partitions that are asked for on that account at most.
PARTITION_BYTES, MOST_PARTITIONS = 256 << 20, 20_000
T = TypeVar("T")
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in local mode, when it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="rowtide-")
    return _local_dirs[app]


class Scratch:
    """Tables of one run in the shared folder: they cut lineage and outlive lost executors."""

    saves = 0

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/rowtide/{name}-{uuid.uuid4().hex}"
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
        self.tidy()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, fmt: str = "parquet", **options: str) -> DataFrame:
        path = self.path(name)
        Scratch.saves += 1
        if Scratch.saves % 8 == 0:
            self.tidy()
        df.write.format(fmt).options(**({"compression": "zstd"} | options)).save(path)
        return self.spark.read.format(fmt).schema(df.schema).load(path)

    def drop(self, *names: str) -> None:
        """Only for tables that no DataFrame still to be run reads. Shuffle files of what wrote them go as well, as soon as the driver sees that they are garbage."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.tidy()

    def tidy(self) -> None:
        """Lets the driver give back memory, and Spark the shuffle files of frames that are gone."""
        gc.collect()
        jvm = self.spark._jvm
        jvm.System.gc()
        # what many short-lived threads have freed outside the heap; the server's class is not public, its interface is
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = self.spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        try:
            invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
        except Py4JError:
            pass  # a JVM without that command


def utf8(text: Column) -> Column:
    """The bytes of a text; null is the empty text."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def text_rows(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, body, ...) with columns of any other name left out, so that their names can't clash."""
    return docs.select(docs[id_col].cast("long").alias("id"), utf8(docs[text_col]).alias("body"), *(docs[c] for c in more))


def partitions(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Shuffle partitions of the session; for a frame of files more, if there would be over PARTITION_BYTES in each."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if df is not None else 0
    return max(n, min(size // PARTITION_BYTES, MOST_PARTITIONS)) if size < 1 << 60 else n


def ordered(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with ``bucket``: ascending ranges of ``key`` (null last) with about as many rows each, one a shuffle partition; and ``tie``, their order within a key.

    The cuts are quantiles of the key column alone; :func:`deal` then moves the rows once. A key that holds several
    cuts, and null if it holds as many rows, is split into ranges of a hash of the text, which is ``tie`` for its rows (else 0).
    """
    n = partitions(df.sparkSession, df)
    found = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("q"), F.count("*").alias("n"), F.count(key).alias("known")).first()
    cuts = sorted(found["q"] or [])
    shares = {k: m for k, m in Counter(cuts).items() if m > 1}
    lost = found["n"] - found["known"]
    parts = max(1, -(-lost * n // max(1, found["n"])))
    hashed = F.xxhash64(text)

    def part(m: int) -> Column:
        """Which of m equal ranges the hash is in."""
        return F.least(F.floor((hashed / F.lit(2.0**64) + 0.5) * m), F.lit(m - 1))

    known = bucket_of(F.col(key), cuts)
    for k, m in shares.items():
        known = known - F.when(F.col(key) == k, F.lit(m - 1) - part(m)).otherwise(0)
    bucket = F.when(F.col(key).isNull(), F.lit(len(cuts) + 1) + part(parts)).otherwise(known)
    return df.withColumn("bucket", bucket.cast("int")).withColumn("tie", F.when(F.col(key).isNull() | F.col(key).isin(list(shares)), hashed).otherwise(F.lit(0).cast("long")) if shares else F.when(F.col(key).isNull(), hashed).otherwise(F.lit(0).cast("long")))


def deal(df: DataFrame, *then: str | Column) -> DataFrame:
    """Each bucket of :func:`ordered` to a task, sorted by bucket and the given columns; a task has several where keys or null hold many."""
    n = partitions(df.sparkSession, df) + 2
    return df.repartitionById(n, F.pmod(F.col("bucket"), F.lit(n)).cast("int")).sortWithinPartitions("bucket", *then)


def bucket_of(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at or below the key."""
    if len(cuts) > 512:  # too many branches for one expression

        @F.pandas_udf("int")
        def place(k):  # noqa: ANN001, ANN202
            import pandas as pd

            return pd.Series(np.searchsorted(cuts, k.to_numpy(), side="right").astype(np.int32))

        return place(key)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", rounds: int = 100) -> DataFrame:
    """(node, component) of every node with an edge to another; component is the least node reachable.

    ``edges`` has long columns a and b. Alternates large-star and small-star steps (Kiveris et al. 2014);
    each round is written to the shared folder. Minima are combined before the shuffle and the joins are
    plain equi-joins, so a hub is split by adaptive execution.
    """
    spark = scratch.spark
    state = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = scratch.save(state, f"{name}-0")

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = mark(state)
    for i in range(1, rounds + 1):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = scratch.save(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        if (now := mark(state)) == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


class Bounded:
    """What a worker keeps between batches and tasks: models, and tables of words that don't pass a number of bytes."""


_resident: dict[str, Bounded] = {}


def resident(name: str, build: Callable[[], T]) -> T:
    """The one thing that a worker keeps: what was kept under another name goes, with all its tables, before the new one is built."""
    if name not in _resident:
        _resident.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _resident[name] = build()
    return _resident[name]
