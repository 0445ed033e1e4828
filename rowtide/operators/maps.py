"""Rows events meet their table maps and their schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A catalog of more tables is joined by a shuffle rather than broadcast.
BROADCAST_TABLES = 100_000


def latest_map(events: DataFrame, strict: bool = False) -> DataFrame:
    """Rows events with the latest preceding table map of their file and table id (strict: of their file): column ``map``."""
    keys = ["file_ord"] if strict else ["file_ord", "table_id"]
    w = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("map", F.last(F.when(F.col("kind") == "table_map", F.col("map")), ignorenulls=True).over(w)).where("kind = 'rows'")


def with_schema(rows: DataFrame, catalog: DataFrame, tables: int | None = None) -> DataFrame:
    """Left join by (db, tb). ``tables`` is the catalog's known number of rows: within BROADCAST_TABLES it is broadcast."""
    side = F.broadcast(catalog) if tables is not None and tables <= BROADCAST_TABLES else catalog
    return rows.join(side, ["db", "tb"], "left")


def without_schema(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    return rows.join(catalog, ["db", "tb"], "left_anti")


def census(events: DataFrame) -> DataFrame:
    """How many events there are of each type."""
    return events.groupBy("type").agg(F.count("*").alias("n"))


def manifest_check(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """(name, problem): files of a checkpoint that are missing (an error), and files that it doesn't know (a warning)."""
    missing = manifest.join(present, "name", "left_anti").select("name", F.lit("missing").alias("problem"))
    return missing.unionByName(present.join(manifest, "name", "left_anti").select("name", F.lit("extra").alias("problem")))


def compare(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("binlog", "start_pos", "end_pos"), value: str = "sql") -> DataFrame:
    """Positions whose statements differ between two outputs as multisets: (keys, only_a, only_b) with the numbers of unmatched statements."""
    count = lambda d, n: d.groupBy(*keys, value).agg(F.count("*").alias(n))
    both = count(a, "a").join(count(b, "b"), [*keys, value], "full_outer")
    less = F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))
    out = both.groupBy(*keys).agg(F.sum(F.greatest(less, F.lit(0))).alias("only_a"), F.sum(F.greatest(-less, F.lit(0))).alias("only_b"))
    return out.where("only_a > 0 or only_b > 0")
